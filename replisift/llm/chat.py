"""Chat formatting after a collapse of cumulative snapshots.

Loggers write a conversation again after each turn, so most logged
conversations are prefixes of longer ones.  Every conversation gets a rolling
hash for each of its prefixes: the XOR, over its turns so far, of hashes salted
with the turn's place (two independent 64-bit hashes).  A conversation whose
whole hash is a proper prefix hash of another, or equals that of one with a
smaller id, is dropped by an anti-join on (length, hashes).  Only what remains
is fetched with its texts and rendered.

Texts are shuffled once, and only those of conversations that stay; all else
works on hashes, deduplicated before they meet, so a first turn or a whole
conversation that very many logs share is one key with one row a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a turn is written: before the role, between role and text, after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, n_copies) of the conversations that no other extends; of equal ones the smallest id, with their number.

    Repeated rows count once.  Rows that share a turn number form one place,
    whatever their order.  A null turn is the first place; null roles and texts
    are empty; rows with a null id form one conversation.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit("\x1f"), role).alias("b")
    ).distinct()
    places = rows.groupBy("conv", "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    own = Window.partitionBy("conv")
    so_far = own.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = (
        places.withColumn("place", F.row_number().over(own.orderBy("turn")))
        .withColumns({"a": F.xxhash64("place", "a"), "b": F.xxhash64("b", "place", "a")})
        .select("conv", "place", F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"), F.count("*").over(own).alias("n"))
    )
    key = ["place", "a", "b"]
    proper = prefixes.where("place < n").select(*key).distinct()
    whole = prefixes.where("place = n").groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_copies"))
    return whole.join(proper, key, "left_anti").select("conv", "n_copies")


def format_chats(
    turns: DataFrame, template: tuple[str, str, str] = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Per maximal conversation: id, ``n_turns``, ``n_copies`` (equal conversations, itself included) and the rendered ``text``.

    Turns are written in order of (turn, role, text), repeated rows once.  Other
    edge cases as in :func:`maximal_conversations`.  Empty table: no row.
    A conversation is one row of the result, so it is held whole once.
    """
    kept = maximal_conversations(turns, conv_col, turn_col, role_col, text_col)
    rows = turns.select(
        F.col(conv_col).alias("id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = (
        rows.join(kept, F.col("id").eqNullSafe(F.col("conv")))
        .groupBy("id", "n_copies")
        .agg(F.array_sort(F.collect_set("t")).alias("turns"))
    )
    before, between, after = map(F.lit, template)
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(before, t["role"], between, t["text"], after)), "")
    return whole.select(F.col("id").alias(conv_col), F.size("turns").cast("long").alias("n_turns"), "n_copies", rendered.alias("text"))
