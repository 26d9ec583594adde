"""Spelling variants: words that one inserted, deleted or replaced letter sets apart, grouped without pairs.

A word of n letters stands in n groups (position, what is before, what is
behind): all words of such a group differ from each other in that letter only.
A group's size tells each of its words how many near words it has there, and
the group's first two words by frequency tell it the best of them, since a
word's best other word is the first, or the second for the first itself.  Two
words that differ in one letter meet in one group only, so sizes add up.  For
insertions and deletions a word goes to the groups of what is left of it without
one letter (each such rest once), where the rest itself may be a word.  Groups
of both kinds are told apart by a star for the letter that may be any.  No pair
is ever made: a word sends two rows a letter and gets at most as many back.

Words are numbered in code-point order first, so the rows have fixed sizes: the
key, the number and the frequency.  A key is the group's text, or a 127-bit
polynomial fingerprint of it where that is long, so the work grows with a
word's length and not with its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.places import placed
from ._common import Scratch, ship, text_bytes

#: Fixed value: what words are made of.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Letters of a group's key that are kept as text; longer keys are fingerprints.
PLAIN_KEY = 48
_PRIME, _BASE = (1 << 127) - 1, 0x6A09E667F3BCC908B2FB1366EA957D3E
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed_words(df: DataFrame, drop_every: int | None = None, least_letters: int = LEAST_LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` per maximal run of letters with at least ``least_letters`` of them, A-Z in lower case.

    With ``drop_every`` a letter is dropped from some runs first, by the checksum
    of ``<id>:<run>``: the rule that the query's contract gives (a null id is empty there).
    """
    low = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    found = df.select(F.col(id_col).alias("__id"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("word"))
    if drop_every is None:
        return found.select("word")
    keyed = F.concat(F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")
    marked = found.select("word", F.crc32(keyed).alias("h"))
    at = (F.col("h") % F.length("word")).cast("int")
    dropped = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    out = marked.select(F.when(F.col("h") % drop_every == 0, dropped).otherwise(F.col("word")).alias("word"))
    return out.where(F.length("word") >= least_letters)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur often enough; counts are combined before they are shuffled."""
    return words.where(F.col("word").isNotNull()).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def group_keys(word: str, plain: int = PLAIN_KEY) -> tuple[list[bytes], list[bytes], bytes]:
    """The keys of a word's groups: one a letter that may be any, one a different rest without a letter, and its own."""
    n = len(word)
    # Without a letter, or the same letter beside it, the rest is the same: the last one of equal letters is left out.
    rests = [k for k in range(n) if k + 1 == n or word[k] != word[k + 1]]
    short, shorter = n <= plain, n - 1 <= plain
    if short:
        return [f"{word[:k]}*{word[k + 1 :]}".encode() for k in range(n)], [(word[:k] + word[k + 1 :]).encode() for k in rests], word.encode()
    # The fingerprint of a text is its letters as digits of a number: parts can be put together.
    powers, head, tail = [1], [0], [0] * (n + 1)
    for c in word:
        powers.append(powers[-1] * _BASE % _PRIME)
        head.append((head[-1] * _BASE + ord(c)) % _PRIME)
    for k in range(n - 1, -1, -1):
        tail[k] = (ord(word[k]) * powers[n - 1 - k] + tail[k + 1]) % _PRIME

    def key(x: int, letters: int) -> bytes:
        return b"#%d#" % letters + x.to_bytes(16, "little")

    any_letter = [key((head[k] * powers[n - k] + 42 * powers[n - 1 - k] + tail[k + 1]) % _PRIME, n) + b"*" for k in range(n)]
    if shorter:
        less = [(word[:k] + word[k + 1 :]).encode() for k in rests]
    else:
        less = [key((head[k] * powers[n - 1 - k] + tail[k + 1]) % _PRIME, n - 1) for k in rests]
    return any_letter, less, key(head[n], n)


def _memberships(words: DataFrame) -> DataFrame:
    """(key, kind, place, n) of all groups that words (word, place, n) stand in.  Kinds: 0 any letter, 1 the word is longer by a letter, 2 the word itself."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "kind", "place", "n"]

        def out(keys: list, kinds: list, places: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(kinds, pa.int8()), pa.array(places, pa.int64()), pa.array(counts, pa.int64())], names)

        for batch in batches:
            keys, kinds, places, counts = [], [], [], []
            for word, place, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                any_letter, less, own = group_keys(word.decode("utf-8", "replace"))
                keys += any_letter + less + [own]
                k = len(any_letter) + len(less) + 1
                kinds += [0] * len(any_letter) + [1] * len(less) + [2]
                places += [place] * k
                counts += [n] * k
                if len(keys) > 20_000:
                    yield out(keys, kinds, places, counts)
                    keys, kinds, places, counts = [], [], [], []
            if keys:
                yield out(keys, kinds, places, counts)

    return words.select(text_bytes("word"), "place", "n").mapInArrow(run, "key binary, kind byte, place long, n long")


def _best(kind: Column) -> Column:
    """The most frequent, then first, member of a kind in a group."""
    return F.min(F.when(kind, F.struct((-F.col("n")).alias("less"), F.col("place").alias("place"))))


def near_words(words: DataFrame) -> DataFrame:
    """(place, n_near, best) of words (word, place, n) that have a near word: how many, and the most frequent (struct of negative n, place).

    A group of any letter has as many words as there are letters, at most; one of
    a rest as many as rest's places times letters.  Groups are sorted and read in
    order, not held.
    """
    group = Window.partitionBy("key")
    ranked = group.orderBy((-F.col("n")), "place")
    everything = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("less"), F.col("place").alias("place"))
    rows = _memberships(words).select(
        "kind", "place",
        F.count("*").over(everything).alias("size"), F.row_number().over(ranked).alias("at"),
        F.first(member).over(everything).alias("first"), F.nth_value(member, 2).over(everything).alias("second"),
        F.first(F.when(F.col("kind") == 1, member), ignorenulls=True).over(everything).alias("longer"),
        F.max(F.when(F.col("kind") == 2, member)).over(everything).alias("own"),
    ).where("size > 1")
    # A group of a rest has its words once each: those that are longer, and the rest itself if it is a word.
    got = (
        F.when(F.col("kind") == 0, F.struct((F.col("size") - 1).alias("count"), F.when(F.col("at") == 1, F.col("second")).otherwise(F.col("first")).alias("best")))
        .when((F.col("kind") == 1) & F.col("own").isNotNull(), F.struct(F.lit(1).cast("long").alias("count"), F.col("own").alias("best")))
        .when(F.col("kind") == 2, F.struct((F.col("size") - 1).alias("count"), F.col("longer").alias("best")))
    )
    told = rows.select("place", got.alias("got")).where("got IS NOT NULL")
    return told.groupBy("place").agg(F.sum("got.count").alias("n_near"), F.min("got.best").alias("best"))


def _chain_rounds(largest: int, times: int) -> int:
    """Rounds of pointer doubling after which any chain of forms has ended: a form is ``times`` as frequent, so chains are short."""
    steps, n = 1, LEAST_COUNT
    while n * times <= largest:
        n, steps = n * times, steps + 1
    return steps.bit_length()


def spelling_groups(words: DataFrame, times: int = TIMES, least_count: int = LEAST_COUNT) -> DataFrame:
    """Per word of ``words`` that occurs often enough: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Two words are near if one inserted, deleted or replaced code point sets them
    apart.  A word's form is its most frequent near word (ties: first in code-point
    order) if that is ``times`` as frequent, else null; its root is where forms lead.

    Null words: left out.  The empty word: a word like others.  Ties: by
    code-point order.  Repeated rows: counted.  No row: no row.  Very long words:
    work in proportion to their letters; keys of more than 48 letters are
    compared by 127-bit fingerprints.  Columns other than ``word`` are not read.
    ``times`` must be 2 at least, so that chains of forms end.
    """
    if times < 2:
        raise ValueError("a form must be twice as frequent at least")
    spark = words.sparkSession
    scratch = Scratch(spark, "spelling")
    known = scratch.write(placed(vocabulary(words, least_count), [], ["word"], as_col="place"), "words")
    near = scratch.write(near_words(known), "near")
    largest = known.agg(F.max("n")).first()[0] or 0
    linked = near.where(F.col("best").isNotNull()).join(known.select("place", "n"), "place").where(-F.col("best.less") >= times * F.col("n"))
    ahead = scratch.write(linked.select("place", F.col("best.place").alias("form_place"), (-F.col("best.less")).alias("form_n"), F.col("best.place").alias("root_place")), "forms")
    for _ in range(_chain_rounds(largest, times) - 1):
        step = ahead.select(F.col("place").alias("root_place"), F.col("root_place").alias("__next"))
        further = ahead.join(step, "root_place", "left").select("place", "form_place", "form_n", F.coalesce("__next", "root_place").alias("root_place"))
        ahead = scratch.write(further, "forms")
    named = ahead.join(known.select(F.col("place").alias("form_place"), F.col("word").alias("form")), "form_place")
    named = named.join(known.select(F.col("place").alias("root_place"), F.col("word").alias("root")), "root_place").select("place", "form", "root", "form_n")
    out = known.join(near.select("place", "n_near"), "place", "left").join(named, "place", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def normalise(df: DataFrame, groups: DataFrame, word_col: str = "word") -> DataFrame:
    """``df`` with ``root`` beside each word: what :func:`spelling_groups` leads it to, or the word itself.

    Null word: null root.  Words that no group knows: themselves.
    """
    roots = groups.where("form IS NOT NULL").select(F.col("word").alias("__word"), F.col("root").alias("__root"))
    return df.join(roots, F.col(word_col) == F.col("__word"), "left").withColumn("root", F.coalesce("__root", word_col)).drop("__word", "__root")
