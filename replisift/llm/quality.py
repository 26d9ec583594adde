"""Quality rules as a bitmask ledger.

Every rule is evaluated once, in one pass over the texts.  The ledger keeps the
measurements and one bit for each rule that a document fails.  Policies are
named, versioned sets of rules: applying one is a bitwise AND, and ablations
(what each rule removes alone, and what would return without it) are one
aggregation of bitwise expressions over the ledger, without the texts.

A word is a maximal run of bytes other than space and 0x09-0x0D.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh_name, held, map_texts, ship

MEASURES = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("n_lines", "long"), ("n_upper", "long"), ("n_lower", "long"), ("n_exclaim", "long"),
]

SPACE, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

#: Rule names and the SQL condition, over the measurements, under which a
#: document fails.  A rule's bit is its place here; rules are only appended.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("dup_lines", "n_lines >= 3 AND 10 * n_dup_lines > 4 * n_lines"),
    ("shouting", "n_upper > n_lower"),
    ("exclaims", "10 * n_exclaim > 3 * n_words"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    ("too_long", "n_words > 200000000"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules that each one rejects by.
POLICIES = {
    "base-1": ("few_words", "repeated_words"),
    "web-1": ("few_words", "repeated_words", "symbols", "dup_lines"),
    "web-2": ("few_words", "repeated_words", "symbols", "dup_lines", "shouting", "exclaims", "word_length"),
}
DEFAULT_POLICY = "web-2"


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    return sum(BIT[name] for name in POLICIES[policy])


def measure(data: bytes) -> tuple:
    """The measurements of a text's UTF-8 bytes, in the order of ``MEASURES``."""
    words = data.split()
    n = len(words)
    word_chars = len(b"".join(words).decode("utf-8", "replace"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 3:
        grams = list(zip(words, words[1:], words[2:]))
        counts = Counter(grams)
        if len(counts) < len(grams):
            until = 0  # words before this position are already counted
            for i, g in enumerate(grams):
                if counts[g] > 1:
                    repeat += i + 3 - max(i, until)
                    until = i + 3
    size = len(data)
    count = lambda chars: size - len(data.translate(None, chars))
    return n, word_chars, count(SYMBOLS), dup, repeat, len(lines), count(UPPER), count(LOWER), data.count(b"!")


def quality_ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the measurements, and ``failed`` (long), the bits of the rules that the text fails.

    Null or empty text: zeros, which fails ``few_words`` alone.  Repeated rows
    and null ids: a row each.  Empty table: no row.  Other columns aren't read.
    """
    rows = map_texts(df, lambda: lambda data: [measure(data)], MEASURES, id_col, text_col)
    return rows.withColumn("failed", failed_bits())


def failed_bits(struct: str | None = None) -> Column:
    """The ledger's bitmask from the measurements, columns or fields of the column ``struct``."""
    total = None
    for name, condition in RULES:
        test = F.expr(condition if struct is None else re.sub(rf"\b({'|'.join(n for n, _ in MEASURES)})\b", rf"`{struct}`.\1", condition))
        bit = F.when(test, F.lit(BIT[name])).otherwise(F.lit(0))
        total = bit if total is None else total.bitwiseOR(bit)
    return total.cast("long")


def apply_policy(ledger: DataFrame, policy: str = DEFAULT_POLICY, as_col: str = "kept", bits_col: str = "failed") -> DataFrame:
    """The ledger with ``as_col``: true where no rule of ``policy`` failed."""
    return ledger.withColumn(as_col, F.col(f"`{bits_col}`").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(ledger: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """One row a rule of ``policy``: ``n_failed`` documents fail it, and ``n_only``, which fail no other rule of the policy, would return without it."""
    bits = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    aggs = []
    for name in POLICIES[policy]:
        aggs.append(F.count_if(bits.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"f_{name}"))
        aggs.append(F.count_if(bits == BIT[name]).alias(f"o_{name}"))
    one = ledger.agg(F.count("*").alias("n_documents"), *aggs)
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"f_{n}").alias("n_failed"), F.col(f"o_{n}").alias("n_only")) for n in POLICIES[policy]])
    return one.select(F.lit(policy).alias("policy"), "n_documents", F.explode(rules).alias("r")).select("policy", "n_documents", "r.*")


def keep_quality(df: DataFrame, policy: str = DEFAULT_POLICY, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with its columns, whose text passes ``policy``.  Edge cases as in :func:`quality_ledger`."""
    ship(df.sparkSession)
    name = fresh_name(df, "measured")
    fields = ", ".join(f"{n} {t}" for n, t in MEASURES)

    @F.pandas_udf(f"struct<{fields.replace(' ', ':').replace(',:', ',')}>")
    def measured(texts):
        import pandas as pd

        held("quality")
        return pd.DataFrame([measure(x) for x in texts], columns=[n for n, _ in MEASURES])

    raw = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"").cast("binary"))
    bits = fresh_name(df, "failed_bits")
    out = df.withColumn(name, measured(raw)).withColumn(bits, failed_bits(name))
    return apply_policy(out, policy, name, bits).where(F.col(f"`{name}`")).select(*[F.col(f"`{c}`") for c in df.columns])
