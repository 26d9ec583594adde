"""Secret scans: fixed patterns and a randomness test battery, in built-in functions only.

Base kinds are found by pattern.  Besides, every maximal run of encoding
characters of some length is a candidate.  Its encoding is inferred from its
characters, and a battery asks whether it looks like random draws from that
encoding's alphabet: the chi-squared statistic of uniformity, the number of runs
of character classes (lower case, upper case, digits, others), and the serial
correlation of neighbouring codes.  A candidate that none of the three rejects
(Bonferroni) has, as evidence against ordinary text, a Chernoff bound on the
chance that text which changes its character class at the rate ``ORDINARY``
changes it so often in so many characters.  That p-value shrinks with length by
itself; candidates are discovered at the false-discovery rate ``FDR`` within
their document (Benjamini-Hochberg), weighted by their lengths.

Everything about a document is computed in its own row: no shuffle, no join.
Positions are code points; they are summed up from the lengths of what stands
between matches, since no built-in function gives the places of all matches.
The sums take a pass over the matches for each binary digit of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh_name

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: Rate of class changes in ordinary text, level of the battery, false-discovery rate.
ORDINARY, LEVEL, FDR = 0.1, 0.01, 0.001

SPAN = "struct<start:bigint,kind:int,end:bigint,from:bigint,to:bigint>"
FOUND = "array<struct<start:bigint,end:bigint,from:bigint,to:bigint,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it.

    Built-in functions have no scan, and a fold that appends copies what it has
    each time.  So all values are joined at once with those 1, 2, 4, ... places
    before them: as many passes as their number has binary digits.
    """
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)).otherwise(F.expr("cast(array() as array<int>)"))

    def one(acc: Column, k: Column) -> Column:
        return let(F.pow(F.lit(2.0), k).cast("int"), lambda far: F.transform(acc, lambda v, i: F.when(i >= far, join(F.get(acc, i - far), v)).otherwise(v)))

    return F.aggregate(passes, values, one)


def find_all(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Matches of a Java pattern, leftmost and non-overlapping, in order: places in code points (``start``, ``end``) and in bytes (``from``, ``to``), and text (``m``)."""
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.expr(f"cast(array() as {FOUND})")

    def placed(parts: Column, found: Column) -> Column:
        # What stands before a match, and the match, end where the sums of lengths up to them say.
        lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda p, m: F.struct(
            (F.length(p) + F.length(m)).cast("long").alias("chars"), (F.octet_length(p) + F.octet_length(m)).cast("long").alias("bytes")
        ))
        ends = running(lengths, lambda a, b: F.struct((a["chars"] + b["chars"]).alias("chars"), (a["bytes"] + b["bytes"]).alias("bytes")))
        rows = F.zip_with(ends, found, lambda e, m: F.struct(
            (e["chars"] - F.length(m)).alias("start"), e["chars"].alias("end"), (e["bytes"] - F.octet_length(m)).alias("from"), e["bytes"].alias("to"), m.alias("m")
        ))
        return rows if keep is None else F.filter(rows, lambda r: keep(r["m"]))

    return F.when(text.rlike(pattern), let(between, lambda parts: let(matches, lambda found: placed(parts, found)))).otherwise(empty)


def _tail(z: Column) -> Column:
    """An upper bound of the chance that a standard normal exceeds ``z``; 1 for ``z`` up to 0."""
    return F.when(z <= 0, F.lit(1.0)).otherwise(F.exp(-z * z / 2))


def evidence(s: Column) -> Column:
    """The p-value of a candidate against ordinary text; 1 if the battery doesn't take it for random."""
    n = F.length(s).cast("double")
    # An alphabet's size, and the chance that two of its characters are of different classes.
    kinds = [
        (r"^[0-9]+$", 10.0, 0.0),
        (r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16.0, 2 * 10 * 6 / 16**2),
        (r"^[A-Z2-7]+=*$", 32.0, 2 * 26 * 6 / 32**2),
        (r"^(?:[0-9a-z]+|[0-9A-Z]+)$", 36.0, 2 * 26 * 10 / 36**2),
        (r"", 64.0, 1 - (26**2 + 26**2 + 10**2 + 2**2) / 64**2),
    ]
    alphabet = None
    for pattern, size, differ in kinds:
        own = F.struct(F.lit(size).alias("size"), F.lit(differ).alias("differ"))
        alphabet = F.when(s.rlike(pattern), own) if alphabet is None else alphabet.when(s.rlike(pattern), own)
    runs = F.size(F.regexp_extract_all(s, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0)))
    codes = F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("double"))

    def battery(a: Column, x: Column, changes: Column) -> Column:
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter(x, lambda c: c == d)).cast("double"), F.lit(2.0)))
        uniform = (a["size"] / n * squares - n - (a["size"] - 1)) / F.sqrt(2 * (a["size"] - 1))
        spread = (n - 1) * a["differ"] * (1 - a["differ"])
        too_few = F.when(spread > 0, ((n - 1) * a["differ"] - changes) / F.sqrt(spread)).otherwise(F.lit(0.0))
        mean = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + c) / n
        var = F.aggregate(x, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
        lagged = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda p, q: (p - mean) * (q - mean))
        serial = F.when(var > 0, (F.aggregate(lagged, F.lit(0.0), lambda acc, c: acc + c) / var * n + 1) / F.sqrt(n)).otherwise(F.lit(99.0))
        random = 3 * F.least(_tail(uniform), _tail(too_few), _tail(F.abs(serial))) >= LEVEL
        rate = changes / (n - 1)
        divergence = F.when(rate <= ORDINARY, F.lit(0.0)).otherwise(
            rate * F.log(rate / ORDINARY) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - ORDINARY))).otherwise(F.lit(0.0))
        )
        return F.when(random, F.exp(-(n - 1) * divergence)).otherwise(F.lit(1.0))

    return let(alphabet, lambda a: let(codes, lambda x: battery(a, x, (runs - 1).cast("double"))))


def discoveries(candidates: Column) -> Column:
    """The candidates that the weighted Benjamini-Hochberg procedure discovers among themselves."""
    total = F.aggregate(candidates, F.lit(0.0), lambda acc, c: acc + F.length(c["m"]))
    m = F.size(candidates)
    scored = let(
        total,
        lambda t: F.transform(
            candidates,
            lambda c: F.struct((evidence(c["m"]) * t / (F.length(c["m"]) * m)).alias("p"), *[c[n].alias(n) for n in ("start", "end", "from", "to")]),
        ),
    )

    def chosen(rows: Column) -> Column:
        ranked = F.array_sort(F.transform(rows, lambda r: r["p"]))
        passing = F.transform(ranked, lambda p, i: F.when(p * F.size(rows) <= F.lit(FDR) * (i + 1), p))
        limit = F.array_max(passing)
        return let(limit, lambda t: F.filter(rows, lambda r: r["p"] <= t))

    return let(scored, chosen)


def uncovered(candidates: Column, spans: Column) -> Column:
    """The candidates that none of the ordered spans covers: read in one order, each is held against the furthest end of the spans before it."""
    none = F.lit(-1).cast("long")
    events = F.array_sort(
        F.concat(
            F.transform(spans, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("reach"), F.lit(None).cast(FOUND[6:-1]).alias("c"))),
            F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), none.alias("reach"), c.alias("c"))),
        )
    )

    def kept(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda e: e["reach"]), lambda a, b: F.greatest(a, b))
        judged = F.zip_with(rows, reach, lambda e, r: F.when((e["own"] == 1) & (r < e["c"]["end"]), e["c"]))
        return F.filter(judged, lambda c: c.isNotNull())

    return let(events, kept)


def _with_spans(df: DataFrame, text_col: str, add: dict[str, str]) -> DataFrame:
    """``df`` with arrays of (start, kind, end): base and all spans, in order."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = {
        "assign": find_all(text, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        "access": find_all(text, ACCESS),
        "hex": find_all(text, HEX),
        "random": find_all(text, CANDIDATE),
    }
    names = {k: fresh_name(df, f"found_{k}") for k in found}
    df = df.withColumns({names[k]: c for k, c in found.items()})
    spans = [_as_kind(F.col(names[k]), i) for i, k in enumerate(KINDS[:3])]
    df = df.withColumn(add["base"], F.array_sort(F.concat(*spans)))
    base = F.col(add["base"])
    # A run that a base span covers is reported by that already.
    fresh = F.when((F.size(names["random"]) > 0) & (F.size(base) > 0), uncovered(F.col(names["random"]), base)).otherwise(F.col(names["random"]))
    df = df.withColumn(names["random"], fresh)
    more = F.when(
        F.size(names["random"]) > 0,
        _as_kind(discoveries(F.col(names["random"])), 3),
    ).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))
    return df.withColumn(add["spans"], F.array_sort(F.concat(base, more))).drop(*names.values())


def _as_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["from"].alias("from"), s["to"].alias("to")))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.

    A span is ``kind:start:end`` in code points, end exclusive; spans are
    ordered by start, then kind, and joined by commas.  ``base_sha256`` is of
    the base kinds' spans.

    Null or empty text: no span (the digest of the empty string).  Repeated rows
    and null ids: a row each.  Empty table: no row.  Other columns aren't read.
    """
    rows = _with_spans(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", {"base": "base", "spans": "spans"})
    counts = [_of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return rows.select(F.col("id").alias(id_col), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` for each stretch of ordered spans that touch or overlap.

    The stretches are found from the furthest end so far, and what stands between
    them is cut from the text's bytes, where a cut needs no count of characters.
    """

    def one(raw: Column, ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda s: s["to"]), lambda a, b: F.greatest(a, b))

        def cut(ends: Column) -> Column:
            # The bytes from the end of what is masked so far to the next span, if there are any, then the mask.
            def piece(s: Column, i: Column) -> Column:
                at = F.when(i > 0, F.get(ends, i - 1)).otherwise(F.lit(0).cast("long"))
                plain = F.substring(raw, (at + 1).cast("int"), (s["from"] - at).cast("int")).cast("string")
                return F.when(s["from"] > at, F.concat(plain, F.lit(mask))).when(i == 0, F.lit(mask)).otherwise(F.lit(""))

            last = F.element_at(ends, -1)
            return F.concat(F.array_join(F.transform(ordered, piece), ""), F.substring(raw, (last + 1).cast("int"), F.octet_length(raw)).cast("string"))

        return let(reach, cut)

    return let(text.cast("binary"), lambda raw: let(spans, lambda ordered: one(raw, ordered)))


def redact_secrets(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``df``, with its columns, where ``mask`` stands for each stretch of text that spans cover.

    Touching or overlapping spans give one mask.  Where a text changes, an
    existing column ``chars_col`` gets its new number of code points.  Null
    texts stay null.  Other edge cases as in :func:`scan_secrets`.
    """
    base, spans = fresh_name(df, "base_spans"), fresh_name(df, "all_spans")
    rows = _with_spans(df, text_col, {"base": base, "spans": spans})
    done = masked(F.col(f"`{text_col}`").cast("string"), F.col(f"`{spans}`"), mask)
    new = fresh_name(rows, "redacted")
    rows = rows.withColumn(new, F.when(F.size(f"`{spans}`") > 0, done))  # null where nothing changes
    out = []
    for c in df.columns:
        own = F.col(f"`{c}`")
        if c == text_col:
            out.append(F.coalesce(F.col(f"`{new}`"), own.cast("string")).alias(c))
        elif c == chars_col:
            out.append(F.coalesce(F.length(f"`{new}`"), own).cast(df.schema[c].dataType).alias(c))
        else:
            out.append(own)
    return rows.select(*out)
