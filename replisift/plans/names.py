"""Queries of names, hashes of names, rule texts and dates, over inputs on which they can fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, hashing, paths, text
from ..session import ship
from . import fixtures as X
from .catalogue import query

_WIDE, _LOOKS_WIDE = "\u65e5\u672c", "\u00e6\u0097\u00a5"
#: A document's first words as a path, some with characters beyond Latin-1, some whose Latin-1 bytes are UTF-8 of such.
_NAME = f"""CASE doc_id % 4 WHEN 0 THEN '{_WIDE}/' WHEN 1 THEN 'caf\u00e9/' WHEN 2 THEN '{_LOOKS_WIDE}/' ELSE 'x\u20acy/' END || replace(replace(substr(coalesce(text, ''), 1, 40), ' ', '/'), chr(10), '')"""
NAMES = f"named AS (SELECT doc_id, {_NAME} AS name FROM documents)"


def _named(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", F.expr(_NAME).alias("name"))


@query(
    f"""SELECT doc_id, array_to_string(list_transform(string_split(name, '/'), lambda c: CASE WHEN regexp_matches(c, '^[\\x00-\\x{{ff}}]*$')
 THEN array_to_string(list_transform(CASE WHEN c = '' THEN [] ELSE string_split(c, '') END, lambda x: printf('%02X', ord(x))), '') ELSE hex(encode(c)) END), '2F') AS local,
 replace('/' || name || '/', '/{_LOOKS_WIDE}/', '/\u65e5/')[2:-2] AS back FROM named""",
    NAMES,
)
def latin_names(spark, sf_dir):
    """Names as the bytes of a Latin-1 disk, and read back: a component whose bytes are wide UTF-8 by chance comes back as that."""
    local = paths.to_local(F.col("name"))
    return _named(spark, sf_dir).select("doc_id", F.hex(local).alias("local"), paths.from_local(local).alias("back"))


_BYTES = "list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k::INTEGER + 1, 2))::UBIGINT)"


@query(
    f"""SELECT doc_id, list_reduce(list_prepend(2166136261::UBIGINT, {_BYTES}), lambda h, b: (xor(h, b) * 16777619) & 4294967295::UBIGINT)::BIGINT AS h32,
 lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform({_BYTES}, lambda b: b::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0')) AS h64
 FROM (SELECT doc_id, hex(encode(name)) AS x FROM named)""",
    NAMES,
)
def name_hashes(spark, sf_dir):
    """The 32-bit and 64-bit hashes of names, by which state files and lookups are named."""
    raw = F.encode("name", "UTF-8")
    return _named(spark, sf_dir).select("doc_id", hashing.fnv32(raw).alias("h32"), hashing.fnv64(raw).alias("h64"))


@query(
    """SELECT doc_id, sha256(lower(source) || '*' || chr(0) || '0' || '0' || chr(10) || 'x/' || lang || chr(0) || '1' || '1' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN lang || chr(0) || '00' || chr(10) || '3' ELSE '2' END) AS fingerprint FROM documents"""
)
def rule_fingerprints(spark, sf_dir):
    """The fingerprint of a rule text of each document; comments and blank lines don't count, order and kind do."""
    ship(spark)
    d = X.table(spark, sf_dir, "documents")
    rules = F.concat(F.lit("// "), F.col("doc_id").cast("string"), F.lit("\n\n"), "source", F.lit("*\n!/x/"), "lang", F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.lit("# no more")))
    return d.select("doc_id", globs.fingerprints(rules).alias("fingerprint"))


@query(
    """SELECT o_orderkey, date_diff('day', DATE '1970-01-01', d)::INTEGER AS days, year(d) * 10000 + month(d) * 100 + day(d) AS stamp, date_diff('day', DATE '1970-01-01', (date_trunc('month', d) + INTERVAL 14 MONTH)::DATE)::INTEGER + 39 AS later
 FROM (SELECT o_orderkey, (o_orderdate - INTERVAL (o_orderkey % 60) YEAR)::DATE AS d FROM orders)"""
)
def civil_days(spark, sf_dir):
    """Orders' dates up to sixty years earlier, as days and back, and a date beyond its month and year."""
    d = F.expr("cast(add_months(cast(o_orderdate as date), cast(-12 * (o_orderkey % 60) as int)) as date)")
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", text.civil(F.unix_date(d).cast("long") * 86400 + 86399).alias("c"))
    c = F.col("c")
    days = text.days_of(c["year"], c["month"], c["day"])
    later = text.days_of(c["year"], c["month"] + 14, F.lit(40))
    return rows.select("o_orderkey", days.alias("days"), (c["year"] * 10000 + c["month"] * 100 + c["day"]).cast("long").alias("stamp"), later.alias("later"))
