"""Views that the queries run over, derived from the driver's tables.

Each view has the same definition twice: as a DataFrame and as SQL for the
oracle, a common table expression of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..schema import COUNTER, VERSION, conform

SMALLEST_BLOCK = 4096
NOW = 1_700_000_000
DEVICE = "1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: str) -> Column:
    # A difference of times without zones: the session's time zone doesn't matter.
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes of files by four devices."""
    e = table(spark, sf_dir, "events").withColumn("us", _micros("ts"))
    return e.select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/e"), (F.floor(F.col("event_id") / 7) % 20).cast("string")).alias("name"),
        (F.col("event_id") % 4).alias("dev"), (F.col("event_id") + 1).alias("seq"), F.floor(F.col("us") / 1000000).alias("modified_s"),
        (F.col("us") % 1000000 * 1000).cast("int").alias("modified_ns"), (F.col("event_id") % 9).alias("r"), "event_type", "user_id",
        F.round(F.col("value") * 100).cast("long").cast("string").alias("content"), "ts",
    )


EVT = """evt AS (SELECT event_id, 'u' || user_id || '/e' || ((event_id // 7) % 20) AS name, event_id % 4 AS dev, event_id + 1 AS seq,
 epoch_us(ts) // 1000000 AS modified_s, CAST((epoch_us(ts) % 1000000) * 1000 AS INTEGER) AS modified_ns, event_id % 9 AS r, event_type, user_id,
 CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS content, ts FROM events)"""


def _replica(spark: SparkSession, sf_dir: str, without: int, peer: bool) -> DataFrame:
    rows = evt(spark, sf_dir).where(F.col("r") != without)
    last = F.max_by(F.struct("event_type", "modified_s", "modified_ns", "content", "seq"), "event_id").alias("l")
    counters = rows.groupBy("name", "dev").agg(F.max("seq").alias("c"), last, F.max("event_id").alias("at"))
    one = counters.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("dev").cast("string"), F.col("c").cast(COUNTER)))).alias("version"), F.max_by("l", "at").alias("l")
    )
    deleted = F.col("l.event_type") == "error"
    permissions = F.when(F.col("l.modified_s") % 13 == 0, 493).otherwise(420) if peer else F.lit(420)
    return conform(
        one.select(
            F.lit("default").alias("folder"), "name", F.when(deleted, F.lit(0)).otherwise(F.length("l.content")).cast("long").alias("size"),
            permissions.cast("long").alias("permissions"), "l.modified_s", "l.modified_ns", F.col("l.seq").alias("sequence"), "version",
            F.when(~deleted, hashing.sha256(F.encode("l.content", "UTF-8"))).alias("content_hash"), deleted.alias("deleted"),
        )
    )


def replica_have(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Our records."""
    return _replica(spark, sf_dir, 0, False)


def replica_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peer's records."""
    return _replica(spark, sf_dir, 1, True)


def _replica_sql(name: str, without: int, permissions: str) -> str:
    counters = ", ".join(f"max(seq) FILTER (WHERE dev = {d}) AS v{d}" for d in range(4))
    return f"""{name} AS (SELECT *, CASE WHEN deleted THEN 0 ELSE length(content) END AS size, CASE WHEN NOT deleted THEN sha256(content) END AS h,
 {permissions} AS permissions FROM (SELECT name, {counters}, arg_max(event_type, event_id) = 'error' AS deleted, arg_max(modified_s, event_id) AS modified_s,
 arg_max(modified_ns, event_id) AS modified_ns, arg_max(content, event_id) AS content, max(seq) AS seq FROM evt WHERE r <> {without} GROUP BY name))"""


HAVE = _replica_sql("have", 0, "420")
PEER = _replica_sql("peer", 1, "CASE WHEN modified_s % 13 = 0 THEN 493 ELSE 420 END")
_AHEAD = " OR ".join(f"coalesce(h.v{d}, 0) > coalesce(p.v{d}, 0)" for d in range(4))
_BEHIND = " OR ".join(f"coalesce(h.v{d}, 0) < coalesce(p.v{d}, 0)" for d in range(4))
#: Every record of the peer with ours: relation, sameness of contents, who wins.
PAIRS = f"""pairs AS (SELECT p.name, h.name IS NULL AS missing, coalesce(h.deleted, false) AS dead, p.deleted AS p_deleted,
 CASE WHEN ({_AHEAD}) AND ({_BEHIND}) THEN 'CONCURRENT' WHEN {_AHEAD} THEN 'OURS' WHEN {_BEHIND} THEN 'THEIRS' ELSE 'EQUAL' END AS relation,
 coalesce(NOT h.deleted AND h.size = p.size AND h.h = p.h, false) AS same,
 coalesce(h.modified_s <> p.modified_s OR h.modified_ns <> p.modified_ns OR h.permissions <> p.permissions, false) AS meta,
 coalesce(h.modified_s = p.modified_s AND h.modified_ns = p.modified_ns, false) AS times,
 CASE WHEN h.modified_s <> p.modified_s THEN p.modified_s > h.modified_s WHEN h.modified_ns <> p.modified_ns THEN p.modified_ns > h.modified_ns
  ELSE coalesce(p.h, '') > coalesce(h.h, '') END AS wins,
 coalesce(p.modified_s < h.modified_s, false) AS older, p.modified_s AS p_s, h.modified_s AS h_s
 FROM peer p LEFT JOIN have h ON h.name = p.name)"""


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (folder, name, size, modified_s, content, doc_id, block_size)."""
    d = table(spark, sf_dir, "documents")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = d.select(
        F.col("lang").alias("folder"), F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), "source",
        F.octet_length(content).cast("long").alias("size"), (F.lit(1_600_000_000) + F.col("doc_id") * 60).alias("modified_s"), content.alias("content"), "doc_id",
    )
    return rows.withColumn("block_size", hashing.block_size(F.col("size"), smallest=SMALLEST_BLOCK))


DOC_FILES = """doc_files AS (SELECT lang AS folder, source || '/doc' || doc_id || '.txt' AS name, source, strlen(coalesce(text, ''))::BIGINT AS size,
 1600000000 + doc_id * 60 AS modified_s, encode(coalesce(text, '')) AS content, sha256(coalesce(text, '')) AS h, doc_id FROM documents)"""


def index0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index: records of the files, and of their directories."""
    f = doc_files(spark, sf_dir)
    own = hashing.sha256(F.col("content"))
    dead = F.col("doc_id") % 17 == 0
    files = f.select(
        "folder", "name", F.lit(0).alias("type"), "size", F.lit(420).cast("long").alias("permissions"), "modified_s", (F.col("doc_id") + 1).alias("sequence"), "block_size",
        F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("1"), (F.col("doc_id") + 1).cast(COUNTER), F.lit("2"), F.lit(5).cast(COUNTER)))
        .otherwise(F.create_map(F.lit("2"), (F.col("doc_id") + 1).cast(COUNTER))).cast(VERSION).alias("version"),
        F.when(~dead, own).alias("content_hash"), dead.alias("deleted"), (F.col("doc_id") % 23 == 0).alias("invalid"),
        F.when(F.col("doc_id") % 29 == 0, F.expr("cast(array() as array<binary>)")).otherwise(F.array(own)).alias("block_hashes"),
    )
    dirs = f.groupBy("folder", "source").agg(F.max("modified_s").alias("modified_s"), F.min("doc_id").alias("sequence"))
    dirs = dirs.select("folder", F.col("source").alias("name"), F.lit(1).alias("type"), F.lit(493).cast("long").alias("permissions"), "modified_s", "sequence")
    return conform(files).unionByName(conform(dirs))


INDEX0 = """index0 AS (SELECT folder, name, 0 AS type, size, 420 AS permissions, modified_s, doc_id + 1 AS sequence,
 CASE WHEN doc_id % 3 = 0 THEN doc_id + 1 END AS v1, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE doc_id + 1 END AS v2, CASE WHEN doc_id % 17 <> 0 THEN h END AS h,
 doc_id % 17 = 0 AS deleted, doc_id % 23 = 0 AS invalid, CASE WHEN doc_id % 29 = 0 THEN 0 ELSE 1 END AS blocks FROM doc_files
 UNION ALL SELECT folder, source, 1, 0, 493, max(modified_s), min(doc_id), NULL, NULL, NULL, false, false, 0 FROM doc_files GROUP BY folder, source)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk of the folders finds: some files gone, some changed, some new."""
    f, k = doc_files(spark, sf_dir), F.col("doc_id")
    old = f.where(k % 10 != 0).select(
        "folder", "name", (F.col("size") + F.when(k % 11 == 0, 1).otherwise(0)).alias("size"),
        (F.col("modified_s") + F.when(k % 7 == 0, 1000).otherwise(0)).alias("modified_s"), F.lit(False).alias("is_dir"),
    )
    new = f.where(k % 13 == 0).select("folder", F.concat(F.lit("new/doc"), k.cast("string"), F.lit(".txt")).alias("name"), "size", "modified_s", F.lit(False).alias("is_dir"))
    dirs = f.where("source <> 'src4'").select("folder", F.col("source").alias("name"), F.lit(0).cast("long").alias("size"), F.lit(NOW).cast("long").alias("modified_s"), F.lit(True).alias("is_dir")).distinct()
    return old.unionByName(new).unionByName(dirs)


LISTING = f"""listing AS (SELECT folder, name, size + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS size,
 modified_s + CASE WHEN doc_id % 7 = 0 THEN 1000 ELSE 0 END AS modified_s, false AS is_dir FROM doc_files WHERE doc_id % 10 <> 0
 UNION ALL SELECT folder, 'new/doc' || doc_id || '.txt', size, modified_s, false FROM doc_files WHERE doc_id % 13 = 0
 UNION ALL SELECT DISTINCT folder, source, 0, {NOW}, true FROM doc_files WHERE source <> 'src4')"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a change feed, in three folders."""
    e = evt(spark, sf_dir)
    deleted = F.col("event_type") == "error"
    return conform(
        e.select(
            F.concat(F.lit("f"), (F.col("user_id") % 3).cast("string")).alias("folder"), "name", F.when(deleted, F.lit(0)).otherwise(F.length("content")).cast("long").alias("size"),
            F.lit(420).cast("long").alias("permissions"), "modified_s", "modified_ns", F.col("seq").alias("sequence"),
            F.create_map(F.col("dev").cast("string"), F.col("seq").cast(COUNTER)).cast(VERSION).alias("version"),
            F.when(~deleted, hashing.sha256(F.encode("content", "UTF-8"))).alias("content_hash"), deleted.alias("deleted"), (F.col("event_id") % 31 == 0).alias("invalid"),
            F.when(deleted | (F.col("event_id") % 37 == 0), F.expr("cast(array() as array<binary>)")).otherwise(F.array(hashing.sha256(F.encode("content", "UTF-8")))).alias("block_hashes"),
        )
    )


FEED = """feed AS (SELECT 'f' || (user_id % 3) AS folder, name, CASE WHEN event_type = 'error' THEN 0 ELSE length(content) END AS size, modified_s, modified_ns, seq AS sequence,
 dev, event_type = 'error' AS deleted, event_id % 31 = 0 AS invalid, NOT (event_type = 'error' OR event_id % 37 = 0) AS has_blocks,
 CASE WHEN event_type <> 'error' THEN sha256(content) END AS h FROM evt)"""


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, name): URLs without scheme, query and fragment, as relative paths."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("name"))


PAGE_PATHS = "page_paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS name FROM pages)"

KINDS = {"view": "queued", "click": "active", "purchase": "stalled", "signup": "parked", "error": "reverted"}


def peer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of peers' sessions: (peer, folder, kind)."""
    e, kind = table(spark, sf_dir, "events"), None
    for k, v in KINDS.items():
        kind = F.when(F.col("event_type") == k, v) if kind is None else kind.when(F.col("event_type") == k, v)
    kind = F.when(F.col("event_id") % 19 == 0, "kept").otherwise(kind)
    return e.select((F.col("user_id") % 5).alias("peer"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("folder"), kind.alias("kind"))


PEER_SESSIONS = (
    "peer_sessions AS (SELECT user_id % 5 AS peer, 'f' || (event_id % 3) AS folder, CASE WHEN event_id % 19 = 0 THEN 'kept' "
    + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in KINDS.items())
    + " END AS kind FROM events)"
)


def with_views(body: str, *views: str) -> str:
    """A query with its common table expressions."""
    return f"WITH {', '.join(views)} {body}"
