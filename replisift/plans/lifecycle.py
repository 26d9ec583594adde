"""Queries of the operators that change state, and of sweeps, wants and deletions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs, hashing
from ..operators import classify as C
from ..operators import index as idx
from ..operators import lifecycle as L
from ..operators import rename, scan
from . import fixtures as X
from .catalogue import ACTION, FEEDS, LATEST, REPLICAS, SCANS, SWEPT, _hex, query

HIDDEN = "^src3(/|$)"
#: What a walk that leaves out src3 finds, against the index.
WALKED = f"walked AS (SELECT * FROM listing WHERE NOT regexp_matches(name, '{HIDDEN}'))"
WALK_DIFF = SCANS[3].replace("diffed AS", "walk_diff AS").replace("FROM listing l", "FROM walked l")
_FOLD = """sha256(unhex((SELECT string_agg(sha256(content[k * 131072 + 1 : (k + 1) * 131072]), '' ORDER BY k) FROM range(greatest(1, ceil(size / 131072))::BIGINT) r(k))))"""
#: Contents of listed files: a listed document's bytes, by the number in its name.
NUMBER = "regexp_extract(name, 'doc([0-9]+)[.]txt$', 1)"
LISTED_FILES = f"listed_files AS (SELECT l.folder, l.name, d.size, d.h FROM listing l JOIN doc_files d ON d.folder = l.folder AND d.doc_id = TRY_CAST({NUMBER.replace('name', 'l.name')} AS BIGINT) WHERE NOT l.is_dir)"
READ_FILES = f"""read_files AS (SELECT l.folder, l.name, l.size AS listed, d.size, CASE WHEN doc_id % 19 < 5 THEN 'vanished' WHEN doc_id % 19 < 8 THEN 'unreadable' WHEN doc_id % 19 < 10 THEN 'too_big' END AS status
 FROM listing l JOIN doc_files d ON d.folder = l.folder AND d.doc_id = TRY_CAST({NUMBER.replace('name', 'l.name')} AS BIGINT) WHERE NOT l.is_dir)"""
FRESH = "fresh AS (SELECT f.folder, f.name, f.size, f.h FROM listed_files f JOIN diffed USING (folder, name) WHERE change IN ('new', 'changed'))"
VANISHED = "vanished AS (SELECT i.folder, i.name, i.size, i.h FROM index0 i JOIN diffed USING (folder, name) WHERE change = 'missing' AND i.type = 0)"


def _hidden():
    return globs.ignored(F.col("name"), globs.parse_rules("/src3").rules)


def _marked(spark, sf_dir) -> DataFrame:
    """The index with its folder's highest sequence (``high``); one row a folder on the other side."""
    index = X.index0(spark, sf_dir)
    return index.join(idx.high_water(index), "folder")


def _listed_files(spark, sf_dir) -> DataFrame:
    files = X.doc_files(spark, sf_dir).select("folder", "doc_id", "size", hashing.sha256(F.col("content")).alias("content_hash"), "content")
    listed = X.listing(spark, sf_dir).where("NOT is_dir").select("folder", "name", F.expr(f"try_cast({NUMBER} as bigint)").alias("doc_id"))
    return listed.join(files, ["folder", "doc_id"])


def _change(spark, sf_dir, *kinds: str) -> DataFrame:
    return scan.diff(X.listing(spark, sf_dir), X.index0(spark, sf_dir)).where(F.col("change").isin(*kinds)).select("folder", "name")


def _fresh(spark, sf_dir) -> DataFrame:
    return _listed_files(spark, sf_dir).drop("doc_id").join(_change(spark, sf_dir, "new", "changed"), ["folder", "name"])


def _vanished(spark, sf_dir) -> DataFrame:
    return X.index0(spark, sf_dir).where("type = 0").join(_change(spark, sf_dir, "missing"), ["folder", "name"])


def _all_wants(spark, sf_dir) -> DataFrame:
    return X.doc_files(spark, sf_dir).select("folder", "name", "size", hashing.sha256(F.col("content")).alias("content_hash"))


# --- whole tables


@query("SELECT dev AS session, sequence AS push_no, sequence % 5 >= 3 AS stalled FROM feed", *FEEDS)
def want_queue_whole(spark, sf_dir):
    """All wants of the feed, without a cap."""
    w = X.feed(spark, sf_dir).select(F.map_keys("version")[0].cast("long").alias("session"), F.col("sequence").alias("push_no"), (F.col("sequence") % 5).alias("attempts"))
    return rename.want_queue(w).select("session", "push_no", "stalled")


@query(
    f"""SELECT d.folder, d.name, {_FOLD} AS content_hash, greatest(1, ceil(f.size / 131072))::BIGINT AS n_blocks, greatest({X.NOW}, f.modified_s) >= f.modified_s AS stamped
 FROM diffed d JOIN doc_files f ON f.folder = d.folder AND f.name = d.name WHERE d.change = 'changed'""",
    *SCANS,
)
def commit_changed_whole(spark, sf_dir):
    """All changed files, of any number of blocks."""
    changed = scan.diff(X.listing(spark, sf_dir), X.index0(spark, sf_dir)).where("change = 'changed'").select("folder", "name", F.col("record.version").alias("version"))
    rows = scan.commit_files(X.doc_files(spark, sf_dir).join(changed, ["folder", "name"]), X.DEVICE, X.NOW)
    stamped = F.element_at("version", F.lit(X.DEVICE)) >= F.col("modified_s")
    return rows.select("folder", "name", _hex("content_hash").alias("content_hash"), F.size("block_hashes").cast("long").alias("n_blocks"), stamped.alias("stamped"))


@query("SELECT folder, name, verdict FROM swept", X.DOC_FILES, X.INDEX0, X.LISTING, SWEPT)
def sweep_whole(spark, sf_dir):
    """A sweep up to each folder's highest sequence."""
    return scan.sweep(_marked(spark, sf_dir), X.listing(spark, sf_dir), _hidden(), F.col("high")).select("folder", "name", "verdict")


@query(
    f"""SELECT folder, name, verdict = 'tombstone' AS deleted, verdict = 'invalid' AS invalid,
 CASE WHEN verdict = 'tombstone' THEN greatest({X.NOW}, coalesce(v1 + 1, 0)) ELSE v1 END AS counter FROM swept WHERE verdict <> 'spared'""",
    X.DOC_FILES, X.INDEX0, X.LISTING, SWEPT,
)
def sweep_records_whole(spark, sf_dir):
    swept = scan.sweep(_marked(spark, sf_dir), X.listing(spark, sf_dir), _hidden(), F.col("high")).drop("high")
    rows = scan.swept_records(swept, X.DEVICE, X.NOW)
    return rows.select("folder", "name", "deleted", "invalid", F.try_element_at("version", F.lit(X.DEVICE)).cast("long").alias("counter"))


@query(
    """SELECT folder, name FROM index0 i WHERE NOT (NOT deleted AND NOT invalid AND NOT EXISTS (SELECT 1 FROM listing l WHERE l.folder = i.folder AND l.name = i.name))""",
    X.DOC_FILES, X.INDEX0, X.LISTING,
)
def forget_unseen_whole(spark, sf_dir):
    return idx.forget_unseen(_marked(spark, sf_dir), X.listing(spark, sf_dir), F.col("high")).select("folder", "name")


@query(
    """SELECT folder, name, source FROM (SELECT w.folder, w.name, i.name AS source, row_number() OVER (PARTITION BY w.folder, w.name ORDER BY i.sequence, i.name) AS k
 FROM doc_files w JOIN index0 i ON i.folder = w.folder AND i.size = w.size AND i.h = w.h AND i.name <> w.name WHERE i.type = 0 AND NOT i.deleted AND NOT i.invalid) WHERE k = 1""",
    X.DOC_FILES, X.INDEX0,
)
def rename_sources_whole(spark, sf_dir):
    return rename.local_sources(_all_wants(spark, sf_dir), X.index0(spark, sf_dir))


@query(
    "SELECT folder, name FROM doc_files w SEMI JOIN (SELECT * FROM index0 WHERE NOT deleted) i ON i.folder = w.folder AND i.name = w.name AND i.size = w.size AND i.h = w.h",
    X.DOC_FILES, X.INDEX0,
)
def already_have_whole(spark, sf_dir):
    return rename.already_have(_all_wants(spark, sf_dir), X.index0(spark, sf_dir)).select("folder", "name")


@query("SELECT DISTINCT size, h FROM doc_files", X.DOC_FILES)
def wanted_contents_whole(spark, sf_dir):
    return _all_wants(spark, sf_dir).select("size", _hex("content_hash").alias("h")).distinct()


@query("SELECT folder, name FROM vanished d SEMI JOIN fresh w ON w.size = d.size AND w.h = d.h", *SCANS, LISTED_FILES, FRESH, VANISHED)
def held_deletes_whole(spark, sf_dir):
    """Vanished files whose content a new or changed file has."""
    return rename.held_deletes(_vanished(spark, sf_dir), _fresh(spark, sf_dir)).select("folder", "name")


@query("SELECT folder, name FROM vanished d ANTI JOIN fresh w ON w.size = d.size AND w.h = d.h", *SCANS, LISTED_FILES, FRESH, VANISHED)
def applied_deletes_whole(spark, sf_dir):
    return rename.applied_deletes(_vanished(spark, sf_dir), _fresh(spark, sf_dir)).select("folder", "name")


# --- passes and decisions that change state


@query(
    f"""SELECT folder, name, coalesce(n.deleted, i.deleted) AS deleted, coalesce(n.invalid, i.invalid) AS invalid, coalesce(n.sequence, i.sequence) AS sequence FROM index0 i FULL JOIN (
 SELECT folder, name, verdict = 'tombstone' AS deleted, verdict = 'invalid' AS invalid,
  (SELECT max(sequence) FROM index0 x WHERE x.folder = c.folder) + row_number() OVER (PARTITION BY folder ORDER BY name) AS sequence FROM (
  SELECT folder, name, 'file' AS verdict FROM walk_diff d WHERE change IN ('new', 'changed') AND NOT is_dir AND EXISTS (SELECT 1 FROM listed_files f JOIN listing l USING (folder, name)
   WHERE f.folder = d.folder AND f.name = d.name AND f.size = l.size)
  UNION ALL SELECT folder, name, 'dir' FROM walk_diff WHERE change IN ('new', 'changed') AND is_dir
  UNION ALL SELECT folder, name, CASE WHEN regexp_matches(name, '{HIDDEN}') THEN 'invalid' ELSE 'tombstone' END FROM index0 i WHERE NOT deleted AND NOT invalid
   AND NOT EXISTS (SELECT 1 FROM walked l WHERE l.folder = i.folder AND l.name = i.name) AND NOT (type = 1 AND regexp_matches(name, '{HIDDEN}'))) c) n USING (folder, name)""",
    *SCANS, WALKED, WALK_DIFF, LISTED_FILES,
)
def scan_pass(spark, sf_dir):
    """A whole scan pass: the next state of the index."""
    contents = _listed_files(spark, sf_dir).select("folder", "name", "content", F.lit(None).cast("string").alias("status"))
    state = L.scan_pass(X.listing(spark, sf_dir), X.index0(spark, sf_dir), contents, _hidden(), X.DEVICE, X.NOW, ".part")
    return state.select("folder", "name", "deleted", "invalid", "sequence")


@query(
    f"""SELECT folder, name, coalesce(n.deleted, i.deleted) AS deleted, coalesce(n.invalid, i.invalid) AS invalid, coalesce(n.sequence, i.sequence) AS sequence FROM index0 i FULL JOIN (
 SELECT folder, name, verdict = 'tombstone' AS deleted, verdict = 'invalid' AS invalid,
  (SELECT max(sequence) FROM index0 x WHERE x.folder = c.folder) + row_number() OVER (PARTITION BY folder ORDER BY name) AS sequence FROM (
  SELECT folder, name, 'file' AS verdict FROM walk_diff JOIN read_files USING (folder, name) WHERE change IN ('new', 'changed') AND NOT is_dir AND status IS NULL AND size = listed
  UNION ALL SELECT folder, name, 'dir' FROM walk_diff WHERE change IN ('new', 'changed') AND is_dir
  UNION ALL SELECT folder, name, CASE WHEN regexp_matches(name, '{HIDDEN}') THEN 'invalid' ELSE 'tombstone' END FROM index0 i WHERE NOT deleted AND NOT invalid
   AND (NOT EXISTS (SELECT 1 FROM walked l WHERE l.folder = i.folder AND l.name = i.name)
    OR EXISTS (SELECT 1 FROM walk_diff d JOIN read_files r USING (folder, name) WHERE d.folder = i.folder AND d.name = i.name AND change = 'changed' AND status = 'vanished'))
   AND NOT (type = 1 AND regexp_matches(name, '{HIDDEN}'))) c) n USING (folder, name)""",
    *SCANS, WALKED, WALK_DIFF, READ_FILES,
)
def scan_pass_statuses(spark, sf_dir):
    """A scan pass in which files vanish, can't be read, are too big or change while they are hashed."""
    k = F.col("doc_id") % 19
    status = F.when(k < 5, "vanished").when(k < 8, "unreadable").when(k < 10, "too_big")
    contents = _listed_files(spark, sf_dir).select("folder", "name", "content", status.alias("status"))
    state = L.scan_pass(X.listing(spark, sf_dir), X.index0(spark, sf_dir), contents, _hidden(), X.DEVICE, X.NOW, ".part")
    return state.select("folder", "name", "deleted", "invalid", "sequence")


_NEXT = "(SELECT max(seq) FROM have) + row_number() OVER (ORDER BY name)"
_ACTED = f"acted AS (SELECT name, {ACTION} AS action FROM pairs)"


@query(
    f"""SELECT name, coalesce(n.deleted, h.deleted) AS deleted, coalesce(n.sequence, h.seq) AS sequence FROM have h FULL JOIN (
 SELECT a.name, true AS deleted, {_NEXT} AS sequence FROM acted a WHERE action = 'DELETE') n USING (name)""",
    *REPLICAS, _ACTED,
)
def apply_deletes(spark, sf_dir):
    """Our state after the peer's deletions."""
    have = X.replica_have(spark, sf_dir)
    return L.commit(have, L.peer_tombstones(C.classify(have, X.replica_peer(spark, sf_dir)))).select("name", "deleted", "sequence")


STATUS = "CASE h % 7 WHEN 0 THEN 'read' WHEN 1 THEN 'path' ELSE 'ok' END"


@query(
    f"""SELECT name, coalesce(n.size, h.size)::BIGINT AS size, coalesce(n.sequence, h.seq) AS sequence FROM have h FULL JOIN (
 SELECT a.name, p.size, {_NEXT} AS sequence FROM acted a JOIN peer p USING (name) WHERE action IN ('FETCH', 'CONFLICT') AND {STATUS.replace('h %', 'p.modified_s %')} = 'ok') n USING (name)""",
    *REPLICAS, _ACTED,
)
def finish_fetches(spark, sf_dir):
    """Our state after the fetches whose content was verified."""
    have, peer = X.replica_have(spark, sf_dir), X.replica_peer(spark, sf_dir)
    fetched = peer.select("folder", "name", F.expr(STATUS.replace("h %", "modified_s %")).alias("status"))
    return L.commit(have, L.finished(C.classify(have, peer), fetched)).select("name", "size", "sequence")


@query(
    f"""SELECT name, CASE WHEN name LIKE '%/e1%' THEN 'hidden' WHEN name IN (SELECT name FROM latest WHERE deleted) THEN 'gone' WHEN action = 'FETCH' THEN 'fetch'
 WHEN action = 'CONFLICT' THEN 'conflict' ELSE 'settled' END AS verdict FROM acted""",
    *REPLICAS, _ACTED, X.FEED, LATEST,
)
def reclassified_spill(spark, sf_dir):
    """All records of the peer, parked and read back."""
    gone = idx.latest(X.feed(spark, sf_dir)).where("deleted").select(F.lit("default").alias("folder"), "name")
    ignored = globs.ignored(F.col("name"), globs.parse_rules("e1*").rules)
    return L.reclassified(X.replica_peer(spark, sf_dir), X.replica_have(spark, sf_dir), gone, ignored).select("name", "verdict")


@query(
    """SELECT a.name, CASE WHEN EXISTS (SELECT 1 FROM acted b JOIN peer w ON w.name = b.name WHERE b.action = 'FETCH' AND NOT h.deleted AND w.size = h.size AND w.h = h.h) THEN 'held'
 WHEN a.action = 'DELETE' THEN 'apply' ELSE 'dropped' END AS verdict FROM acted a JOIN peer p ON p.name = a.name AND p.deleted LEFT JOIN have h ON h.name = a.name""",
    *REPLICAS, _ACTED,
)
def deferred_deletes(spark, sf_dir):
    """All deletions of the peer, judged late: held while a fetch wants the content."""
    have, peer = X.replica_have(spark, sf_dir), X.replica_peer(spark, sf_dir)
    wants = C.classify(have, peer).where("action = 'FETCH'").select("peer.size", "peer.content_hash")
    return L.deferred_deletes(peer.where("deleted"), have, wants).select("name", "verdict")


@query(
    """SELECT page_id, CASE WHEN page_id % 5 <> 0 AND page_id * 977 % 2000000 <= 1048576 AND NOT (name = '' OR regexp_matches(name, '[:\\\\]') OR regexp_matches('/' || name || '/', '//|/\\.{1,2}/'))
 AND NOT regexp_matches(name, '(^|/)[^/]*[.]html$') THEN 'OK' ELSE 'NO_SUCH_FILE' END AS code FROM page_paths""",
    X.PAGE_PATHS,
)
def served_requests(spark, sf_dir):
    """A request for each page's path."""
    p = X.page_paths(spark, sf_dir).select("page_id", "name", (F.col("page_id") % 5).cast("string").alias("folder"), (F.col("page_id") * 977 % 2_000_000).alias("size"))
    folders = spark.range(1, 5).select(F.col("id").cast("string").alias("folder"))
    return L.served(p, folders, globs.ignored(F.col("name"), globs.parse_rules("*.html").rules)).select("page_id", "code")


@query(
    """SELECT event_type AS kind, count(*) AS n, arg_min('.../e' || ((event_id // 7) % 20) || '/' || event_id, event_id) AS example FROM events GROUP BY event_type"""
)
def warning_tallies(spark, sf_dir):
    e = X.evt(spark, sf_dir)
    return L.tallies(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("at"), F.col("name").alias("prefix"), F.col("event_id").cast("string").alias("name")))


@query("SELECT 'folder' AS kind, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS n FROM customer UNION ALL SELECT 'peer', count(*) FILTER (WHERE s_suppkey % 3 <> 0) FROM supplier")
def live_counts(spark, sf_dir):
    folders = X.table(spark, sf_dir, "customer").select(F.lit("folder").alias("kind"), (F.col("c_custkey") % 4 == 0).alias("removed"))
    return L.live_counts(folders.unionByName(X.table(spark, sf_dir, "supplier").select(F.lit("peer").alias("kind"), (F.col("s_suppkey") % 3 == 0).alias("removed"))))


@query("SELECT folder, name FROM latest WHERE NOT deleted", *FEEDS, LATEST)
def present_names(spark, sf_dir):
    return L.present(X.feed(spark, sf_dir).select("folder", "name", F.col("sequence").alias("at"), (~F.col("deleted")).alias("add")))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 3 THEN 'abandoned' WHEN 1000 - o_custkey >= 120 THEN 'stalled' ELSE 'active' END AS state FROM orders"""
)
def transfer_states(spark, sf_dir):
    rows = X.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).alias("attempts"), F.col("o_custkey").alias("last_s"))
    return L.transfer_state(rows, 1000).select("o_orderkey", "state")


@query(
    """SELECT r.event_id, q.user_id AS asked FROM events r LEFT JOIN (SELECT user_id % 5 AS conn, event_id AS id, user_id FROM events WHERE event_type = 'view') q
 ON q.conn = r.user_id % 5 AND q.id = r.event_id - 1"""
)
def answered_requests(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").withColumn("conn", F.col("user_id") % 5)
    requests = e.where("event_type = 'view'").select("conn", F.col("event_id").alias("id"), "user_id")
    return L.answered(requests, e.select("conn", (F.col("event_id") - 1).alias("id"), "event_id")).select("event_id", F.col("request.user_id").alias("asked"))


@query(
    """SELECT key, i, i - min(i) OVER (PARTITION BY key ORDER BY came ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS early FROM (
 SELECT l_orderkey AS key, l_linenumber::BIGINT AS i, (l_linenumber * 5 + l_orderkey) % 7 AS came FROM lineitem)"""
)
def staged_blocks(spark, sf_dir):
    rows = X.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").cast("long").alias("i"), ((F.col("l_linenumber") * 5 + F.col("l_orderkey")) % 7).alias("at"))
    return L.in_order(rows, 4).select("key", "i", "early")


@query(
    """SELECT DISTINCT c_custkey AS session FROM customer WHERE c_nationkey + c_custkey % 3 > c_nationkey"""
)
def recycled_sessions(spark, sf_dir):
    c = X.table(spark, sf_dir, "customer")
    sessions = c.select(F.col("c_custkey").alias("session"), F.col("c_custkey").alias("folder"), F.col("c_nationkey").alias("need_gen"))
    return L.to_recycle(sessions, c.select(F.col("c_custkey").alias("folder"), (F.col("c_nationkey") + F.col("c_custkey") % 3).alias("need_gen")))
