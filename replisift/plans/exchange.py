"""Queries of what goes between replicas: budgets, messages, receipts, transfers, parked records, relays, commands and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import globs, hashing
from ..operators import budgets, control, relay, status
from ..operators import classify as C
from ..operators import index as idx
from ..operators import lifecycle as L
from ..schema import INDEX
from ..session import scratch_dir
from ..sources import versions, wire
from ..streaming import receive, transfers
from . import fixtures as X
from .catalogue import FEEDS, LATEST, REPLICAS, _hex, query
from .lifecycle import _ACTED

# --- budgets


@query(
    """SELECT folder, name, batch FROM (WITH RECURSIVE o AS (SELECT folder, name, size, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM doc_files),
 r AS (SELECT folder, name, k, 0::BIGINT AS batch, 1::BIGINT AS n, size AS used FROM o WHERE k = 1
  UNION ALL SELECT o.folder, o.name, o.k, CASE WHEN n >= 64 OR used + size > 65536 THEN batch + 1 ELSE batch END, CASE WHEN n >= 64 OR used + size > 65536 THEN 1 ELSE n + 1 END,
   CASE WHEN n >= 64 OR used + size > 65536 THEN size ELSE used + size END FROM r JOIN o ON o.folder = r.folder AND o.k = r.k + 1) SELECT * FROM r)""",
    X.DOC_FILES,
)
def message_batches(spark, sf_dir):
    """Each folder's files in messages of at most 64 records and 64 KiB of content."""
    return budgets.message_batches(X.doc_files(spark, sf_dir), ["folder"], ["name"], "size", 64, 65536)


@query(
    """SELECT session, push_no FROM (WITH RECURSIVE o AS (SELECT dev AS session, sequence AS push_no, sequence * 37 % 101 AS n, row_number() OVER (PARTITION BY dev ORDER BY sequence) AS k FROM feed),
 r AS (SELECT session, push_no, k, n <= 2048 AS takes, CASE WHEN n <= 2048 THEN 2048 - n ELSE 2048 END AS rest FROM o WHERE k = 1
  UNION ALL SELECT o.session, o.push_no, o.k, n <= rest, CASE WHEN n <= rest THEN rest - n ELSE rest END FROM r JOIN o ON o.session = r.session AND o.k = r.k + 1) SELECT * FROM r WHERE takes)""",
    *FEEDS,
)
def fitting_wants(spark, sf_dir):
    """The wants of each session that its pool of 2,048 blocks takes, in order; one that doesn't fit takes nothing."""
    w = X.feed(spark, sf_dir).select(F.map_keys("version")[0].cast("long").alias("session"), F.col("sequence").alias("push_no"), (F.col("sequence") * 37 % 101).alias("n_blocks"))
    return budgets.fitting_wants(w, ["session"], ["push_no"], "n_blocks", most=None)


# --- messages


@query("SELECT folder, name, type, size, sequence, deleted, invalid, blocks FROM index0", X.DOC_FILES, X.INDEX0)
def wire_streams(spark, sf_dir):
    """The whole index as messages by count and bytes, in compressed frames, and read back from the frames."""
    own = X.index0(spark, sf_dir)
    sized = own.select("folder", "name", (F.octet_length("name") + 40 * F.size("block_hashes") + 60).alias("bytes"))
    framed = wire.encode_streams(own, budgets.message_batches(sized, ["folder"], ["name"], "bytes"))
    rows = wire.decode_streams(framed.select(F.concat_ws("/", "folder", F.col("batch").cast("string")).alias("stream"), F.col("frame").alias("data")))
    return rows.select(F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault"))).otherwise(F.col("record")).alias("r")).select(
        "r.folder", "r.name", "r.type", "r.size", "r.sequence", "r.deleted", "r.invalid", F.size("r.block_hashes").alias("blocks")
    )


@query("SELECT doc_id, size, h, CASE WHEN size >= 2000 THEN true END AS smaller FROM doc_files", X.DOC_FILES)
def compressed_contents(spark, sf_dir):
    """Contents compressed and restored; those of some length must shrink."""
    rows = X.doc_files(spark, sf_dir).select("doc_id", "size", wire.compressed(F.col("content")).alias("packed")).withColumn("back", wire.decompressed(F.col("packed")))
    smaller = F.when(F.col("size") >= 2000, F.octet_length("packed") < F.col("size"))
    return rows.select("doc_id", F.octet_length("back").cast("long").alias("size"), _hex(hashing.sha256(F.col("back"))).alias("h"), smaller.alias("smaller"))


@query("SELECT event_id, user_id % 3 AS folder_no, name, seq * 4096 AS \"offset\", length(content)::INTEGER AS size, CASE WHEN event_type = 'error' THEN NULL ELSE sha256(content) END AS h FROM evt", X.EVT)
def wire_requests(spark, sf_dir):
    """A block request for each event, as a message and back."""
    e = X.evt(spark, sf_dir)
    request = F.struct(
        F.col("event_id").cast("int").alias("id"), (F.col("user_id") % 3).cast("string").alias("folder"), "name", (F.col("seq") * 4096).alias("offset"), F.length("content").alias("size"),
        F.when(F.col("event_type") != "error", hashing.sha256(F.encode("content", "UTF-8"))).alias("hash"), F.lit(False).alias("from_temporary"),
    )
    back = e.select("event_id", wire.requests(wire.request_bytes(request)).alias("r"))
    return back.select("event_id", F.col("r.folder").cast("long").alias("folder_no"), "r.name", "r.offset", "r.size", _hex("r.hash").alias("h"))


# --- receipts


@query(
    "SELECT folder, name, n, size AS bytes FROM (SELECT folder, name, size, greatest(1, ceil(size / 4096))::BIGINT AS n, doc_id FROM doc_files) WHERE doc_id % 7 <> 0 OR doc_id % 2 = 0",
    X.DOC_FILES,
)
def received_files(spark, sf_dir):
    """All documents' blocks as a stream of two batches: the first block of some is damaged, and sent again for half of these.  Whole files are promoted."""
    f = X.doc_files(spark, sf_dir).withColumn("block_size", F.lit(4096))
    hashes = hashing.block_hashes(F.col("content"), F.col("block_size"))
    files = f.select("folder", "name", "doc_id", "size", "block_size", "content", hashes.alias("block_hashes")).withColumn("content_hash", hashing.content_hash(F.col("block_hashes")))
    blocks = files.select("folder", "name", "doc_id", "content", F.posexplode("block_hashes").alias("i", "h"))
    blocks = blocks.select("folder", "name", "doc_id", F.col("i").cast("long").alias("i"), F.expr("substring(content, i * 4096 + 1, 4096)").alias("data"))
    damaged = (F.col("i") == 0) & (F.col("doc_id") % 7 == 0)
    where = scratch_dir(spark, "receive")
    first = blocks.withColumn("data", F.when(damaged, F.concat("data", F.lit(b"?"))).otherwise(F.col("data")))
    again = blocks.where(damaged & (F.col("doc_id") % 2 == 0))
    sink = receive.StagedSink(receive.promised(files), f"{where}/sink")
    # Each run of the stream takes all files that came since the last one as one batch, however many tasks wrote them.
    for sent in (first, again):
        sent.select("folder", "name", "i", "data").write.mode("append").parquet(f"{where}/in")
        sink.start(spark.readStream.schema(receive.BLOCKS).parquet(f"{where}/in"), f"{where}/state").awaitTermination()
    return sink.files().select("folder", "name", "n", "bytes")


#: A user's events as those of one transfer of three blocks.
_EVENT = "CASE event_type WHEN 'signup' THEN 'want' WHEN 'error' THEN 'bad' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'refused' ELSE 'good' END ELSE 'good' END"
_QUIET, _UNTIL = 72_000_000_000, 1_709_000_000_000_000
_FAIL = "phase = 1 AND (e = 'refused' OR (e = 'bad' AND NOT held AND CASE i WHEN 0 THEN t0 WHEN 1 THEN t1 ELSE t2 END = 3))"
_TRIES = ", ".join(
    f"CASE WHEN phase <> 1 AND e = 'want' OR {_FAIL} THEN 0 WHEN phase = 1 AND i = {k} AND NOT held AND e = 'good' THEN 0 WHEN phase = 1 AND i = {k} AND NOT held AND e = 'bad' THEN t{k} + 1 ELSE t{k} END" for k in range(3)
)
_TRANSFERS = f"""WITH RECURSIVE ev AS (SELECT user_id, k, t, e, i, (1 << i)::INTEGER AS bit FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, epoch_us(ts) AS t, {_EVENT} AS e, (event_id % 3)::INTEGER AS i FROM events
  UNION ALL SELECT user_id, count(*) + 1, {_UNTIL}, 'end', 0 FROM events GROUP BY user_id)),
 r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, 0 AS phase, 0 AS a, 0::BIGINT AS last, 0 AS there, 0 AS t0, 0 AS t1, 0 AS t2, 0 AS started, 0 AS again, 0 AS retried, 0 AS stalled, 0 AS done FROM events
  UNION ALL SELECT user_id, k,
   CASE WHEN phase <> 1 AND e = 'want' THEN 1 WHEN {_FAIL} AND a = 3 THEN 2 WHEN phase = 1 AND e = 'good' AND (there | bit) = 7 THEN 3 ELSE phase END,
   CASE WHEN phase <> 1 AND e = 'want' THEN 1 WHEN {_FAIL} AND a < 3 THEN a + 1 ELSE a END,
   CASE WHEN phase <> 1 AND e = 'want' OR phase = 1 AND e = 'good' AND NOT held OR {_FAIL} AND a < 3 THEN t ELSE last END,
   CASE WHEN phase <> 1 AND e = 'want' THEN CASE WHEN phase = 2 THEN there ELSE 0 END WHEN phase = 1 AND e = 'good' THEN there | bit ELSE there END, {_TRIES},
   started + (phase <> 1 AND e = 'want')::INTEGER, again + (phase = 1 AND e = 'bad' AND NOT held AND NOT ({_FAIL}))::INTEGER, retried + ({_FAIL} AND a < 3)::INTEGER, stalled + ({_FAIL} AND a = 3)::INTEGER,
   done + (phase = 1 AND e = 'good' AND (there | bit) = 7)::INTEGER FROM (
   SELECT user_id, k, t, e, i, bit, CASE WHEN f > 3 - a THEN 2 ELSE phase END AS phase, CASE WHEN f > 0 THEN least(3, a + f) ELSE a END AS a, last + {_QUIET} * least(f, 3 - a) AS last, there, (there & bit) <> 0 AS held,
    CASE WHEN f > 0 THEN 0 ELSE t0 END AS t0, CASE WHEN f > 0 THEN 0 ELSE t1 END AS t1, CASE WHEN f > 0 THEN 0 ELSE t2 END AS t2,
    started, again, retried + least(f, 3 - a) AS retried, stalled + (f > 3 - a)::INTEGER AS stalled, done FROM (
     SELECT r.*, ev.k AS k, t, e, i, bit, CASE WHEN phase = 1 THEN ((t - last - 1) // {_QUIET})::INTEGER ELSE 0 END AS f FROM (SELECT * EXCLUDE (k), k AS before FROM r) r JOIN ev ON ev.user_id = r.user_id AND ev.k = before + 1)))
SELECT user_id, started::BIGINT AS started, again::BIGINT AS again, retried::BIGINT AS retried, stalled::BIGINT AS stalled, done::BIGINT AS done FROM r JOIN ev USING (user_id, k) WHERE e = 'end'"""


@query(_TRANSFERS)
def transfer_steps(spark, sf_dir):
    """Each user's events as those of a transfer: how often it was started, a block asked for again, retried, stalled and done."""
    e = X.table(spark, sf_dir, "events")
    kind = F.expr(_EVENT)
    events = e.select(
        F.col("user_id").cast("string").alias("session"), F.lit("f").alias("folder"), F.lit("x").alias("name"), F.timestamp_micros(X._micros("ts")).alias("at"),
        F.when(kind.isin("good", "bad"), "block").otherwise(kind).alias("event"), F.lit(3).cast("long").alias("n_blocks"), (F.col("event_id") % 3).alias("i"), (kind == "good").alias("good"),
    )
    log = transfers.replay(events, _UNTIL, _QUIET // transfers.MICROS)
    steps = [F.count_if(F.col("step") == s).alias(s) for s in ("started", "again", "retried", "stalled", "done")]
    told = log.groupBy(F.col("session").cast("long").alias("user_id")).agg(*steps)
    return e.select("user_id").distinct().join(told, "user_id", "left").na.fill(0)


# --- parked records, versions, relays


@query(
    """SELECT name, CASE WHEN name LIKE '%/e1%' THEN 'hidden' WHEN name IN (SELECT name FROM latest WHERE deleted) THEN 'gone' WHEN action = 'FETCH' THEN 'fetch'
 WHEN action = 'CONFLICT' THEN 'conflict' ELSE 'settled' END AS verdict FROM acted""",
    *REPLICAS, _ACTED, X.FEED, LATEST,
)
def drained_records(spark, sf_dir):
    """All records of the peer, parked in a durable queue, read back in two portions and judged then."""
    where = scratch_dir(spark, "queue")
    queue, out = versions.DurableQueue(spark, f"{where}/queue"), versions.VersionedTable(spark, f"{where}/out")
    n = queue.push(X.replica_peer(spark, sf_dir), ["name"])
    have, gone = X.replica_have(spark, sf_dir), idx.latest(X.feed(spark, sf_dir)).where("deleted").select(F.lit("default").alias("folder"), "name")
    ignored = globs.ignored(F.col("name"), globs.parse_rules("e1*").rules)
    queue.drain(n // 2 + 1, lambda rows, token: out.append(L.reclassified(rows.drop("__number"), have, gone, ignored).select("name", "verdict"), token))
    return out.read()


@query(
    "SELECT folder, name, deleted, sequence FROM latest WHERE NOT (deleted AND modified_s < 1704067200 + 15 * 86400)",
    *FEEDS, LATEST,
)
def versioned_index(spark, sf_dir):
    """An index saved in three versions: records of odd sequences, then all of the feed, then a version that changes nothing."""
    table, feed = versions.VersionedTable(spark, f"{scratch_dir(spark, 'versions')}/index"), X.feed(spark, sf_dir)
    now = 1_704_067_200 + 30 * 86_400
    versions.save_index(table, lambda _: idx.latest(feed.where("sequence % 2 = 1")), now, keep_days=0)
    versions.save_index(table, lambda old: idx.upsert(old, feed), now, keep_days=15)
    versions.save_index(table, lambda old: old, now, keep_days=15)
    table.forget_old(1)
    return table.read().select("folder", "name", "deleted", "sequence")


@query(
    "SELECT name, row_number() OVER (ORDER BY name) AS sequence, size::BIGINT AS size, h FROM have WHERE NOT deleted", X.EVT, X.HAVE
)
def relayed_records(spark, sf_dir):
    """Our records as a third replica has them, which hears of them from a second one only."""
    none = spark.createDataFrame([], INDEX)
    states, _ = relay.relay({"a": X.replica_have(spark, sf_dir), "b": none, "c": none}, [("a", "b"), ("b", "c")], {"a": "1", "b": "8", "c": "9"}, X.NOW)
    return states["c"].select("name", "sequence", "size", _hex("content_hash").alias("h"))


# --- commands and the report

_LINE = """CASE event_type WHEN 'signup' THEN 'ADDFOLDER f' || (user_id % 40) || ' Work:p' || event_id || CASE event_id % 5 WHEN 0 THEN ' ReceiveOnly' WHEN 1 THEN ' sendonly' WHEN 2 THEN ' wrong' ELSE '' END
 WHEN 'error' THEN 'removefolder f' || (user_id % 40) WHEN 'click' THEN 'LOGLEVEL ' || CASE event_id % 4 WHEN 0 THEN 'loud' WHEN 1 THEN 'debug' ELSE 'error' END WHEN 'purchase' THEN 'RESCAN' ELSE '' END"""
LINES = f"lines AS (SELECT event_id, event_type, user_id % 40 AS f, event_id % 5 = 2 AS wrong, {_LINE} AS line FROM events)"


def _log(spark, sf_dir):
    return X.table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), F.expr(_LINE).alias("line"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'signup' THEN CASE WHEN wrong THEN 'error' WHEN before THEN 'already configured' ELSE 'added' END
 WHEN event_type = 'error' THEN CASE WHEN before THEN 'removed' ELSE 'unknown folder' END WHEN event_type = 'view' OR line LIKE '%loud' THEN 'error' ELSE 'ok' END AS reply
 FROM lines LEFT JOIN (SELECT event_id, lag(event_type = 'signup') OVER (PARTITION BY f ORDER BY event_id) AS before FROM lines WHERE event_type = 'error' OR event_type = 'signup' AND NOT wrong) USING (event_id)""",
    LINES,
)
def command_replies(spark, sf_dir):
    """Each event as a command, and what it is told."""
    return control.replies(_log(spark, sf_dir)).select(F.col("at").alias("event_id"), "reply")


@query(
    """SELECT 'f' || f AS folder, 'Work:p' || min(event_id) AS path, arg_min(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END, event_id) AS mode FROM lines
 LEFT JOIN (SELECT f, max(event_id) AS gone FROM lines WHERE event_type = 'error' GROUP BY f) USING (f) WHERE event_type = 'signup' AND NOT wrong AND event_id > coalesce(gone, -1) GROUP BY f""",
    LINES,
)
def command_folders(spark, sf_dir):
    """The folders that the commands lead to, from the states of two halves of the log."""
    log = _log(spark, sf_dir)
    half = log.agg(F.max("at")).first()[0] // 2
    state = control.composed(control.state_of(log.where(F.col("at") <= half)), control.state_of(log.where(F.col("at") > half)))
    return control.folders(state)


_REPORT_NOW = 1_706_800_000
@query(
    """SELECT folder, max(pending) AS pending, max(kept) AS kept, sum(reverted)::BIGINT AS reverted FROM (SELECT peer, folder, count(*) FILTER (WHERE kind IN ('queued', 'active', 'stalled', 'parked')) AS pending,
 count(*) FILTER (WHERE kind = 'kept') AS kept, count(*) FILTER (WHERE kind = 'reverted') AS reverted FROM (
 SELECT dev AS peer, folder, 'queued' AS kind FROM feed WHERE NOT deleted AND NOT invalid UNION ALL SELECT dev, folder, 'kept' FROM feed WHERE deleted UNION ALL SELECT dev, folder, 'reverted' FROM feed WHERE invalid
 UNION ALL SELECT peer, folder, 'parked' FROM peer_sessions WHERE kind = 'parked' UNION ALL SELECT peer, folder, 'stalled' FROM peer_sessions WHERE kind = 'stalled') GROUP BY peer, folder) GROUP BY folder""",
    *FEEDS, X.PEER_SESSIONS,
)
def gathered_backlog(spark, sf_dir):
    """The backlog of a feed's wants and of what sessions parked or gave up, from a list each."""
    f = X.feed(spark, sf_dir).withColumn("peer", F.map_keys("version")[0].cast("long"))
    s = X.peer_sessions(spark, sf_dir)
    items = status.gathered(queued=f.where("NOT deleted AND NOT invalid"), kept=f.where("deleted"), reverted=f.where("invalid"), parked=s.where("kind = 'parked'"), stalled=s.where("kind = 'stalled'"))
    return status.backlog(items)


_SIZE = """CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1 << 20 THEN (b >> 10) || '.' || ((b & 1023) * 10 // 1024) || ' KB' ELSE (b >> 20) || '.' || (((b >> 10) & 1023) * 10 // 1024) || ' MB' END"""



@query(
    f"""SELECT 1 AS section, '' AS key, -1 AS place, 'Folders (' || count(*) || ')' AS line FROM told UNION ALL SELECT 2, '', -1, 'Remote devices (0)'
 UNION ALL SELECT 1, folder, unnest(range(len(list_filter(ls, lambda x: x IS NOT NULL))))::INTEGER, unnest(list_filter(ls, lambda x: x IS NOT NULL)) FROM (SELECT folder, [folder || '  Work:' || folder || '  ' || ['sendreceive', 'sendonly', 'receiveonly'][folder[2:]::INTEGER + 1],
  '  ' || files || ' file' || CASE files WHEN 1 THEN '' ELSE 's' END || ', 0 dirs, ' || {_SIZE} || ' - ' || CASE WHEN folder = 'f1' THEN 'not scanned yet' ELSE 'scanned ' || CASE WHEN m < 60 THEN m || 'm' WHEN m < 1440 THEN (m // 60) || 'h ' || (m % 60) || 'm' ELSE (m // 1440) || 'd ' || (m % 1440 // 60) || 'h' END || ' ago' END,
  CASE WHEN reverted > 0 THEN '  ' || reverted || ' local edit' || CASE reverted WHEN 1 THEN '' ELSE 's' END || ' replaced by a peer''s copy' END,
  CASE WHEN kept > 0 THEN '  ' || kept || ' file' || CASE kept WHEN 1 THEN '' ELSE 's' END || ' kept against a peer''s deletion' END, '  latest change: ' || verb || ' ' || name] AS ls FROM told)""",
    *FEEDS, LATEST, X.PEER_SESSIONS,
    "totals AS (SELECT folder, count(*) FILTER (WHERE NOT deleted) AS files, coalesce(sum(size) FILTER (WHERE NOT deleted), 0)::BIGINT AS b FROM latest GROUP BY folder)",
    f"scanned AS (SELECT folder, {_REPORT_NOW} // 60 - max(modified_s) // 60 AS m FROM feed GROUP BY folder)",
    "behind AS (SELECT folder, max(kept) AS kept, sum(reverted)::BIGINT AS reverted FROM (SELECT peer, folder, count(*) FILTER (WHERE kind = 'kept') AS kept, count(*) FILTER (WHERE kind = 'reverted') AS reverted FROM peer_sessions GROUP BY peer, folder) GROUP BY folder)",
    """change AS (SELECT l.folder, CASE WHEN l.deleted THEN 'deleted' WHEN l.sequence = f.first THEN 'added' ELSE 'updated' END AS verb, l.name
 FROM (SELECT folder, max(sequence) AS sequence FROM feed WHERE NOT invalid GROUP BY folder) m JOIN feed l USING (folder, sequence)
 JOIN (SELECT folder, name, min(sequence) AS first FROM feed GROUP BY folder, name) f ON f.folder = l.folder AND f.name = l.name)""",
    "told AS (SELECT * FROM totals JOIN scanned USING (folder) JOIN behind USING (folder) JOIN change USING (folder))",
)
def status_report(spark, sf_dir):
    """The report on the feed's folders, without peers."""
    feed, n = X.feed(spark, sf_dir), F.substring("folder", 2, 9).cast("int")
    folders = feed.groupBy("folder").agg(F.max("modified_s").alias("last")).select("folder", F.lit("").alias("label"), F.concat(F.lit("Work:"), "folder").alias("path"), n.alias("mode"), "last")
    scans = folders.select("folder", F.when(F.col("folder") != "f1", F.col("last")).alias("scanned_s"))
    lines = control.folder_lines(folders.drop("last"), idx.latest(feed), scans, X.peer_sessions(spark, sf_dir), feed, _REPORT_NOW)
    nobody = X.table(spark, sf_dir, "nation").where("false").select(F.lit("").alias("device"), F.lit(0).alias("place"), F.lit("").alias("line"))
    return control.report(lines, nobody)
