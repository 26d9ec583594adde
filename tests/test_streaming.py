"""The streaming change feed, and queries that run on streams and tables alike."""

import datetime as dt

from replisift.schema import INDEX
from replisift.streaming import change_feed
from tests.helpers import index


def test_feed_resumes(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    subscriptions = spark.createDataFrame([("p", "f", 0), ("q", "f", 2), ("q", "g", 0)], "peer string, folder string, cursor long")
    index(spark, {"name": "a", "sequence": 1}, {"name": "b", "sequence": 3}).write.mode("append").parquet(src)

    def run():
        change_feed.start_feed(change_feed.read_changes(spark, src, INDEX), subscriptions, out, mark).awaitTermination()
        return sorted((r.peer, r.folder, r.sequence) for r in spark.read.parquet(out).collect())

    first = [("p", "f", 1), ("p", "f", 3), ("q", "f", 3)]
    assert run() == first and run() == first
    index(spark, {"name": "a", "sequence": 4}, {"folder": "g", "name": "x", "sequence": 9}).write.mode("append").parquet(src)
    assert run() == sorted([*first, ("p", "f", 4), ("q", "f", 4), ("q", "g", 9)])
    cursors = {(r.peer, r.folder): r.cursor for r in change_feed.cursors(spark.read.parquet(out)).collect()}
    assert cursors == {("p", "f"): 4, ("q", "f"): 4, ("q", "g"): 9}


def test_fan_out_leaves_changes_where_they_were_read(spark, monkeypatch):
    rows = index(spark, *({"name": f"n{k}", "sequence": k, "folder": "fg"[k % 2]} for k in range(40)))
    subscriptions = spark.createDataFrame([("p", "f", 0), ("q", "f", 20), ("q", "g", 9)], "peer string, folder string, cursor long")
    told = change_feed.fan_out(rows, subscriptions)
    assert "BroadcastHashJoin" in told._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r.peer, r.folder, r.sequence) for r in df.collect())
    want = key(rows.join(subscriptions, "folder").where("sequence > cursor"))
    assert key(told) == want and len(want) == 19 + 9 + 15
    monkeypatch.setattr(change_feed, "FEW", 2)
    many = change_feed.fan_out(rows, subscriptions)
    assert key(many) == want and sorted(many.columns) == sorted(told.columns)


def test_bursts(spark):
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 1, 1.9, 4, 10, 11.5]
    rows = spark.createDataFrame([("f", t0 + dt.timedelta(seconds=s)) for s in times], "folder string, ts timestamp")
    got = sorted((r.started - t0, r.ended - t0, r.n) for r in change_feed.bursts(rows).collect())
    assert [(a.total_seconds(), b.total_seconds(), n) for a, b, n in got] == [(0, 3.9, 3), (4, 6, 1), (10, 13.5, 2)]


def test_a_gap_of_exactly_the_quiet_time_ends_a_burst(spark):
    t0 = dt.datetime(2024, 1, 1)
    times = [0, 2, 3.999999, 5.999999]
    rows = spark.createDataFrame([("f", t0 + dt.timedelta(seconds=s)) for s in times], "folder string, ts timestamp")
    got = sorted((r.started - t0, r.ended - t0, r.n) for r in change_feed.bursts(rows).collect())
    assert [(a.total_seconds(), b.total_seconds(), n) for a, b, n in got] == [(0, 2, 1), (2, 5.999999, 2), (5.999999, 7.999999, 1)]


def test_change_bursts_with_exact_gaps_and_missing_times(spark, tmp_path):
    """The query against its SQL where gaps are of exactly two seconds, times tie, and some are missing."""
    from replisift.plans import catalogue
    from tests import oracle

    con = oracle.duckdb.connect()
    con.execute(
        f"""COPY (SELECT k AS event_id, CASE WHEN k % 50 <> 7 THEN TIMESTAMP '2024-03-10 01:50:00' + to_microseconds((k * k % 997) * 1000000) END AS ts, k % 7 AS user_id,
 'view' AS event_type, 1.0::DOUBLE AS value, '' AS props FROM range(600) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    sql = catalogue.ORACLE_SQL["change_bursts"]
    assert con.execute(f"SELECT count(*) FILTER (WHERE started IS NULL), count(*) FROM ({sql})").fetchone()[0] == 12
    assert oracle.same(catalogue.QUERIES["change_bursts"](spark, str(tmp_path)), con, sql)


def test_bursts_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """Debouncing on a stream: a burst is told once its quiet time has passed, whatever files its changes came in."""
    import random

    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    at, rows = 0.0, []
    for _ in range(200):
        at += rng.choice([0.1, 0.5, 1.5, 1.9, 2.5, 9])
        rows.append((rng.choice(["f", "g"]), t0 + dt.timedelta(seconds=at)))
    last = t0 + dt.timedelta(seconds=at + 100)
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], "folder string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.createDataFrame([("clock", last)], "folder string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    stream = spark.readStream.schema("folder string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    told = change_feed.bursts(stream, late="1 second")
    told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.folder, r.started, r.ended, r.n) for r in df.where("folder <> 'clock'").collect())
    want = key(change_feed.bursts(spark.createDataFrame(rows, "folder string, ts timestamp")))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == want and len(want) > 40


def test_wants(spark):
    events = [("f", "a", "pushed"), ("f", "b", "failed"), ("f", "b", "failed"), ("f", "b", "failed"), ("f", "c", "failed"), ("f", "c", "done")]
    got = {r.name: (r.attempts, r.state) for r in change_feed.want_states(spark.createDataFrame(events, "folder string, name string, event string")).collect()}
    assert got == {"a": (0, "waiting"), "b": (3, "stalled"), "c": (1, "done")}
