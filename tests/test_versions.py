"""Versions: one writer wins, readers see whole versions; the durable queue; the staged sink."""

import hashlib

import pytest
from pyspark.sql import functions as F

from replisift.functions import hashing
from replisift.plans import fixtures as X
from replisift.sources import versions as V
from replisift.streaming import receive as R
from tests.helpers import index

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_two_writers(spark, tmp_path):
    table = V.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None and table.versions() == []
    table.replace(lambda old: spark.range(3))
    seen = table.read()

    def slow(old):
        # another writer commits between reading and committing, the first two times
        if len(tries) < 2:
            tries.append(1)
            V.VersionedTable(spark, f"file://{tmp_path}/t").replace(lambda o: o.union(spark.range(10 * len(tries), 10 * len(tries) + 1)))
        return old.where("id <> 1")

    tries = []
    assert table.replace(slow).number == 3
    assert ids(table.read()) == [0, 2, 10, 20] and ids(table.read(1)) == [0, 1, 2, 10] and ids(seen) == [0, 1, 2]
    with pytest.raises(V.Conflict):
        table.replace(lambda old: (V.VersionedTable(spark, f"file://{tmp_path}/t").append(spark.range(1)), old)[1], attempts=3)
    # a writer that is lost after its data, before its entry, leaves nothing to be seen
    table._written(spark.range(99))
    assert len(ids(table.read())) == 4 + 3 and table.versions() == list(range(7))
    assert table.forget_old(2) == 5 and table.versions() == [5, 6] and len(ids(table.read())) == 7
    assert not table._put(6, "{}") and table._put(7, '{"number": 7, "folders": [], "schema": "{\\"type\\":\\"struct\\",\\"fields\\":[]}"}')


def test_batches_are_committed_once(spark, tmp_path):
    table = V.VersionedTable(spark, f"file://{tmp_path}/t")
    for number in (0, 1, 1, 0, 2):
        table.append(spark.range(number, number + 1), ("s", number))
    table.replace(lambda old: old.where("false"), ("s", 1))
    assert ids(table.read()) == [0, 1, 2]
    table.append(spark.range(7, 8), ("other", 0))
    assert ids(table.read()) == [0, 1, 2, 7]


def test_index_versions_are_pruned_first(spark, tmp_path):
    table = V.VersionedTable(spark, f"file://{tmp_path}/t")
    old = {"name": "dead", "deleted": True, "modified_s": 0, "sequence": 2}
    V.save_index(table, lambda _: index(spark, {"name": "a"}, old), now_s=200 * 86400, short_id="7")
    assert [r.name for r in table.read().collect()] == ["a"] and table.entry().notes["short_id"] == "7"
    V.save_index(table, lambda now: now.unionByName(index(spark, {"name": "b", "sequence": 3}, old)), now_s=200 * 86400, keep_days=0)
    assert sorted(r.name for r in table.read().collect()) == ["a", "b", "dead"]


def test_queue_gives_each_row_once(spark, tmp_path):
    queue = V.DurableQueue(spark, f"file://{tmp_path}/q")
    assert queue.size() == 0 and queue.drain(5, lambda rows, token: None) == 0
    assert queue.push(spark.range(7).withColumn("k", F.col("id") * 2), ["id"], ("in", 0)) == 7
    assert queue.push(spark.range(7).withColumn("k", F.lit(0)), ["id"], ("in", 0)) == 0 and queue.push(spark.range(0), ["id"]) == 0
    out = V.VersionedTable(spark, f"file://{tmp_path}/out")
    rows, start, to = queue.peek(3)
    assert [r.id for r in rows.orderBy("__number").collect()] == [0, 1, 2] and (start, to) == (0, 3)
    out.append(rows.drop("__number"), queue.token(start))  # lost here, before the head moves
    again = V.DurableQueue(spark, f"file://{tmp_path}/q")
    again.push(spark.range(10, 14).withColumn("k", F.lit(1)), ["id"])
    parked = []

    def work(rows, token):
        out.append(rows.drop("__number"), token)
        if not parked:  # a row that is parked again waits behind
            parked.append(again.push(spark.range(99, 100).withColumn("k", F.lit(9)), ["id"]))

    assert again.drain(3, work) == 11 and again.size() == 1
    assert ids(out.read().select("id")) == [0, 1, 2, 3, 4, 5, 6, 10, 11, 12, 13]
    assert not again.done(0, 5) and again.drain(9, work) == 1 and again.size() == 0
    assert again.table.entry().folders == [] or len(again.table.entry().folders) == 0
    again.push(spark.range(1).withColumn("k", F.lit(5)), ["id"])
    assert [r.k for r in again.peek(9)[0].collect()] == [5]


def wanted(spark, files, block=4):
    rows = []
    for name, data in files.items():
        blocks = [data[k : k + block] for k in range(0, len(data), block)] or [b""]
        hashes = [bytearray(hashlib.sha256(b).digest()) for b in blocks]
        rows.append({"name": name, "size": len(data), "block_size": block, "block_hashes": hashes, "content_hash": bytearray(hashlib.sha256(b"".join(map(bytes, hashes))).digest())})
    return R.promised(index(spark, *rows))


def blocks(spark, *rows):
    return spark.createDataFrame([("f", n, i, bytearray(d)) for n, i, d in rows], R.BLOCKS)


def test_sink_promotes_whole_files_and_replays_change_nothing(spark, tmp_path):
    files = {"a": b"abcdefghij", "b": b"wxyz", "none": b"", "late": b"12345678"}
    sink = R.StagedSink(wanted(spark, files), f"file://{tmp_path}/sink")
    batches = [
        blocks(spark, ("a", 0, b"abcd"), ("a", 2, b"ij"), ("b", 0, b"WXYZ"), ("none", 0, b""), ("late", 1, b"5678"), ("unknown", 0, b"x"), ("b", 7, b"x")),
        blocks(spark, ("a", 0, b"abcd"), ("b", 0, b"wxyz"), ("b", 0, b"wxy")),
        blocks(spark, ("a", 1, b"efgh"), ("none", 0, b"")),
    ]
    names = []
    for k, batch in enumerate(batches):
        sink.take(batch, k)
        names.append({r.name for r in sink.files().collect()})
        if k == 1:
            assert {(r.name, r.i) for r in sink.missing().collect()} == {("a", 1), ("late", 0)}
        for number in range(k + 1):
            sink.take(batches[number], number)
    assert names == [{"none"}, {"none", "b"}, {"none", "b", "a"}]
    got = {}
    for r in sink.contents.read().orderBy("name", "i").collect():
        got[r.name] = got.get(r.name, b"") + bytes(r.data)
    assert got == {k: files[k] for k in ("a", "b", "none")}
    assert {(r.name, r.i, r.batch) for r in sink.again.read().collect()} == {("b", 0, 0), ("b", 0, 1)}
    assert {r.name for r in sink.staged.read().collect()} == {"late"}


def test_sink_that_breaks_off_goes_on(spark, tmp_path, monkeypatch):
    """A batch that is lost between its steps is whole after it is taken again."""
    sink = R.StagedSink(wanted(spark, {"a": b"abcdefgh"}), f"file://{tmp_path}/sink")
    append = sink.contents.append
    monkeypatch.setattr(sink.contents, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sink.take(blocks(spark, ("a", 0, b"abcd"), ("a", 1, b"efgh")), 0)
    assert sink.contents.read() is None
    monkeypatch.setattr(sink.contents, "append", append)
    sink.take(blocks(spark, ("a", 0, b"abcd"), ("a", 1, b"efgh")), 0)
    assert [r.name for r in sink.files().collect()] == ["a"] and sink.staged.read().count() == 0


def test_a_push_is_read_where_it_lies(spark, tmp_path):
    """The rows of one push aren't gathered by its key."""
    queue = V.DurableQueue(spark, f"file://{tmp_path}/q")
    queue.push(spark.range(100).selectExpr("id AS name"), ["name"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that nothing is sent for its size alone
    try:
        rows, start, to = queue.peek(60)
        assert (start, to, rows.count()) == (0, 60, 60) and "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_are_written_by_many_tasks(spark, monkeypatch):
    """The blocks that are sent aren't written by one task."""
    from pyspark.sql.classic.dataframe import DataFrame

    from replisift.plans import exchange

    monkeypatch.setattr(DataFrame, "coalesce", lambda *a: (_ for _ in ()).throw(AssertionError("one task has all blocks")))
    assert exchange.received_files(spark, "/root/testdata/sf0.001").count() > 100
