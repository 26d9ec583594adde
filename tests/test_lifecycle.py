"""Operators that change state: scan passes, deletions, fetches, queues, and convergence of two replicas."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from replisift.operators import classify as C
from replisift.operators import index as idx
from replisift.operators import lifecycle as L
from replisift.operators import rename
from replisift.schema import INDEX, RECEIVE_ONLY, conform

NOW = 1000
LISTING = "folder string, name string, size long, modified_s long, is_dir boolean"


def records(spark, rows):
    """(name, size, modified_s, sequence, version, content or None if deleted) in folder f, as an index."""
    out = []
    for name, size, s, seq, v, content in rows:
        h = content.encode() if content is not None else None
        out.append(("f", name, 0, size, 420, s, 0, None, seq, 131072, {k: Decimal(x) for k, x in v.items()}, bytearray(h) if h is not None else None, content is None, False, [bytearray(h)] if h is not None else []))
    return conform(spark.createDataFrame(out, INDEX))


def keyed(df):
    return {r.name: r for r in df.collect()}


def scan_inputs(spark):
    index = records(spark, [("same", 1, 5, 1, {"2": 1}, "a"), ("changed", 1, 5, 2, {"2": 2}, "b"), ("gone", 1, 5, 3, {"2": 3}, "c"), ("hidden", 1, 5, 4, {"2": 4}, "d"), ("dead", 0, 5, 5, {"2": 5}, None)])
    listing = [("f", "same", 1, 5, False), ("f", "changed", 3, 6, False), ("f", "new", 2, 7, False), ("f", "dir", 0, 7, True), ("f", "hidden", 1, 5, False), ("f", "lost", 2, 7, False), ("f", "moving", 2, 7, False)]
    contents = [("f", "changed", b"xyz", None), ("f", "new", b"no", None), ("f", "lost", None, "vanished"), ("f", "moving", b"grown", None)]
    contents = spark.createDataFrame([(a, b, bytearray(c) if c is not None else None, d) for a, b, c, d in contents], "folder string, name string, content binary, status string")
    return spark.createDataFrame(listing, LISTING), index, contents


def test_scan_pass(spark):
    listing, index, contents = scan_inputs(spark)
    after = L.scan_pass(listing, index, contents, F.col("name") == "hidden", "1", NOW, ".part")
    got = keyed(after)
    assert set(got) == {"same", "changed", "gone", "hidden", "dead", "new", "dir"}
    numbered = sorted((r.sequence, n) for n, r in got.items() if r.sequence > 5)
    assert numbered == [(6, "changed"), (7, "dir"), (8, "gone"), (9, "hidden"), (10, "new")]
    assert got["gone"].deleted and got["gone"].version == {"2": 3, "1": NOW} and got["hidden"].invalid and not got["hidden"].deleted
    assert got["changed"].size == 3 and got["changed"].version == {"2": 2, "1": NOW} and got["same"].sequence == 1
    assert [r.folder for r in L.advanced(index, after).collect()] == ["f"] and L.advanced(index, index).count() == 0
    part = keyed(L.scan_pass(listing, index, contents, F.lit(False), "1", NOW, ".part", complete=False))
    assert not part["gone"].deleted and part["changed"].sequence == 6


def test_what_vanished_during_the_walk_is_swept(spark):
    """A live record whose file was listed and then gone gets a tombstone; one that couldn't be read keeps its record."""
    index = records(spark, [(n, 1, 5, k + 1, {"2": k + 1}, n) for k, n in enumerate(["lost", "locked", "large", "growing", "fresh.tmp"])] + [("was", 0, 5, 9, {"2": 9}, None)])
    names = ["lost", "locked", "large", "growing", "was", "never", "fresh.tmp", "staged.part"]
    listing = spark.createDataFrame([("f", n, 2, 6, False) for n in names], LISTING)
    rows = [("lost", None, "vanished"), ("locked", None, "unreadable"), ("large", None, "too_big"), ("growing", b"abc", None), ("was", None, "vanished"), ("never", None, "vanished"), ("fresh.tmp", b"ab", None)]
    contents = spark.createDataFrame([("f", n, bytearray(c) if c else None, s) for n, c, s in rows], "folder string, name string, content binary, status string")
    got = keyed(L.scan_pass(listing, index, contents, F.lit(False), "1", NOW, ".part"))
    assert got["lost"].deleted and got["lost"].version == {"2": 1, "1": NOW} and got["lost"].block_hashes == []
    assert [got[n].sequence for n in ("locked", "large", "growing")] == [2, 3, 4] and not any(got[n].deleted for n in ("locked", "large", "growing"))
    assert got["was"].sequence == 9 and "never" not in got and "staged.part" not in got
    assert not got["fresh.tmp"].deleted and got["fresh.tmp"].size == 2  # only the receiver's own suffix hides a file
    part = keyed(L.scan_pass(listing, index, contents, F.lit(False), "1", NOW, ".part", complete=False))
    assert not part["lost"].deleted and part["fresh.tmp"].size == 2
    huge = listing.withColumn("size", F.when(F.col("name") == "lost", 2048 * (16 << 20) + 1).otherwise(F.col("size")))
    assert not keyed(L.scan_pass(huge, index, contents, F.lit(False), "1", NOW, ".part"))["lost"].deleted  # never opened, so never found to be gone


def test_scan_pass_of_a_mirror(spark):
    listing, index, contents = scan_inputs(spark)
    got = keyed(L.scan_pass(listing, index, contents, F.lit(False), "1", NOW, ".part", RECEIVE_ONLY))
    # what changed or is missing here is forgotten, not deleted; nothing of ours is added but directories
    assert set(got) == {"same", "hidden", "dead", "dir"} and not got["hidden"].deleted
    part = keyed(L.scan_pass(listing, index, contents, F.lit(False), "1", NOW, ".part", RECEIVE_ONLY, complete=False))
    assert set(part) == {"same", "hidden", "dead", "dir", "gone"}


def test_what_could_not_be_deleted_gets_no_tombstone(spark):
    have = records(spark, [("a", 1, 5, 1, {"2": 1}, "a"), ("b", 1, 5, 2, {"2": 2}, "b")])
    peer = records(spark, [("a", 0, 9, 7, {"2": 9}, None), ("b", 0, 9, 8, {"2": 9}, None)])
    undeleted = have.where("name = 'b'")
    got = keyed(L.commit(have, L.peer_tombstones(C.classify(have, peer), undeleted)))
    assert got["a"].deleted and got["a"].version == {"2": 9} and got["a"].sequence == 3
    assert not got["b"].deleted and got["b"].sequence == 2


def test_fetch_outcomes(spark):
    rows = spark.createDataFrame([("ok",), ("read",), ("rename",), ("path",), ("size",)], "s string")
    assert {r.s: r.o for r in rows.select("s", L.fetch_outcome(F.col("s")).alias("o")).collect()} == {"ok": "done", "read": "retry", "rename": "drop", "path": "drop", "size": "retry"}


def taken(wants, most, most_blocks):
    out, state = set(), {}
    for session, no, n in sorted(wants):
        count, used = state.get(session, (0, 0))
        if (most is None or count < most) and (most_blocks is None or used + n <= most_blocks):
            out.add((session, no))
            state[session] = count + 1, used + n
    return out


def test_refused_wants_take_nothing(spark):
    rng = random.Random(1)
    wants = [("s", 1, 5), ("s", 2, 100), ("s", 3, 5)] + [(f"t{k % 3}", k, rng.randrange(40)) for k in range(10, 600)]
    df = spark.createDataFrame([(*w, 0) for w in wants], "session string, push_no long, n_blocks long, attempts int").repartition(4)
    for most, blocks in [(None, 20), (3, 400), (50, 400), (None, None), (7, None)]:
        rows = rename.want_queue(df, most, blocks).collect()
        assert {(r.session, r.push_no) for r in rows} == taken(wants, most, blocks), (most, blocks)
        assert [r.push_no for r in rows] == sorted((r.push_no for r in rows), reverse=True)
    assert {1, 3} <= {r.push_no for r in rename.want_queue(df, None, 20).collect()}
    assert rename.want_queue(df.limit(0), 3, 9).count() == 0


def test_kept_against_a_delete_is_cleared(spark):
    at = "folder string, name string, at long"
    contested = spark.createDataFrame([("f", "a", 5), ("f", "b", 5), ("g", "c", 5), ("h", "d", 5)], at)
    spoken = spark.createDataFrame([("f", "a", 6), ("f", "b", 4)], at)
    restarted = spark.createDataFrame([("g", 9), ("h", 2)], "folder string, at long")
    assert sorted(r.name for r in L.kept_against(contested, spoken, restarted).collect()) == ["b", "d"]


def test_small_tombstones_and_metadata(spark):
    keys = spark.createDataFrame([("f", "a", 7, 3)], "folder string, name string, counter long, sequence long")
    row = L.small_tombstone(keys, "1", 99).first()
    assert row.deleted and row.version == {"1": 7} and (row.permissions, row.modified_s, row.sequence, row.size) == (0o644, 99, 3, 0)
    back = conform(L.metadata(records(spark, [("a", 1, 5, 1, {"2": 1}, "a")]))).first()
    assert back.block_hashes == [] and back.size == 1


def test_staging(spark):
    rows = spark.createDataFrame([("k", 0, 1), ("k", 3, 2), ("k", 1, 3), ("k", 2, 4), ("j", 9, 1), ("j", 0, 2)], "key string, i long, at long")
    got = {(r.key, r.i): (r.early, r.staged, r.refused) for r in L.in_order(rows, 4).collect()}
    assert got == {("k", 0): (0, False, False), ("k", 3): (2, True, False), ("k", 1): (0, False, False), ("k", 2): (0, False, False), ("j", 9): (9, True, True), ("j", 0): (0, False, False)}


def exchange(have, peer, device):
    """``have`` after it took in all that ``peer`` announces; conflict losers stay under names of their own."""
    classified = C.classify(have, peer)
    losers = C.preserved(classified, device, NOW, f"D{device}").select("folder", "name", "record.*")
    new = conform(L.peer_tombstones(classified)).unionByName(conform(L.finished(classified, peer.select("folder", "name", F.lit("ok").alias("status")))))
    new = new.unionByName(conform(C.adopted(classified).select("folder", "name", "record.*"))).unionByName(conform(losers))
    return L.commit(have, new)


def test_two_replicas_converge(spark, tmp_path):
    rng = random.Random(0xC0)

    def replica(own):
        rows = []
        for k in range(300):
            if rng.random() < 0.8:
                v = {d: rng.randrange(1, 4) for d in ("1", "2") if d == own or rng.random() < 0.5}
                # one version of a file is the same wherever it is
                fate = random.Random(f"{k} {sorted(v.items())}")
                content = None if fate.random() < 0.2 else str(fate.randrange(3))
                rows.append((f"n{k}.txt", len(content or ""), fate.randrange(1, 5), len(rows) + 1, v, content))
        return records(spark, rows)

    def fixed(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    a, b = fixed(replica("1"), "a"), fixed(replica("2"), "b")
    for turn in range(3):
        a = fixed(exchange(a, b, "1"), f"a{turn}")
        b = fixed(exchange(b, a, "2"), f"b{turn}")
    state = lambda df: {(r.name, r.deleted, None if r.deleted else bytes(r.content_hash)) for r in df.collect()}
    # a name that one side never had and the other deleted is nobody's file
    live = lambda df: {x for x in state(df) if not x[1]}
    assert live(a) == live(b) and len(live(a)) > 150
    for df in (a, b):
        numbers = [r.sequence for r in df.select("sequence").collect()]
        assert len(numbers) == len(set(numbers))
        assert idx.high_water(df).count() == 1
