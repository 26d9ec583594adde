"""Scans, index changes, feeds, renames, registries and status on small tables."""

from pyspark.sql import functions as F

from replisift.functions import globs
from replisift.operators import feed as feeds
from replisift.operators import index as idx
from replisift.operators import registry, rename, scan, status
from replisift.sources import files
from tests.helpers import index, value

H2 = b"\x02" * 32


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), "folder string, name string, size long, modified_s long, is_dir boolean")


def by_name(df, column):
    return {r.name: r[column] for r in df.collect()}


def test_scan_changes(spark):
    stored = index(
        spark, {"name": "same"}, {"name": "size"}, {"name": "time"}, {"name": "old", "modified_s": 5}, {"name": "dead", "deleted": True}, {"name": "bad", "invalid": True},
        {"name": "bare", "block_hashes": []}, {"name": "gone"}, {"name": "gone2", "deleted": True}, {"name": "d", "type": 1}, {"name": "dd", "type": 1, "deleted": True},
    )
    found = listing(
        spark, ("f", "same", 10, 100, False), ("f", "size", 11, 100, False), ("f", "time", 10, 101, False), ("f", "old", 10, 252460800, False), ("f", "dead", 10, 100, False),
        ("f", "bad", 10, 100, False), ("f", "bare", 10, 100, False), ("f", "new", 1, 1, False), ("f", "d", 0, 7, True), ("f", "dd", 0, 7, True), ("f", "nd", 0, 7, True),
    )
    diffed = scan.diff(found, stored)
    assert by_name(diffed, "change") == {
        "same": "same", "size": "changed", "time": "changed", "old": "same", "dead": "changed", "bad": "changed", "bare": "changed", "gone": "missing", "gone2": "kept",
        "new": "new", "d": "same", "dd": "changed", "nd": "new",
    }
    mirror = by_name(scan.receive_only(diffed), "verdict")
    assert (mirror["new"], mirror["size"], mirror["same"], mirror["gone"], mirror["gone2"], mirror["nd"]) == ("untracked", "forget", "seen", "unseen", "kept", "commit")
    made = {r.name: r for r in scan.commit_directories(diffed, "1", 50).collect()}
    assert set(made) == {"dd", "nd"} and made["nd"].version == {"1": 50}


def test_walk(spark):
    rows = listing(
        spark, ("f", "a", 1, 1, False), ("f", "d", 9, 1, True), ("f", "d/.StIgnore", 1, 1, False), (("f"), "x.TMP", 1, 1, False), ("f", ".StVersions/a", 1, 1, False),
        ("f", "d/.stversions/a", 1, 1, False), ("f", "/".join("abcdefghijklm"), 1, 1, False), ("f", "/".join("abcdefghijklmn"), 1, 1, False), ("f", "z" * 256, 1, 1, False), ("f", "no/b", 1, 1, False),
    )
    kept = scan.walk(rows, globs.ignored(F.col("name"), globs.parse_rules("/no").rules), ".tmp")
    assert by_name(kept, "size") == {"a": 1, "d": 0, "d/.stversions/a": 1, "/".join("abcdefghijklm"): 1}


def test_hash_outcomes(spark):
    got = lambda s, h: value(spark, scan.hash_outcome(F.lit(s), F.lit(5), F.lit(h)))
    assert [got("vanished", 0), got("unreadable", 0), got("too_big", 9), got("ok", 6), got("ok", 5)] == ["swept", "seen", "seen", "deferred", "commit"]


def test_sweep(spark):
    stored = index(
        spark, {"name": "seen"}, {"name": "gone", "version": {"1": 9, "2": 1}}, {"name": "late", "sequence": 99}, {"name": "no.x", "sequence": 99}, {"name": "dir.x", "type": 1},
        {"name": "dead", "deleted": True}, {"name": "bad", "invalid": True},
    )
    seen, ignored = listing(spark, ("f", "seen", 1, 1, False)), F.col("name").endswith(".x")
    swept = scan.sweep(stored, seen, ignored, 50)
    assert by_name(swept, "verdict") == {"gone": "tombstone", "late": "spared", "no.x": "invalid", "dir.x": "spared"}
    assert scan.sweep(stored, seen, ignored, 50, complete=False).count() == 0
    new = {r.name: r for r in scan.swept_records(swept, "1", 7).collect()}
    assert new["gone"].deleted and new["gone"].version == {"1": 10, "2": 1} and new["gone"].block_hashes == [] and new["gone"].content_hash is None
    assert new["no.x"].invalid and not new["no.x"].deleted and new["no.x"].block_hashes == []
    assert {r.name for r in idx.forget_unseen(stored, seen, 50).collect()} == {"seen", "late", "no.x", "dead", "bad"}


def test_index_changes(spark):
    a = index(spark, {"name": "a", "sequence": 1}, {"name": "b", "sequence": 2}, {"folder": "g", "name": "a", "sequence": 1})
    b = index(spark, {"name": "a", "sequence": 5, "size": 7}, {"name": "c", "sequence": 6}, {"name": "c", "sequence": 4, "size": 0})
    got = {(r.folder, r.name): (r.sequence, r.size) for r in idx.upsert(a, b).collect()}
    assert got == {("f", "a"): (5, 7), ("f", "b"): (2, 10), ("f", "c"): (6, 10), ("g", "a"): (1, 10)}
    day = 86400
    old = index(spark, {"name": "a", "deleted": True, "modified_s": 10 * day - 1}, {"name": "b", "deleted": True, "modified_s": 10 * day}, {"name": "c", "modified_s": 0})
    assert {r.name for r in idx.prune(old, 190 * day).collect()} == {"b", "c"} and idx.prune(old, 190 * day, 0).count() == 3
    rows = spark.createDataFrame([("f" if k % 3 else "g", k) for k in range(200)], "folder string, k int")
    marks = spark.createDataFrame([("f", 10)], "folder string, high long")
    out = idx.assign_sequence(rows, marks, ["k"]).collect()
    for folder, first in (("f", 11), ("g", 1)):
        own = sorted((r.k, r.sequence) for r in out if r.folder == folder)
        assert [s for _, s in own] == list(range(first, first + len(own)))
    changes = index(spark, {"name": "x", "sequence": 1}, {"name": "x", "sequence": 2, "deleted": True}, {"name": "x", "sequence": 3}, {"folder": "g", "name": "y", "sequence": 4}, {"folder": "g", "name": "z", "sequence": 5, "invalid": True})
    assert {r.folder: (r.verb, r.name) for r in idx.latest_change(changes).collect()} == {"f": ("updated", "x"), "g": ("added", "y")}
    assert idx.forget(a, a.where("folder = 'g'")).count() == 2 and idx.reset(a, "f").count() == 1
    temps = listing(spark, ("f", "a.tmp", 1, 0, False), ("f", "b.tmp", 1, 8 * day, False), ("f", "c", 1, 0, False))
    assert [r.name for r in idx.stale_temps(temps, 8 * day, ".tmp").collect()] == ["a.tmp"]


def test_feed(spark):
    rows = index(spark, *[{"name": f"n{k}", "sequence": k} for k in range(1, 6)])
    cursors = spark.createDataFrame([("p", "f", 0, 3), ("q", "f", 3, 5), ("r", "g", 0, 9)], "peer string, folder string, cursor long, snapshot long")
    got = sorted((r.peer, r.is_full, r.sequence) for r in feeds.since(rows, cursors).collect())
    assert got == [("p", True, 1), ("p", True, 2), ("p", True, 3), ("q", False, 4), ("q", False, 5)]
    records = index(spark, {"name": "own", "version": {"1": 3}}, {"name": "bare", "block_hashes": []}, {"name": "dead", "deleted": True}, {"name": "dir", "type": 1, "block_hashes": []}, {"name": "zero", "version": {"1": 0}})
    told = lambda mode: {r.name for r in records.where(feeds.announceable("1", mode)).collect()}
    assert told(2) == {"dead", "dir", "zero"} and told(0) == {"own", "dead", "dir", "zero"}
    folders = spark.createDataFrame([("a", False, True, 0), ("b", True, True, 5), ("c", False, False, 2), ("d", False, False, 0)], "folder string, removed boolean, scanned boolean, n_records int")
    assert {r.folder for r in feeds.eligible(folders).collect()} == {"a", "c"}
    assert {r.folder for r in feeds.shared(folders, spark.createDataFrame([("c",), ("z",)], "folder string")).collect()} == {"c"}
    devices = lambda *d: F.array(*[F.struct(F.lit(i).alias("id"), F.lit(n).alias("max_sequence")) for i, n in d])
    assert [value(spark, feeds.index_coming(devices(*d), F.lit("me"))) for d in ([("me", 5)], [("me", 0), ("x", 1)], [("x", 0)])] == [True, False, True]


def test_renames(spark):
    stored = index(spark, {"name": "b", "sequence": 2}, {"name": "a", "sequence": 3}, {"name": "x", "content_hash": H2}, {"name": "dead", "deleted": True})
    wants = spark.createDataFrame([("f", "b", 10, b"\x01" * 32), ("f", "n", 10, b"\x01" * 32), ("f", "x", 10, H2), ("f", "q", 10, b"\x09" * 32)], "folder string, name string, size long, content_hash binary")
    assert by_name(rename.local_sources(wants, stored), "source") == {"b": "a", "n": "b"}
    assert {r.name for r in rename.already_have(wants, stored).collect()} == {"b", "x"} and {r.name for r in rename.still_wanted(wants, stored).collect()} == {"n", "q"}
    deletes = index(spark, {"name": "h"}, {"name": "free", "content_hash": b"\x07" * 32}, {"name": "unknown", "content_hash": None})
    assert {r.name for r in rename.held_deletes(deletes, wants).collect()} == {"h"} and {r.name for r in rename.applied_deletes(deletes, wants).collect()} == {"free", "unknown"}
    order = rename.delete_order(index(spark, {"name": "d", "type": 1}, {"name": "d/e", "type": 1}, {"name": "d/e/f"}, {"name": "z"}))
    assert [r.name for r in order.orderBy("is_dir", F.desc("depth"), "name").collect()] == ["d/e/f", "z", "d/e", "d"]


def test_overlapping_shuffles_folders_not_pairs(spark):
    """2,000 folders of one path and one below it: four million pairs, while what is shuffled grows with the folders."""
    rows = spark.range(2000).selectExpr("id AS folder", "'work:a' AS path").unionAll(spark.sql("SELECT 2000L AS folder, 'work:a/b' AS path"))
    pairs = registry.overlapping(rows)
    assert pairs.selectExpr("count(*)", "sum(inner * 1.0)", "count_if(inner = 2000)").first()[:] == (2000 * 1999 + 2000, 1999 * 1999 * 1000 + 2000 * 2000, 2000)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith(("Filter", "Project", "Generate"))  # nothing gathers the pairs


def test_registries_and_status(spark):
    paths = spark.createDataFrame([("1", "Work:A"), ("2", "work:a/b/"), ("3", "work:ab"), ("4", "work:"), ("5", "WORK:A")], "folder string, path string")
    got = {(r.inner, r.outer) for r in registry.overlapping(paths).collect()}
    assert got == {("2", "1"), ("2", "5"), ("1", "5"), ("5", "1"), ("1", "4"), ("2", "4"), ("3", "4"), ("5", "4")}
    seen = spark.createDataFrame([(f"d{k % 20}", f"h{k}", 1, k) for k in range(40)], "device string, host string, port int, at int")
    top = registry.recent_sightings(seen).collect()
    assert len(top) == 16 and top[0].device == "d19" and top[0].host == "h39" and top[-1].device == "d4"
    items = spark.createDataFrame([(1, "f", "queued"), (1, "f", "kept"), (1, "f", "reverted"), (2, "f", "active"), (2, "f", "parked"), (2, "f", "reverted")], "peer int, folder string, kind string")
    assert tuple(status.backlog(items).first()) == ("f", 2, 1, 2)
    totals = status.folder_totals(index(spark, {"name": "a"}, {"name": "b", "invalid": True, "size": -5}, {"name": "c", "deleted": True}, {"name": "d", "type": 1}))
    assert tuple(totals.first()) == ("f", 2, 1, 10)
    g = lambda *a: value(spark, status.global_label(*map(F.lit, a)))
    assert [g(0, 1, 1, 1, 1, 1), g(1, 0, 1, 1, 1, 1), g(1, 1, 1, 1, 1, 1), g(1, 1, 0, 1, 1, 1), g(1, 1, 0, 0, 1, 1), g(1, 1, 0, 0, 0, 2), g(1, 1, 0, 0, 0, 0)] == [
        "No peers configured", "Offline", "Syncing (1 file)", "Syncing", "Up to Date (1 local edit replaced)", "Up to Date (2 kept)", "Up to Date",
    ]
    listed = status.status_list(spark.createDataFrame([("b", "Zed"), ("a", "")], "folder string, label string"), spark.createDataFrame([("c", "alpha")], "folder string, label string"))
    assert [r.label for r in listed.collect()] == ["a", "Zed", "alpha"]


def test_stored_versions(spark, tmp_path):
    rows = index(spark, {"name": "a", "version": {"1": 2**64 - 1}}, {"folder": "g", "name": "b", "deleted": True})
    files.save_index(rows, str(tmp_path), 1, "77")
    back = files.load_index(spark, str(tmp_path), 1, "77")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert files.load_index(spark, str(tmp_path), 1, "78") is None and files.load_index(spark, str(tmp_path), 2, "77") is None
    import shutil

    shutil.rmtree(tmp_path / "v1" / "rows" / "folder=g")
    assert files.load_index(spark, str(tmp_path), 1, "77") is None
    assert files.state_name("default") == files.state_name("default") != files.state_name("Default")


def test_listing(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"abc")
    (tmp_path / "d" / "e" / "b.txt").write_bytes(b"z")
    got = {r.name: (r.size, r.is_dir) for r in files.listing(spark, str(tmp_path), "f").collect()}
    assert got == {"a.txt": (3, False), "d/e/b.txt": (1, False), "d": (0, True), "d/e": (0, True)}
    assert {bytes(r.content) for r in files.listing(spark, str(tmp_path), "f", True).where("NOT is_dir").collect()} == {b"abc", b"z"}
