"""Walks by levels: what is listed, what is left out, and what a scan may conclude from it."""

import os

import pytest
from pyspark.sql import functions as F

from replisift.operators import lifecycle as L
from replisift.sources import walk as W
from tests.test_lifecycle import NOW, keyed, records

LOCKED = "locked"


def failing(place):
    """A file system on which one directory can't be read, and another breaks off."""
    if os.path.basename(place) == LOCKED:
        raise PermissionError(place)
    for k, entry in enumerate(W.list_directory(place)):
        if os.path.basename(place) == "torn" and k == 1:
            raise OSError("broke off")
        yield entry


def tree(root):
    files = {"a.txt": b"abc", "empty": b"", "sub/b.txt": b"b", "sub/deep/er/c": b"cc", "x.part": b"?", "sub/.stignore": b"", ".stversions/old": b"", "sub/.stversions/kept": b"k", "users.tmp": b"u", "skip/me": b"s", f"{LOCKED}/in": b"i"}
    for name, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
        os.utime(f"{root}/{name}", (1000, 1000))
    os.makedirs(f"{root}/hollow")


def roots(spark, **places):
    return spark.createDataFrame([(k, str(v)) for k, v in places.items()], "folder string, root string")


def test_entries(spark, tmp_path):
    tree(tmp_path)
    w = W.walk_folders(spark, roots(spark, f=tmp_path), ".part", lambda name: name.rlike("^skip(/|$)"))
    got = {r.name: r for r in w.entries.collect()}
    assert set(got) == {"a.txt", "empty", "sub", "sub/b.txt", "sub/deep", "sub/deep/er", "sub/deep/er/c", "sub/.stversions", "sub/.stversions/kept", "users.tmp", LOCKED, f"{LOCKED}/in", "hollow"}
    assert (got["empty"].size, got["empty"].is_dir, got["a.txt"].size, got["a.txt"].modified_s) == (0, False, 3, 1000)
    assert got["hollow"].is_dir and got["sub"].size == 0
    assert [(r.folder, r.outcome) for r in w.outcomes.collect()] == [("f", "complete")] and w.problems.count() == 0
    assert {(r.depth, r.files, r.directories) for r in W.depth_of(w.entries).collect()} == {(0, 3, 3), (1, 2, 2), (2, 1, 1), (3, 1, 0)}
    assert W.walk_folders(spark, roots(spark, f=f"file://{tmp_path}"), ".part").entries.count() == 15


def test_depth_and_length(spark, tmp_path):
    tree(tmp_path)
    w = W.walk_folders(spark, roots(spark, f=tmp_path), ".part", deepest=2, longest=10)
    got = {r.name for r in w.entries.collect()}
    assert "sub/deep" in got and "sub/deep/er" not in got and "sub/.stversions" not in got
    assert {(r.kind, r.n, r.example) for r in w.tallies().collect()} == {("deep", 1, "sub/deep"), ("long", 1, "sub/.stversions")}


def test_unreadable_directories_shelter_what_is_below(spark, tmp_path):
    tree(tmp_path)
    os.makedirs(f"{tmp_path}/torn")
    for n in ("p", "q", "r"):
        open(f"{tmp_path}/torn/{n}", "w").close()
    index = records(spark, [(n, 1, 5, k + 1, {"2": k + 1}, n) for k, n in enumerate([f"{LOCKED}/in", f"{LOCKED}/sub/gone", "sub/gone", "gone", "torn/p", "torn/q", "torn/r", f"{LOCKED}er/gone"])])
    w = W.walk_folders(spark, roots(spark, f=tmp_path), ".part", lister=failing)
    assert {(r.kind, r.name) for r in w.problems.collect()} == {("unopened", LOCKED), ("unopened", "torn")}
    assert {r.name for r in w.sheltered(index).collect()} == {f"{LOCKED}/in", f"{LOCKED}/sub/gone", "torn/p", "torn/q", "torn/r"}
    none = spark.createDataFrame([], "folder string, name string, content binary, status string")
    got = keyed(L.scan_pass(w.entries, index, none, F.lit(False), "1", NOW, ".part", sheltered=w.sheltered(index)))
    assert {n for n, r in got.items() if r.deleted} == {"sub/gone", "gone", f"{LOCKED}er/gone"}


def test_roots_that_cannot_be_opened_and_aborted_walks_sweep_nothing(spark, tmp_path):
    tree(tmp_path)
    asked = []
    index = records(spark, [("gone", 1, 5, 1, {"2": 1}, "a"), ("sub/gone", 1, 5, 2, {"2": 2}, "b")])
    none = spark.createDataFrame([], "folder string, name string, content binary, status string")
    for w, outcome in (
        (W.walk_folders(spark, roots(spark, f=tmp_path / "nowhere"), ".part"), "cannot open"),
        (W.walk_folders(spark, roots(spark, f=tmp_path), ".part", stop=lambda: len(asked) > 1 or asked.append(1)), "aborted"),
    ):
        assert [r.outcome for r in w.outcomes.collect()] == [outcome] and w.concluded().count() == 0
        got = keyed(L.scan_pass(w.entries, index, none, F.lit(False), "1", NOW, ".part", sheltered=w.sheltered(index)))
        assert not any(r.deleted for r in got.values())
    both = W.walk_folders(spark, roots(spark, f=tmp_path, g=tmp_path / "nowhere"), ".part")
    assert {(r.folder, r.outcome) for r in both.outcomes.collect()} == {("f", "complete"), ("g", "cannot open")}


def test_no_root(spark):
    w = W.walk_folders(spark, roots(spark, f="/tmp").where("false"), ".part")
    assert w.entries.count() == w.outcomes.count() == w.problems.count() == 0
    with pytest.raises(ValueError):
        W.walk_folders(spark, roots(spark, f="/tmp"), "")
