"""Versions, classification and conflicts: cases and properties."""

import random
from datetime import UTC, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from replisift.functions import text, version
from replisift.operators import classify as C
from replisift.schema import RECEIVE_ONLY, SEND_ONLY, SEND_RECEIVE
from tests.helpers import index, value

H1, H2 = b"\x01" * 32, b"\x02" * 32
BIG = 2**64 - 1


def vec(d):
    return F.lit(None).cast("map<string,decimal(20,0)>") if d is None else F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(Decimal(v)).cast("decimal(20,0)"))]).cast("map<string,decimal(20,0)>") if d else F.expr("cast(map() as map<string,decimal(20,0)>)")


@pytest.mark.parametrize(
    "ours,theirs,relation",
    [
        ({}, {}, "EQUAL"), (None, {}, "EQUAL"), ({"1": 0}, {}, "EQUAL"), ({"1": 2}, {"1": 2}, "EQUAL"), ({"1": 3}, {"1": 2}, "OURS"), ({"1": 3}, {"1": 3, "2": 1}, "THEIRS"),
        ({"1": 3}, {"2": 1}, "CONCURRENT"), ({str(BIG): BIG}, {str(BIG): BIG - 1}, "OURS"), ({"1": 1, "2": 2}, {"1": 2, "2": 1}, "CONCURRENT"),
    ],
)
def test_compare(spark, ours, theirs, relation):
    assert value(spark, version.compare(vec(ours), vec(theirs))) == relation


def test_bump(spark):
    up = lambda d, v: value(spark, version.bump(vec(d), F.lit("1"), F.lit(v)))
    assert up({}, 5) == {"1": 5} and up(None, 5) == {"1": 5}
    assert up({"1": 9, "2": 3}, 5) == {"1": 10, "2": 3} and up({"1": 3}, 5) == {"1": 5}
    full = {str(k): 1 for k in range(10, 26)}
    assert up(full, 5) == full
    full = {str(k): 1 for k in range(1, 17)}
    assert up(full, 5) == {**full, "1": 5}
    assert value(spark, version.vector_of(F.expr("array(named_struct('id', '1', 'value', 5), named_struct('id', '1', 'value', 6))"))) == {"1": 5}


# (ours or None, the peer's, mode, action): the decision table, row by row, with its ties
V1, V2, VC = {"1": 1}, {"1": 1, "2": 1}, {"2": 1}
CASES = [
    ({}, {}, SEND_ONLY, "IGNORE"),
    (None, {"deleted": True}, SEND_RECEIVE, "IGNORE"),
    ({"deleted": True}, {"deleted": True}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1}, {"version": V2, "deleted": True}, SEND_RECEIVE, "DELETE"),
    ({"version": V2}, {"version": V1, "deleted": True}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1}, {"version": VC, "deleted": True}, SEND_RECEIVE, "IGNORE"),
    ({"modified_s": 100}, {"modified_s": 99, "deleted": True}, SEND_RECEIVE, "IGNORE"),
    ({"modified_s": 100}, {"modified_s": 100, "deleted": True}, SEND_RECEIVE, "DELETE"),
    (None, {}, SEND_RECEIVE, "FETCH"),
    (None, {}, RECEIVE_ONLY, "FETCH"),
    ({"version": V1}, {"version": V2}, SEND_RECEIVE, "ADOPT"),
    ({"version": V1}, {"version": V2, "content_hash": H2}, SEND_RECEIVE, "FETCH"),
    ({"version": V1, "content_hash": None}, {"version": V2, "content_hash": None}, SEND_RECEIVE, "FETCH"),
    ({"version": V2}, {"version": V1, "content_hash": H2}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1}, {"version": V1}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1}, {"version": V1, "permissions": 493}, SEND_RECEIVE, "ADOPT"),
    ({"version": V1}, {"version": V1, "modified_ns": 1}, SEND_RECEIVE, "ADOPT"),
    ({"version": V1, "deleted": True}, {"version": V1}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1}, {"version": VC}, SEND_RECEIVE, "ADOPT"),
    ({"version": V1}, {"version": VC, "modified_s": 101}, SEND_RECEIVE, "ADOPT"),
    ({"version": V1}, {"version": VC, "modified_s": 99}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1, "deleted": True}, {"version": VC, "modified_s": 1}, SEND_RECEIVE, "FETCH"),
    ({"version": V1}, {"version": VC, "modified_s": 101, "content_hash": H2}, SEND_RECEIVE, "CONFLICT"),
    ({"version": V1}, {"version": VC, "modified_ns": 1, "content_hash": H2}, SEND_RECEIVE, "CONFLICT"),
    ({"version": V1}, {"version": VC, "content_hash": H2}, SEND_RECEIVE, "CONFLICT"),
    ({"version": V1, "content_hash": b"\xff" * 32}, {"version": VC, "content_hash": H2}, SEND_RECEIVE, "IGNORE"),
    ({}, {}, SEND_RECEIVE, "IGNORE"),
    ({}, {"content_hash": H2, "modified_s": 99}, SEND_RECEIVE, "IGNORE"),
    ({}, {"content_hash": H2, "modified_s": 100}, SEND_RECEIVE, "FETCH"),
    ({"deleted": True}, {"modified_s": 99}, SEND_RECEIVE, "IGNORE"),
    ({"version": V1}, {"version": {}, "modified_s": 101, "content_hash": H2}, SEND_RECEIVE, "FETCH"),
]


def test_decision_table(spark):
    for mode in (SEND_RECEIVE, SEND_ONLY, RECEIVE_ONLY):
        cases = [(k, c) for k, c in enumerate(CASES) if c[2] == mode]
        have = index(spark, *[{**c[0], "name": str(k)} for k, c in cases if c[0] is not None] or [{"name": "none"}])
        peer = index(spark, *[{**c[1], "name": str(k)} for k, c in cases])
        got = {int(r.name): r.action for r in C.classify(have, peer, mode).collect()}
        assert got == {k: c[3] for k, c in cases}


def test_directories(spark):
    cases = [
        (None, {}, True, "DONE"), ({}, {"version": V2}, False, None), ({"deleted": True, "version": V1}, {"version": V2}, True, "DONE"),
        ({"deleted": True, "version": V1}, {"version": VC}, False, "DONE"), ({"deleted": True}, {"modified_s": 100}, True, "DONE"),
        ({"version": V2}, {"version": V1}, False, "REFUSE"), ({"version": V1}, {"version": VC}, False, "REMOVE"), ({"modified_s": 101}, {}, False, "REFUSE"), ({}, {}, False, "REMOVE"),
    ]
    have = index(spark, *[{**c[0], "name": str(k)} for k, c in enumerate(cases) if c[0] is not None])
    peer = index(spark, *[{**c[1], "name": str(k)} for k, c in enumerate(cases)])
    got = {int(r.name): r for r in C.pair(have, peer).select("name", C.receive_directory(F.col("have"), F.col("peer")).alias("c"), C.delete_directory(F.col("have"), F.col("peer")).alias("d")).collect()}
    for k, (_, _, create, delete) in enumerate(cases):
        assert got[k].c == create, k
        assert delete is None or got[k].d == delete, k


def test_admission_and_unstorable(spark):
    peer = index(
        spark, {"name": "ok"}, {"name": "a/../b"}, {"name": "bad", "invalid": True}, {"name": "link", "type": 4}, {"name": "skip.tmp"}, {"name": "gone.tmp", "deleted": True},
        {"name": "dir.tmp", "type": 1, "deleted": True}, {"name": "huge", "block_size": 1 << 21},
    )
    got = C.admissible(peer, F.col("name").endswith(".tmp"))
    assert {r.name for r in got.collect()} == {"ok", "gone.tmp", "huge"}
    out = C.unstorable(C.classify(index(spark, {"name": "other"}), got)).collect()
    assert [(r.name, r.record.invalid, r.record.block_hashes) for r in out] == [("huge", True, [])]


@pytest.mark.parametrize(
    "name,now,compact,cap,want",
    [
        ("dir/report.txt", 1784291696, False, 256, "dir/report.sync-conflict-20260717-123456-P56IOI7.txt"),
        ("dir/report.txt", 1784291696, True, 256, "dir/report.cnfl-123456.txt"),
        ("dir.d/plain", 0, False, 256, "dir.d/plain.sync-conflict-19700101-000000-P56IOI7"),
        (".hidden", 951854402, False, 256, ".sync-conflict-20000229-200002-P56IOI7.hidden"),
        ("a.tar.gz", 951854402, True, 256, "a.tar.cnfl-200002.gz"),
        ("long.txt", 0, False, 20, None),
        ("x", 0, True, 13, None),
        ("x", 0, True, 14, "x.cnfl-000000"),
    ],
)
def test_conflict_names(spark, name, now, compact, cap, want):
    got = value(spark, text.conflict_name(F.lit(name), F.lit(now), F.lit("P56IOI7-XXXXXXX"), compact, cap))
    assert got == want
    if want and not compact:
        assert datetime.fromtimestamp(now, UTC).strftime("%Y%m%d-%H%M%S") in got


def test_preserved(spark):
    have = index(spark, {"name": "d/a.txt", "version": {"1": 5}})
    peer = index(spark, {"name": "d/a.txt", "version": {"2": 5}, "modified_s": 200, "content_hash": H2})
    rows = C.preserved(C.classify(have, peer), "1", 1784291696, "P56IOI7").collect()
    assert rows[0].name == "d/a.sync-conflict-20260717-123456-P56IOI7.txt" and rows[0].record.version == {"1": 1784291696}
    assert [r.name for r in C.preserved(C.classify(have, peer), "1", 1784291696, "P56IOI7", cap=24).collect()] == ["d/a.cnfl-123456.txt"]


def test_both_sides_agree(spark):
    """With vectors at most one side takes the other's content, and of two different live contents one is taken."""
    rng = random.Random(11)

    def one():
        version = {k: rng.randrange(1, 4) for k in ("1", "2", "3") if rng.random() < 0.7}
        return {"version": version, "modified_s": rng.randrange(1, 4), "content_hash": rng.choice([H1, H2]), "deleted": rng.random() < 0.3}

    pairs = [(one(), one()) for _ in range(1500)]
    a = index(spark, *[{**x, "name": str(k)} for k, (x, _) in enumerate(pairs)])
    b = index(spark, *[{**y, "name": str(k)} for k, (_, y) in enumerate(pairs)])
    ab = {r.name: r.action for r in C.classify(a, b).collect()}
    ba = {r.name: r.action for r in C.classify(b, a).collect()}
    takes = ("FETCH", "CONFLICT", "DELETE")
    for k, (x, y) in enumerate(pairs):
        if x["version"] and y["version"]:
            assert not (ab[str(k)] in takes and ba[str(k)] in takes), (x, y)
            if not x["deleted"] and not y["deleted"] and x["content_hash"] != y["content_hash"] and x["version"] != y["version"]:
                assert ab[str(k)] in takes or ba[str(k)] in takes, (x, y)
