"""News over three replicas: who hears of what, and random histories that must converge."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from replisift.operators import index as idx
from replisift.operators import relay as R
from replisift.schema import INDEX
from tests.helpers import index

DEVICES = {"a": "1", "b": "2", "c": "3"}
CHAIN = [("a", "b"), ("b", "c"), ("c", "b"), ("b", "a")]
EDITS = "folder string, name string, size long, modified_s long, content_hash binary"


def none(spark):
    return spark.createDataFrame([], INDEX)


def live(df):
    return {(r.folder, r.name, bytes(r.content_hash)) for r in df.where("NOT deleted AND type = 0").collect()}


def test_the_third_replica_hears_of_everything(spark):
    one = index(spark, {"name": "x", "version": {"1": 5}}, {"name": "y", "version": {"1": 6}, "sequence": 2}, {"name": "dead", "deleted": True, "version": {"1": 7}, "sequence": 3})
    two = index(spark, {"name": "y", "version": {"1": 4}, "content_hash": b"\x02" * 32}, {"name": "z", "version": {"2": 1}, "sequence": 2, "content_hash": b"\x03" * 32})
    states, cursors = R.relay({"a": one, "b": two, "c": none(spark)}, CHAIN, DEVICES, 1000)
    assert live(states["a"]) == live(states["b"]) == live(states["c"]) and len(live(states["c"])) == 3
    numbers = sorted(r.sequence for r in states["c"].collect())
    assert numbers == [1, 2, 3]  # its own, not the sender's
    assert {r.name: r.version for r in states["c"].collect()}["y"] == {"1": 6}
    assert {link: [r.cursor for r in c.collect()] for link, c in cursors.items()}["a", "b"] == [idx.high_water(states["a"]).first().high]
    # with cursors kept, only what is new goes on
    edits = spark.createDataFrame([("f", "z", 0, 2000, None), ("f", "new", 3, 2000, bytearray(b"\x07" * 32))], EDITS)
    states["a"] = R.local_changes(states["a"], edits, "1")
    fresh = R.news(states["a"], cursors["a", "b"])
    assert sorted(r.name for r in fresh.collect()) == ["new", "z"]
    states, _ = R.relay(states, CHAIN, DEVICES, 2000, cursors)
    assert {r.name: r.deleted for r in states["c"].collect()} == {"x": False, "y": False, "z": True, "new": False}
    assert R.relay(states, [], DEVICES, 0)[0] == states


def test_what_a_peer_replaces_is_archived_first(spark):
    have = index(spark, {"name": "gone", "version": {"1": 1}}, {"name": "newer", "version": {"1": 1}, "sequence": 2}, {"name": "kept", "version": {"1": 9}, "sequence": 3})
    peer = index(spark, {"name": "gone", "deleted": True, "version": {"1": 1, "2": 2}}, {"name": "newer", "version": {"1": 1, "2": 2}, "content_hash": b"\x05" * 32}, {"name": "kept", "version": {"1": 3}, "content_hash": b"\x06" * 32})
    state, archive = R.received(have, peer, "1", 1000, "D", archived=none(spark))
    assert {r.name: r.deleted for r in state.collect()} == {"gone": True, "newer": False, "kept": False}
    assert {r.name: bytes(r.content_hash) for r in archive.collect()} == {"gone": b"\x01" * 32, "newer": b"\x01" * 32}


@pytest.mark.parametrize("seed", [1])
def test_random_histories_converge(spark, seed):
    """Each folder is a scenario of its own: writes, deletions and syncs at random, then syncs until it is quiet."""
    rng = random.Random(seed)
    folders, names = [f"s{k}" for k in range(60)], ["a", "b", "c/d", "e", "f.txt"]
    states, cursors, clock = {k: none(spark) for k in DEVICES}, {}, 1000
    for _ in range(2):
        for who in DEVICES:
            edits = {}
            for folder in folders:
                if rng.random() < 0.6:
                    when = clock + rng.randrange(4)
                    content = None if rng.random() < 0.33 else hashlib.sha256(bytes([rng.randrange(9)])).digest()
                    edits[folder, rng.choice(names)] = (0 if content is None else 1, when, bytearray(content) if content else None)
            states[who] = R.local_changes(states[who], spark.createDataFrame([(*k, *v) for k, v in edits.items()], EDITS), DEVICES[who])
        clock += rng.randrange(1, 4)
        for link in rng.sample(CHAIN, 2):  # some hops, once each
            told = cursors.get(link)
            fresh = R.news(states[link[0]], told if told is not None else spark.createDataFrame([], "folder string, cursor long"))
            cursors[link] = idx.high_water(states[link[0]]).select("folder", F.col("high").alias("cursor"))
            states[link[1]], _ = R.received(states[link[1]], fresh, DEVICES[link[1]], clock, f"D{DEVICES[link[1]]}")
    states, _ = R.relay(states, CHAIN, DEVICES, clock, cursors)
    a, b, c = (live(states[k]) for k in "abc")
    assert a == b == c and len(a) > 30
    for df in states.values():
        assert df.groupBy("folder", "sequence").count().where("count > 1").count() == 0
        assert df.groupBy("folder", "name").count().where("count > 1").count() == 0


def test_replicas_and_news_are_written_once(spark, monkeypatch):
    wrote, write = [], R.materialized
    monkeypatch.setattr(R, "materialized", lambda df, what: (wrote.append(what), write(df, what))[1])
    states, _ = R.relay({"a": index(spark, {"name": "x", "version": {"1": 1}}), "b": none(spark)}, [("a", "b")], {"a": "1", "b": "8"}, 1_700_000_000)
    assert live(states["b"]) == live(states["a"]) and wrote[:3] == ["replica", "replica", "news"]
