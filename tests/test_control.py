"""Command logs: parsing, state by aggregation, composition of parts, replies, and the report."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from replisift.operators import control as C
from replisift.sources import device_id
from tests.helpers import index

IDS = [device_id.from_raw(hashlib.sha256(bytes([k])).digest()) for k in range(4)]


def log(spark, *lines, start=1):
    return spark.createDataFrame([(start + k, x) for k, x in enumerate(lines)], "at long, line string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replies(spark):
    lines = [
        f"addpeer {IDS[0]} host:22000", f"ADDPEER {IDS[0].lower().replace('-', '')}", "ADDPEER nonsense", "ADDPEER", "  AddFolder f Work:  recieveonly", "ADDFOLDER f Work: ReceiveOnly", "ADDFOLDER f Other:",
        "REMOVEFOLDER f", "REMOVEFOLDER f", "ADDFOLDER f Third:", "REMOVEFOLDER", "RESCAN", f"PAUSE {IDS[0][:7]}", "PAUSE", f"RESUME {IDS[0]}", "LOGLEVEL", "LOGLEVEL loud", "LOGLEVEL WARN", "STATUS", "FROB", "", None, "QUIT now",
    ]
    got = [r.reply for r in C.replies(log(spark, *lines)).orderBy("at").collect()]
    assert got == [
        "added", "already configured", "error", "error", "error", "added", "already configured", "removed", "unknown folder", "added", "error", "ok", "error", "ok", "ok", "ok", "error", "ok", "ok", "error", "error", "error", "ok",
    ]
    state = C.state_of(log(spark, *lines))
    assert rows(C.folders(state)) == [("f", "Third:", 0)]
    assert rows(C.peers(state)) == [(IDS[0], "host:22000", False)]
    s = C.settings(state).first()
    assert (s.level, s.rescan_at, s.quit_at) == ("warn", 12, 23)
    scanned = spark.createDataFrame([("f", 11), ("g", 12), ("h", None)], "folder string, scanned_at long")
    assert sorted(r.folder for r in C.due(state, scanned).collect()) == ["f", "h"]


def test_pauses(spark):
    state = C.state_of(log(spark, f"ADDPEER {IDS[0]}", f"ADDPEER {IDS[1]} h", "PAUSE", f"ADDPEER {IDS[2]}", f"RESUME {IDS[1]}", f"PAUSE {IDS[3]}", f"ADDPEER {IDS[3]}"))
    assert {r.device: r.paused for r in C.peers(state).collect()} == {IDS[0]: True, IDS[1]: False, IDS[2]: False, IDS[3]: False}
    empty = C.state_of(log(spark, "x").where("false"))
    assert empty.count() == C.peers(empty).count() == C.folders(empty).count() == 0 and C.settings(empty).first().level == "info"


def folded(lines):
    """The commands one by one."""
    peers, paused, folders, level, rescan, quit_at = {}, {}, {}, "info", None, None
    for at, line in lines:
        w = line.split()
        verb, args = w[0].upper(), w[1:]
        if verb == "ADDPEER" and args[0] not in peers:
            peers[args[0]], paused[args[0]] = args[1] if len(args) > 1 else "", False
        elif verb in ("PAUSE", "RESUME"):
            for p in [args[0]] if args else list(peers):
                if p in peers:
                    paused[p] = verb == "PAUSE"
        elif verb == "ADDFOLDER" and args[0] not in folders:
            folders[args[0]] = (args[1], {"sendonly": 1, "receiveonly": 2}.get(args[2], 0) if len(args) > 2 else 0)
        elif verb == "REMOVEFOLDER":
            folders.pop(args[0], None)
        elif verb == "LOGLEVEL":
            level = args[0]
        elif verb == "RESCAN":
            rescan = at
        elif verb == "QUIT":
            quit_at = at
    return sorted((d, a, paused[d]) for d, a in peers.items()), sorted((f, *v) for f, v in folders.items()), (level, rescan, quit_at)


@pytest.mark.parametrize("seed", range(2))
def test_parts_of_a_log_compose(spark, seed):
    rng = random.Random(seed)

    def one():
        verb = rng.choice(["ADDPEER", "PAUSE", "PAUSE", "RESUME", "ADDFOLDER", "REMOVEFOLDER", "LOGLEVEL", "RESCAN", "QUIT"])
        if verb == "ADDPEER":
            return f"{verb} {rng.choice(IDS)} h{rng.randrange(9)}"
        if verb in ("PAUSE", "RESUME"):
            return verb if rng.random() < 0.4 else f"{verb} {rng.choice(IDS)}"
        if verb == "ADDFOLDER":
            return f"{verb} {rng.choice('fgh')} P{rng.randrange(9)}: {rng.choice(['sendonly', 'receiveonly', 'sendreceive'])}"
        if verb == "REMOVEFOLDER":
            return f"{verb} {rng.choice('fgh')}"
        return f"{verb} {rng.choice(C.LEVELS)}" if verb == "LOGLEVEL" else verb

    lines = [one() for _ in range(60)]
    whole = C.state_of(log(spark, *lines))
    a, b, c = (C.state_of(log(spark, *lines[k : k + 20], start=k + 1)) for k in (0, 20, 40))
    left, right = C.composed(C.composed(a, b), c), C.composed(a, C.composed(b, c))
    assert rows(left) == rows(right) == rows(whole)
    assert rows(C.composed(whole.where("false"), whole)) == rows(C.composed(whole, whole.where("false"))) == rows(whole)
    peers, folders, settings = folded(list(enumerate(lines, 1)))
    assert rows(C.peers(whole)) == sorted(peers, key=str) and rows(C.folders(whole)) == sorted(folders, key=str) and tuple(C.settings(whole).first()) == settings


def test_discovered_ids_are_compared_in_normal_form(spark):
    from replisift.operators import status

    seen = spark.createDataFrame([(IDS[0].replace("-", "").lower(), 1), (IDS[1], 2), ("odd", 3), ("other", 4)], "device string, k int")
    peers = spark.createDataFrame([(IDS[0],), ("odd",)], "device string")
    assert sorted(r.k for r in status.found_peers(seen, peers, True).collect()) == [1, 3]
    assert sorted(r.k for r in status.found_peers(seen, peers, False).collect()) == [2, 4]


def test_report(spark):
    folders = spark.createDataFrame([("f", "Files", "Work:", 2), ("g", "", "Data:", 0)], "folder string, label string, path string, mode int")
    own = index(spark, {"name": "a", "size": 2048}, {"name": "d", "type": 1, "sequence": 2}, {"name": "x", "deleted": True, "sequence": 3})
    scans = spark.createDataFrame([("f", 60)], "folder string, scanned_s long")
    items = spark.createDataFrame([("p", "f", "reverted"), ("p", "f", "kept"), ("q", "f", "kept")], "peer string, folder string, kind string")
    lines = C.folder_lines(folders, own, scans, items, own, 60 * 200)
    sessions = spark.createDataFrame([(IDS[0], True, True, 1, "client v1", 2048, 0), (IDS[1], False, True, 0, None, 0, 0)], "device string, connected boolean, running boolean, pending long, client string, bytes_in long, bytes_out long")
    peers = spark.createDataFrame([(IDS[0], "h:1", False), (IDS[1], "", True), (IDS[2], "", False)], "device string, address string, paused boolean")
    seen = spark.createDataFrame([(IDS[3], "k:9")], "device string, address string")
    offered = spark.createDataFrame([("zz", "Music", None)], "folder string, label string, device string")
    got = [r.line for r in C.report(lines, C.peer_lines(peers, sessions), seen, offered).orderBy("section", "key", "place").collect()]
    want_peers = sorted([(IDS[0], [f"{IDS[0][:7]}  h:1  syncing (1 file)", "  client v1 - received 2.0 KB, sent 0 B"]), (IDS[1], [f"{IDS[1][:7]}  (discovering)  paused"]), (IDS[2], [f"{IDS[2][:7]}  (discovering)  idle"])])
    assert got == [
        "Folders (2)", "Files [f]  Work:  receiveonly", "  1 file, 1 dir, 2.0 KB - scanned 3h 19m ago", "  1 local edit replaced by a peer's copy", "  1 file kept against a peer's deletion", "  latest change: deleted x",
        "g  Data:  sendreceive", "  0 files, 0 dirs, 0 B - not scanned yet", "  latest change: (none yet)",
        "Remote devices (3)", *[x for _, v in want_peers for x in v], "Discovered, not configured (1)", f"{IDS[3][:7]}  k:9", "Offered, not configured (1)", "Music [zz]  (from ?)",
    ]
    assert C.report(lines, C.peer_lines(peers, sessions), seen.where("false")).where("section > 2").count() == 0
    assert C.report(lines.where("false"), C.peer_lines(peers, sessions).where("false")).where(F.col("line").endswith("(0)")).count() == 2
