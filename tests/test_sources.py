"""Codecs, ids and configuration: round trips, facts and malformed input."""

import hashlib
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replisift.sources import codec, config, device_id
from replisift.sources import protobuf as pb
from tests.helpers import index

number = st.integers(0, 2**64 - 1)
stored = st.fixed_dictionaries(
    {
        "name": st.text(st.characters(codec="utf-8", exclude_characters="\0"), max_size=20), "type": st.sampled_from([0, 1, 4]), "size": st.integers(-(2**63), 2**63 - 1), "permissions": st.integers(0, 2**32 - 1),
        "modified_s": st.integers(-(2**63), 2**63 - 1), "modified_ns": st.integers(-(2**31), 2**31 - 1), "modified_by": number, "sequence": st.integers(0, 2**63 - 1), "block_size": st.integers(0, 2**31 - 1),
        "version": st.dictionaries(number.map(str), number, max_size=4), "content_hash": st.one_of(st.none(), st.binary(min_size=32, max_size=32)), "deleted": st.booleans(), "invalid": st.booleans(),
        "block_hashes": st.lists(st.binary(min_size=32, max_size=32), max_size=3),
    }
)


@settings(max_examples=150, deadline=None)
@given(st.lists(stored, max_size=4), st.integers(0, 2**63 - 1))
def test_stored_round_trip(records, high):
    blob = codec.encode_index("default", 7, high, [codec.encode_stored(r) for r in records])
    assert codec.decode_index(blob, "default", 7) == (high, records)
    assert codec.decode_index(blob, "other", 7) is None and codec.decode_index(blob, "default", 8) is None
    for cut in range(0, len(blob), max(1, len(blob) // 40)):
        assert codec.decode_index(blob[:cut], "default", 7) is None


@settings(max_examples=150, deadline=None)
@given(st.lists(stored, max_size=3), st.binary(max_size=30))
def test_wire_round_trip(records, noise):
    message = codec.encode_index_message("f", [codec.encode_file_info(r) for r in records])
    folder, got = codec.decode_index_message(message + pb.data(1, "later") + pb.number(99, 5))
    assert folder == "f" and [{k: v for k, v in r.items() if k != "content_hash"} for r in records] == got
    codec.decode_index_message(message[: len(message) // 2] + noise)
    codec.decode_announce(noise)
    codec.decode_cluster_config(noise)


def test_malformed():
    wrong = pb.data(1, "x") + pb.number(2, 2)
    assert codec.decode_index(wrong, "f", 1) is None and codec.decode_index(b"\xff" * 12, "f", 1) is None and codec.decode_index(b"", "f", 1) is None
    assert codec.decode_vector(pb.data(1, pb.number(1, 5) + pb.number(2, 6)) + pb.data(1, pb.number(1, 5) + pb.number(2, 9))) == {"5": 6}
    odd = pb.varint(3 << 3 | pb.I32) + b"\0\0\0\0"  # a known field of another wire type is skipped
    assert codec.decode_file_info(odd + pb.data(1, "a"))["name"] == "a" and codec.decode_file_info(odd)["size"] == 0
    assert codec.decode_cluster_config(pb.data(1, pb.data(16, pb.number(1, 5) + pb.number(2, 6) + pb.data(6, b"x"))))[0]["devices"] == [{"id": b"", "name": "", "max_sequence": 0, "index_id": 0}]
    for bad in (b"\x00\x01", b"\x0b", b"\x0a\x05ab", b"\x80" * 11):
        with pytest.raises(pb.Malformed):
            list(pb.fields(bad))


def test_batches():
    parts = list(codec.index_batches([b"x" * 10] * 600))
    assert [len(p) for p in parts] == [256, 256, 88]
    assert [len(p) for p in codec.index_batches([b"a" * 50, b"b" * 200, b"c", b"d"], most_bytes=100)] == [1, 1, 2]


def test_frames():
    body = bytes(range(256)) * 3
    stream = codec.encode_frame(1, body) + codec.encode_frame(6, b"") + codec.encode_frame(2, body, True) + b"\x00\x00\x00\x00\x00\x01z"
    assert list(codec.decode_frames(stream)) == [(1, body), (6, b""), (2, body), (0, b"z")]
    # literals "abc", then nine bytes from three back, then literals "abcde"
    assert codec.lz4_block(b"\x35abc\x03\x00\x50abcde", 17) == b"abc" * 4 + b"abcde"
    for bad in (stream[:-1], b"\x00", codec.encode_frame(1, b"x")[:-2] + b"\xff"):
        with pytest.raises(pb.Malformed):
            list(codec.decode_frames(bad))
    for block, size in ((b"\x35abc\x09\x00", 12), (b"\xf0", 15), (b"\x30abc", 4)):
        with pytest.raises(pb.Malformed):
            codec.lz4_block(block, size)


def test_announce_and_folders():
    raw = bytes(range(32))
    assert codec.decode_announce(codec.encode_announce(raw, ["tcp://a:1", "tcp://b:2"], 5)) == (raw, "tcp://a:1")
    assert codec.decode_announce(codec.encode_announce(raw[:31], [])) is None and codec.decode_announce(b"\0\0\0\0") is None
    folders = [{"id": "a", "label": "L", "type": 2, "devices": [{"id": raw, "name": "n", "max_sequence": 5, "index_id": 6}]}, {"id": "b", "label": "", "type": 0, "devices": []}]
    assert codec.decode_cluster_config(codec.encode_cluster_config(folders)) == folders


def test_index_through_spark(spark):
    rows = index(spark, {"name": "a", "sequence": 2, "version": {str(2**64 - 1): 2**64 - 1}, "modified_by": Decimal(2**64 - 1)}, {"name": "ü", "deleted": True}, {"folder": "g", "name": "b", "modified_s": -5})
    back = codec.decode_indexes(codec.encode_indexes(rows, 9), 9)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert codec.decode_indexes(codec.encode_indexes(rows, 9), 8).count() == 0


def test_index_in_pieces(spark):
    """No piece grows with its folder, and the pieces hold all of it."""
    rows = index(spark, *({"name": f"n{k}", "sequence": k, "folder": "f"} for k in range(500)), {"folder": "g", "name": "b"})
    pieces = codec.encode_indexes(rows, 9, 50)
    sizes = sorted(len(codec.decode_index(bytes(p.blob), p.folder, 9)[1]) for p in pieces.collect())
    assert len(sizes) == 11 and sum(sizes) == 501 and sizes[-1] < 100
    assert sorted(map(str, codec.decode_indexes(pieces, 9).collect())) == sorted(map(str, rows.collect()))


def test_device_ids(spark):
    rng = random.Random(1)
    for _ in range(200):
        raw = rng.randbytes(32)
        text = device_id.from_raw(raw)
        assert len(text) == 63 and device_id.to_raw(text) == raw and device_id.to_raw(text.lower().replace("-", " ")) == raw
        k = rng.randrange(63)
        if text[k] != "-":
            other = "A" if text[k] != "A" else "B"
            assert device_id.normalize(text[:k] + other + text[k + 1 :]) is None
    assert device_id.from_raw(b"x") is None and device_id.normalize("") is None and device_id.normalize(None) is None and device_id.normalize("1" * 56) is None
    df = spark.range(3).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("raw"))
    got = df.select("raw", device_id.device_id(F.col("raw")).alias("d")).collect()
    assert all(device_id.to_raw(r.d) == bytes(r.raw) for r in got) and bytes(got[0].raw) == hashlib.sha256(b"0").digest()


A, B = device_id.from_raw(b"a" * 32), device_id.from_raw(b"b" * 32)


def test_config(spark):
    text = f"""; comment
[section]
Window = 9
keepdeletes = 30x
compression = sometimes
tzoffset = -03:30
loglevel = WARN
no equals sign
mystery = 1
peer = {A} host.example:123
peer = {A.lower().replace("-", "")} other
peer = {B}
peer = nonsense
folder = one Work:One sendonly Label
folder = one Work:Two
folder = two Work:Two mirror
folder = three
"""
    cfg = config.parse_config(text)
    assert (cfg.settings["window"], cfg.settings["keepdeletes"], cfg.settings["compression"], cfg.settings["tzoffset"], cfg.settings["loglevel"]) == (4, 30, True, -12600, 2)
    assert [(p["host"], p["port"]) for p in cfg.peers] == [("host.example", 123), ("", 0)]
    assert [(f["folder"], f["label"], f["mode"]) for f in cfg.folders] == [("one", "Label", 1), ("two", "two", 0)]
    assert len(cfg.warnings) == 7
    assert config.parse_config(None).settings["keepdeletes"] == 180
    peers, folders = cfg.frames(spark)
    assert peers.count() == 2 and folders.columns == ["folder", "label", "path", "mode"]


def test_config_edits(tmp_path):
    text = f"# top\npeer = {A}\nlogmax = 5\n"
    new = config.append_line(text, "peer", f"{B} h:1", "# added by command")
    assert new == f"# top\npeer = {A}\n# added by command\npeer = {B} h:1\nlogmax = 5\n"
    assert config.remove_peer(new, B.lower()) == text
    assert config.append_line("x = 1\n", "folder", "a b") == "x = 1\nfolder = a b\n" and config.append_line("x = 1", "folder", "a b") == "x = 1\nfolder = a b\n"
    with pytest.raises(ValueError):
        config.append_line(text, "peer", "a\npeer = b")
    config.save(str(tmp_path / "c"), new)
    assert (tmp_path / "c").read_text() == new
    run = lambda line, cfg="": config.command(line.split(), lambda: "fine", cfg)
    assert run("status") == ("fine", "") and run("nothing")[0] == "ERROR" and run("addpeer bad")[0] == "ERROR"
    reply, cfg = run("addfolder a work:x receiveonly")
    assert reply == "OK" and run("addfolder a work:y", cfg)[0] == "EXISTS" and run("addfolder b WORK:x/y", cfg)[0] == "OVERLAP" and run("addfolder b work:xy", cfg)[0] == "OK" and run("addfolder b c badmode", cfg)[0] == "ERROR"
    assert run("removefolder a", cfg) == ("OK", "")
    assert run(f"addpeer {A} h:1")[0] == "OK" and run(f"addpeer {A.lower()}", f"peer = {A}\n")[0] == "EXISTS"
