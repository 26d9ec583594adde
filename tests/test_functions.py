"""Hashes, paths, texts and globs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from replisift.functions import globs, hashing, paths, text
from replisift.sources import config
from tests.helpers import value


def test_block_size(spark):
    sizes = [0, 2000 * 131072 - 1, 2000 * 131072, 2000 * (1 << 24) - 1, 2000 * (1 << 24), 1 << 50]
    got = [value(spark, hashing.block_size(F.lit(s))) for s in sizes]
    assert got == [131072, 131072, 262144, 1 << 24, 1 << 24, 1 << 24]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 100])
def test_hashes(spark, n):
    data, bs = bytes(range(n)), 8
    want = [hashlib.sha256(data[k : k + bs]).digest() for k in range(0, max(1, n), bs)]
    hashes = hashing.block_hashes(F.lit(data).cast("binary"), F.lit(bs))
    assert [bytes(h) for h in value(spark, hashes)] == want
    assert bytes(value(spark, hashing.content_hash(hashes))) == hashlib.sha256(b"".join(want)).digest()
    spans = value(spark, hashing.block_spans(F.lit(n), F.lit(bs)))
    assert sum(s.size for s in spans) == n and [s.offset for s in spans] == list(range(0, max(1, n), bs))


def test_verify_resume_short_id(spark):
    a, b = F.lit(b"a").cast("binary"), F.lit(b"b").cast("binary")
    got = lambda x, y: tuple(value(spark, hashing.verify(F.array(*x), F.array(*y), F.lit(8))))
    assert got([a, b], [a, b]) == (True, None, None) and got([a, b], [a, a]) == (False, 1, 8) and got([a], [a, b]) == (False, 1, 8)
    point = lambda t: value(spark, hashing.resume_block(F.lit(t), F.lit(10), F.lit(3)))
    assert [point(t) for t in (0, 9, 10, 29, 30, 31)] == [0, 0, 1, 2, 3, 0]
    assert value(spark, hashing.short_id(F.lit(b"\xff" * 32).cast("binary"))) == 2**64 - 1
    assert bytes(value(spark, hashing.read_block(F.lit(b"abcdef").cast("binary"), F.lit(2), F.lit(3)))) == b"cde"
    assert value(spark, hashing.read_block(F.lit(b"abcdef").cast("binary"), F.lit(4), F.lit(3))) is None


def test_names(spark):
    safe = lambda n: value(spark, paths.name_safe(F.lit(n)))
    assert all(map(safe, ["a", "a/b", "..a/b..", "a b/ü"]))
    assert not any(map(safe, ["", "/a", "a/", "a//b", ".", "a/../b", "..", "./a", "vol:a", "a\\b"])) and value(spark, paths.name_safe(F.lit(None).cast("string"))) is False
    ok = lambda t: value(spark, paths.text_safe(F.lit(t)))
    assert ok("plain ü") and not any(map(ok, ["a\nb", 'say "x"', "\x7f", "\x00"]))
    assert value(spark, paths.utf8_valid(F.lit(b"\xc0\xaf").cast("binary"))) is False and value(spark, paths.utf8_valid(F.lit("ü€😀".encode()).cast("binary")))
    assert value(spark, paths.join(F.lit("a" * 200), F.lit("b" * 54))) and value(spark, paths.join(F.lit("a" * 200), F.lit("b" * 55))) is None
    assert (value(spark, paths.parent(F.lit("a/b/c"))), value(spark, paths.parent(F.lit("a")))) == ("a/b", None)
    inside = lambda a, b: value(spark, paths.overlap(F.lit(a), F.lit(b)))
    assert inside("Work:A/b", "work:a") and inside("work:", "Work:x") and inside("a", "A") and not inside("work:ab", "work:a")
    local = bytes(value(spark, paths.to_local(F.lit("ä/€ä/x"))))
    assert local == "ä".encode("latin-1") + b"/" + "€ä".encode() + b"/x"
    assert value(spark, paths.from_local(F.lit(local).cast("binary"))) == "ä/€ä/x"
    a = value(spark, paths.host_address(F.lit("tcp://h-1.x_y:22000")))
    assert (a.host, a.port) == ("h-1.x_y", 22000)
    assert all(value(spark, paths.host_address(F.lit(u))) is None for u in ["quic://h:1", "tcp://h", "tcp://h:0", "tcp://h:65536", "tcp://:1", "tcp://a b:1", "tcp://[::1]:1", "tcp://h:x"])


@pytest.mark.parametrize("n,want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), ((1 << 20) - 1, "1023.9 KB"), (1 << 20, "1.0 MB"), (1 << 30, "1.0 GB"), (5 << 40, "5.0 TB"), (3 << 50, "3072.0 TB")])
def test_size_text(spark, n, want):
    assert value(spark, text.format_size(F.lit(n))) == want


def test_other_texts(spark):
    assert [value(spark, text.format_duration(F.lit(m))) for m in (0, 59, 60, 276, 1439, 1440, 3180)] == ["0m", "59m", "1h 0m", "4h 36m", "23h 59m", "1d 0h", "2d 5h"]
    cases = {"+2": 7200, "-03:30": -12600, "14:00": 50400, "14:01": None, "5.45": 20700, "2:60": None, "x": None, "": None, " 1 ": 3600, "1h": None, "+": None}
    for t, want in cases.items():
        assert value(spark, text.tz_offset(F.lit(t))) == want == config.tz_seconds(t), t
    assert [value(spark, text.protection_bits(F.lit(m))) for m in (0o777, 0o644, 0o444, 0)] == [0, 2, 7, 15]
    assert value(spark, text.display_label(F.lit(""), F.lit("id"))) == "id" and value(spark, text.mode_of(F.lit("SendOnly"))) == 1 and value(spark, text.mode_of(F.lit("x"))) is None
    assert [value(spark, text.mode_text(F.lit(k))) for k in range(3)] == ["sendreceive", "sendonly", "receiveonly"]


def ignored(rules, path):
    """The rules read one by one, as a model of the expressions."""
    low = globs._lower(path)
    for r in globs.parse_rules(rules).rules:
        if _search(globs.rule_regex(r), low):
            return not r.negate
    return False


def _search(pattern, low):
    python = re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern).replace(r"\z", r"\Z")
    return re.search(python, low) is not None


CASES = [
    ("*.tmp", "a.tmp", True), ("*.tmp", "d/A.TMP", True), ("*.tmp", "a.tmp/x", True), ("*.tmp", "a.tmpx", False), ("!keep.tmp\n*.tmp", "keep.tmp", False), ("*.tmp\n!keep.tmp", "keep.tmp", True),
    ("/top", "top", True), ("/top", "d/top", False), ("logs/**", "logs/a/b", True), ("logs/**", "log/a", False), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/xb", True), ("a/*/b", "a/x/y/b", False),
    ("[!a-c]*", "dog", True), ("[!a-c]*", "cat", False), ("[a-c]at", "Bat", True), ("[]x", "]x", False), ("[ab", "a", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("(?i)(?d)foo", "FOO", True),
    ("// foo\n# x\n", "foo", False), ("d", "d/e", True), ("d/e", "d/e/f", True), ("d/e", "x/d/e", False), ("*", "anything/at/all", True), ("a**b", "axxb", True), ("a.b", "axb", False), ("x$y^z(1)", "X$Y^Z(1)", True),
]


def test_globs(spark):
    for rules, path, want in CASES:
        assert ignored(rules, path) == want, (rules, path)
        assert value(spark, globs.ignored(F.lit(path), globs.parse_rules(rules).rules)) == want, (rules, path)


def test_random_globs_agree_in_java_and_python(spark):
    rng = random.Random(7)
    rules = "\n".join("".join(rng.choice(["a", "B", "/", "*", "**", "?", "[a-c]", "[!b]", ".", "!"]) for _ in range(rng.randrange(1, 6))) for _ in range(40))
    names = ["".join(rng.choice("abc./") for _ in range(rng.randrange(1, 8))) for _ in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "name string").select("name", globs.ignored(F.col("name"), globs.parse_rules(rules).rules).alias("i"))
    assert all(r.i == ignored(rules, r.name) for r in df.collect())


def test_rule_files():
    many = globs.parse_rules("\n".join(f"p{k}" for k in range(53)) + "\n" + "x" * 200)
    assert len(many.rules) == 48 and many.dropped == 6
    files = {".stignore": "#include more\r\n*.a\r\n", "more": "*.b\n#include .stignore\n", "big": "x\n" * 5000}
    got = globs.load_rules(files.get)
    assert [r.glob for r in got.rules][:2] == ["*.b", "*.b"] and got.rules[-1].glob == "*.a"
    assert globs.load_rules(lambda n: None).rules == [] and globs.load_rules(files.get, "big") is None

    def broken(name):
        raise OSError

    assert globs.load_rules(broken) is None
    a, b = globs.parse_rules("# one\nx\ny"), globs.parse_rules("x\n// two\ny")
    assert globs.fingerprint(a.rules) == globs.fingerprint(b.rules) != globs.fingerprint(globs.parse_rules("y\nx").rules)


def test_name_hashes(spark):
    from replisift.functions import hashing
    from replisift.sources import files

    names = ["", "a", "foobar", "dir/é日本", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", hashing.fnv32(F.encode("n", "UTF-8")).alias("a"), hashing.fnv64(F.encode("n", "UTF-8")).alias("b"))
    for r in df.collect():
        h = 0x811C9DC5
        for x in r.n.encode():
            h = (h ^ x) * 0x01000193 & 0xFFFFFFFF
        assert r.a == h and files.state_name(r.n) == f"{r.b}.idx"
    assert {r.n: r.b for r in df.collect()}["foobar"] == "85944171f73967e8"  # a published value


def test_civil_dates(spark):
    import datetime as dt

    from replisift.functions import text

    times = [0, -1, 86399, 951854402, -2208988800, 4102444799, 1709164800]
    for r in spark.createDataFrame([(t,) for t in times], "t long").select("t", text.civil(F.col("t")).alias("c")).collect():
        d = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=r.t)
        assert tuple(r.c) == (d.year, d.month, d.day, d.hour, d.minute, d.second)
    rows = spark.createDataFrame([(1970, 1, 1), (2024, 2, 30), (2023, 14, 1), (1969, 12, 31), (2024, 0, 1)], "y int, m int, d int")
    assert [r.n for r in rows.select(text.days_of(F.col("y"), F.col("m"), F.col("d")).alias("n")).collect()] == [0, 19783, 19754, -1, 19692]
