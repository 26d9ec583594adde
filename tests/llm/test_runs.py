"""Runs of words against brute force, the count of comparisons, awkward texts."""

import hashlib
import random
import re
import zlib

import pytest

from replisift.llm import periodic_runs as R
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def brute(t, times=4, shortest=6):
    """All maximal stretches of each period, without those that a smaller period has."""
    n, out = len(t), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if t[i] != t[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and t[i] == t[i + p]:
                i += 1
            length, w = i + p - s, t[s : i + p]
            if length >= max(shortest, times * p) and not any(w[q:] == w[:-q] for q in range(1, p)):
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(rng):
    letters = rng.choice([1, 2, 2, 3])
    t = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
    if rng.random() < 0.5:
        p = rng.randrange(1, 6)
        t = (t[:p] * 60)[: rng.randrange(1, 40)] + [rng.randrange(letters) for _ in range(rng.randrange(5))] + t[:10]
    return t


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        t, times, shortest = sample(rng), rng.choice([2, 3, 4]), rng.choice([1, 2, 6])
        want = brute(t, times, shortest)
        assert R.runs(t, times, shortest) == want
        assert R.word_runs([b"%d" % x for x in t], times, shortest) == want


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("up", [True, False])
def test_comparisons_are_linear(up):
    rng, n = random.Random(1), 20_000
    for t in (
        [0] * n, fibonacci(n), [k.bit_count() % 2 for k in range(n)], [rng.randrange(2) for _ in range(n)], ([rng.randrange(3) for _ in range(317)] * 70)[:n], list(range(n)), list(range(n, 0, -1)),
        sum(([0] * k + [1] for k in range(200)), []), sum(([0] * k + [1] for k in range(200, 0, -1)), []), (fibonacci(89) * 300)[:n],
    ):
        after, far, compared = R.next_smaller(t, up)
        assert compared <= 3 * len(t)
        for i in range(0, len(t), 997):
            j, k = after[i], far[i]
            assert j == len(t) or (t[i : i + k] == t[j : j + k] and (j + k == len(t) or ((t[i + k] > t[j + k]) == up)))


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def expected(doc_id, text):
    """The contract, written down plainly."""
    words = words_of(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found, dropped = brute(words), set()
    for s, length, p in found:
        dropped |= set(range(s + p, s + length))
    from fractions import Fraction

    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *top, sha("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_equals_brute_force(spark):
    from replisift.llm import queries

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert got == {expected(r.doc_id, r.text) for r in rows} and any(r[1] for r in got)


def test_awkward_texts(spark):
    texts = [*helpers.TEXTS, (10, "ab " * 30_000), (11, "a b a b a b c " * 3 + "x x x x x x\nx"), (12, "x x x x x")]
    docs = helpers.docs(spark, texts)
    got = R.run_digests(docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(expected(i, t)) for i, t in texts)
    runs = {(r.doc_id, r.start, r.length, r.period) for r in R.find_runs(docs).collect()}
    assert (10, 0, 30_000, 1) in runs and (11, 21, 7, 1) in runs and not any(r[0] == 12 for r in runs)
    kept = {r.doc_id: r for r in R.collapse_runs(docs).collect()}
    assert kept[10].text == "ab" and kept[10].n_dropped == 29_999 and kept[3].text == "" and kept[11].text.endswith("b c x")
    assert R.run_digests(helpers.empty(spark)).count() == R.find_runs(helpers.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(docs, times=1)
