"""The similarity join against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from replisift.llm import ngram_join as J
from tests.llm.helpers import TEXTS, docs, empty


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(texts, n, percent):
    sets = [(i, shingles(t, n)) for i, t in texts]
    up = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                up[y] = x
    out = []
    for i, s in sets:
        comp = find(i) if i is not None else min((find(j) for j, t in sets if j is not None and s and t == s), default=None)
        out.append((i, len(s), comp))
    return Counter(out)


def corpus(seed, bases=12, copies=12, vocabulary=4000):
    rng, texts = random.Random(seed), []
    word = lambda: f"w{rng.randrange(vocabulary)}"
    passage = [word() for _ in range(40)]
    for b in range(bases):
        base = [word() for _ in range(rng.choice([3, 8, 12, 20, 30, 60, 90, 150, 300]))]
        if b % 3 == 0:
            base[5:5] = passage
        for c in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1, 2])] = [word()]
            texts.append((len(texts), rng.choice([" ", "\n", "  "]).join(w.upper() if rng.random() < 0.2 else w for w in own)))
    rng.shuffle(texts)
    return texts


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("aAbB \n\té1")), max_size=60), st.text(st.sampled_from(list("aAbB \n\té1")), max_size=60))
def test_sets(a, b):
    for n in (1, 3, 5):
        x, y = J.shingle_set(a.encode(), n), J.shingle_set(b.encode(), n)
        assert len(x) == len(shingles(a, n)) and len(np.intersect1d(x, y)) == len(shingles(a, n) & shingles(b, n))


@pytest.mark.parametrize("percent", [80, 90, 50])
def test_similar_sets_share_a_signature(percent):
    rng = random.Random(percent)
    for _ in range(1500):
        n = rng.choice([1, 5, 9, 10, 11, 15, 20, 40, 100, 300])
        s = {rng.getrandbits(64) for _ in range(n)}
        t = set(s)
        for _ in range(rng.randrange(0, 2 + n * (100 - percent) // 60)):
            if rng.random() < 0.5 and len(t) > 1:
                t.discard(rng.choice(sorted(t)))
            else:
                t.add(rng.getrandbits(64))
        if s != t and 100 * len(s & t) >= percent * len(s | t):
            a, b = (np.unique(np.array(sorted(x), np.uint64)) for x in (s, t))
            assert set(J.signatures(a, percent).tolist()) & set(J.signatures(b, percent).tolist())


@pytest.mark.parametrize("n,percent,block", [(3, 90, 512), (5, 80, 4), (3, 70, 2)])
def test_components_of_a_corpus(spark, n, percent, block):
    texts = corpus(n * percent) + [(10_000 + k, "same copy of a text with some words in it") for k in range(30)]
    got = J.similar_documents(docs(spark, texts), n, percent, block=block)
    want = brute(texts, n, percent)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert 20 < len({c for _, _, c in want}) < len(texts) - 30


def test_awkward(spark):
    texts = TEXTS + [(None, TEXTS[0][1]), (0, TEXTS[0][1]), (3, "another text under an id that is there")]
    got = Counter(tuple(r) for r in J.similar_documents(docs(spark, texts), 3, 90).collect())
    assert got == brute(texts, 3, 90)
    assert J.similar_documents(empty(spark), 3, 90).count() == 0
    kept = J.one_of_each(docs(spark, texts), 3, 90)
    assert kept.columns == docs(spark).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([0, 2, 3, 4, 6, 7, 8, 9, None, None], key=str)
    assert J.one_of_each(empty(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(200), 100 + rng.randrange(200)) for _ in range(90)] + [(500, k) for k in range(501, 600)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.id: r.component for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
