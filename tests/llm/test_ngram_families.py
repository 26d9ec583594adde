"""Families that overlap, and signatures that only members apart from their hub can make count."""

import random
from collections import Counter, defaultdict

import pytest

from replisift.llm import ngram_join as J
from replisift.llm._common import Scratch
from tests.llm.helpers import docs
from tests.llm.test_ngram_join import brute


def pairs(rows):
    groups = defaultdict(set)
    for hub, one in rows:
        groups[hub] |= {hub, one}
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def test_merged_families_keep_every_pair(spark):
    rng = random.Random(4)
    rows = [(1, x) for x in range(2, 90)]
    rows += [(7, x) for x in rng.sample(range(8, 95), 60)] + [(9, x) for x in range(10, 40)]  # both lie mostly in 1's
    rows += [(20, x) for x in range(100, 150)]  # its hub is in 1's, its members aren't
    rows += [(300, x) for x in range(301, 340)] + [(50, 51), (50, 99)]  # apart, and small
    families = spark.createDataFrame(rows, "hub long, id long").repartition(5)
    weight = spark.createDataFrame([(x,) for x in range(400)], "id long").selectExpr("id", "10L AS n")
    scratch = Scratch(spark, "merged")
    got = [tuple(r) for r in J._merged(scratch.write(families, "families"), weight, 8, scratch).collect()]
    assert len(got) == len(set(got)) < len(rows)
    assert {h for h, _ in got} == {1, 20, 50, 300}
    assert pairs(got) >= pairs(rows)
    nothing = scratch.write(families.limit(0), "families")
    assert J._merged(nothing, weight, 8, scratch).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_signatures_count_if_one_apart_has_them(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(J, "FREQUENT", 1)
        monkeypatch.setattr(J, "SAMPLED", 2)
    rng = random.Random(5)
    rows = list({(rng.randrange(60), i): (rng.random() < 0.2) for i in range(300) for _ in range(3)}.items())
    df = spark.createDataFrame([(s, i, a) for (s, i), a in rows], "sig long, id long, apart boolean").repartition(3)
    members = defaultdict(list)
    for (s, i), a in rows:
        members[s].append((not a, i))
    expected = {(min(g)[1], i) for g in members.values() if not min(g)[0] for _, i in g} - {(i, i) for i in range(300)}
    got = Counter(map(tuple, J._families(df).collect()))
    assert set(got) == expected and set(got.values()) == {1}


@pytest.mark.parametrize("streamed", [0, 8])
def test_near_copies_around_the_threshold(spark, monkeypatch, streamed):
    """A text and copies with more and less noise: many families of the same members, many of them apart from the hub."""
    monkeypatch.setattr(J, "STREAMED", streamed)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(14)):
            words[at] = f"x{rng.randrange(10**6)}"
        texts.append((k, " ".join(words)))
    texts += [(1000 + k, " ".join(base[:60]) + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(60))) for k in range(100)]
    got = Counter(tuple(r) for r in J.similar_documents(docs(spark, texts), 5, 80, block=16).collect())
    assert got == brute(texts, 5, 80)
