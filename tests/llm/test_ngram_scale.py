"""What keeps the similarity join linear: families of unrelated sets, and ids with several texts."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from replisift.llm import ngram_join as J
from tests.llm.helpers import docs
from tests.llm.test_ngram_join import brute


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 9, 10, 12, 15, 20, 30, 60])
def test_unrelated_sets_share_no_signature(n, percent):
    rng = np.random.default_rng(n * percent)
    groups = defaultdict(set)
    for k in range(2000):
        for sig in J.signatures(np.unique(rng.integers(0, 2**64, n, np.uint64)), percent).tolist():
            groups[sig].add(k)
    assert max(map(len, groups.values()), default=0) <= 1


@pytest.mark.parametrize("percent", [80, 90])
def test_short_similar_sets_meet(percent):
    rng = random.Random(percent)
    met = 0
    for _ in range(20000):
        n = rng.randrange(2, 30)
        s = {rng.getrandbits(64) for _ in range(n)}
        t = set(sorted(s)[: rng.randrange(max(1, n - 3), n + 1)]) | {rng.getrandbits(64) for _ in range(rng.randrange(4))}
        if s != t and 100 * len(s & t) >= percent * len(s | t):
            a, b = (np.unique(np.array(sorted(x), np.uint64)) for x in (s, t))
            assert set(J.signatures(a, percent).tolist()) & set(J.signatures(b, percent).tolist())
            met += 1
    assert met > 1000


def quoting(rng, n, shared=60, own=40):
    """Texts that quote one passage and have nothing else in common."""
    word = lambda: f"w{rng.randrange(10**7)}"
    passage = " ".join(word() for _ in range(shared))
    return [(k, f"{passage} " + " ".join(word() for _ in range(own))) for k in range(n)]


def test_a_family_that_does_not_link_needs_no_pairs(spark, monkeypatch):
    texts = quoting(random.Random(1), 3000) + [(9000, "alone"), (9001, "alone")]
    plain, levels = J._block_links, []

    def watched(dealt, words, percent, id_type, streaming):
        assert not streaming
        levels.append(dealt.count())
        return plain(dealt, words, percent, id_type, streaming)

    monkeypatch.setattr(J, "_block_links", watched)
    got = {r.doc_id: r.component_id for r in J.similar_documents(docs(spark, texts), 5, 80, block=64).collect()}
    assert got == {i: 9000 if i == 9001 else i for i, _ in texts}
    assert 2500 < levels[0] < 20 * len(texts) and sum(levels[1:]) < 100


def test_frequent_signatures_are_reduced_first(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(s, i) for i in range(400) for s in (7, 1000 + rng.randrange(300))]
    df = spark.createDataFrame(rows, "sig long, id long").repartition(5)
    plain = Counter(map(tuple, J._families(df).collect()))
    monkeypatch.setattr(J, "FREQUENT", 1)
    monkeypatch.setattr(J, "SAMPLED", 4)
    assert Counter(map(tuple, J._families(df).collect())) == plain and len(plain) >= 399


def test_ids_with_two_texts_bridge(spark):
    a, b = "one two three four five six seven", "ten nine eight seven six five four"
    texts = [(2, a), (5, a), (5, b), (7, b), (9, b), (11, "else")]
    got = Counter(tuple(r) for r in J.similar_documents(docs(spark, texts), 3, 90).collect())
    assert got == brute(texts, 3, 90)


def test_texts_of_one_id(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    texts = [(1, a), (1, b), (1, b), (-4, c), (3, c + " x"), (2, None), (2, ""), (None, a), (6, b + " y")]
    kept = J.one_of_each(docs(spark, texts), by_text=True)
    assert kept.columns == docs(spark).columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got == Counter([(1, a), (1, b), (-4, c), (None, a)]) + Counter({x: 1 for x in got if x[0] == 2})
    assert sum(n for x, n in got.items() if x[0] == 2) == 1
    # without it, one row an id, whatever the partitions
    for parts in (1, 2, 5):
        rows = J.one_of_each(docs(spark, [(1, a), (1, b + " longer"), (1, b)]).repartition(parts)).collect()
        assert [(r.doc_id, r.text) for r in rows] == [(1, b + " longer")]
    named = docs(spark, texts).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    assert J.one_of_each(named, by_text=True).count() == kept.count()


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(J, "SALT", 4)
    monkeypatch.setattr(J, "ONE_TASK", 10)
    edges = [(k, 0) for k in range(1, 3000)] + [(k, k - 1) for k in range(5001, 5040)] + [(5000, 2000)]
    got = {r.id: r.component for r in J.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert set(got.values()) == {0} and len(got) == 2999 + 40 - (0 in got) + (0 in got)
