"""The classifier: learning, counterfactual penalty, held-out accuracy and edge cases."""

import random
import zlib

from replisift.llm import toxicity
from tests.llm.helpers import TEXTS, docs, empty

DATA = "/root/testdata/sf0.1"


def made_up(seed, n=800):
    """Labelled sentences in which one identity term mostly comes with insults."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        words = [rng.choice("sun rain table green walk music house river".split()) for _ in range(12)]
        bad = rng.random() < 0.4
        if bad:
            words[rng.randrange(12)] = rng.choice(["nasty", "rotten"])
        if rng.random() < (0.8 if bad else 0.05):
            words[rng.randrange(12)] = "muslim"
        rows.append((" ".join(words).encode(), int(bad)))
    return rows


def plainly(model):
    """The score by its definition, with nothing of the scorer: distinct words, their beginnings of four to six letters, a sum."""
    import math
    import re

    def score(data):
        text = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in data.decode().lower())
        found = set()
        for w in re.split(" +", text):
            if w:
                found |= {w.encode(), *(b"^" + w[:n].encode() for n in (4, 5, 6) if len(w) >= n)}
        return 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0.0) for f in found))))

    return score


def test_the_penalty_is_on_scores():
    """With a strong penalty swapped sentences score alike, whatever else they hold, and their labels are still learnt."""
    rows = made_up(5)
    tied = toxicity.fit(rows, swap_weight=50.0)
    score = plainly(tied)
    gaps = [abs(score(t) - score(t.replace(b"muslim", b"hindu"))) for t, _ in rows if b"muslim" in t]
    free = plainly(toxicity.fit(rows, swap_weight=0.0))
    loose = [abs(free(t) - free(t.replace(b"muslim", b"hindu"))) for t, _ in rows if b"muslim" in t]
    assert tied.n_swaps > 0 and sum(gaps) < 0.3 * sum(loose)
    right = sum((score(t) >= 0.5) == bool(y) for t, y in rows)
    assert right > 0.95 * len(rows)


def test_swaps_lower_the_scores_of_mentions():
    rows = made_up(1)
    free, tied = toxicity.fit(rows, swap_weight=0.0).scorer(), toxicity.fit(rows, swap_weight=20.0).scorer()
    plain, mention = b"green table by the river", b"green muslim by the river"
    assert tied(mention) - tied(plain) < 0.5 * (free(mention) - free(plain))
    assert tied(b"a nasty house") > 0.3 > tied(mention)


def test_same_rows_same_model():
    assert toxicity.fit(made_up(2)) == toxicity.fit(made_up(2))


def test_without_labels():
    assert toxicity.fit([]).scorer()(b"x") < 0.3
    assert toxicity.fit([(b"a", 0)] * 5).scorer()(b"") < 0.3 < toxicity.fit([(b"a", 1)] * 5).scorer()(b"b")


def test_query_and_filter(spark):
    model = toxicity.fit(made_up(3))
    texts = TEXTS + [(50, "what a nasty rotten walk"), (51, "Nasty!" * 3)]
    rows = toxicity.score_toxicity(docs(spark, texts), model).collect()
    assert len(rows) == len(texts)
    score = plainly(model)
    by = {i: (t or "").encode() for i, t in texts}
    for r in rows:
        assert abs(r.score - score(by[r.doc_id])) < 1e-12 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    kept = toxicity.drop_toxic(docs(spark, texts), model)
    assert kept.columns == docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if not r.predicted)
    assert toxicity.score_toxicity(empty(spark), model).count() == 0


def test_training_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (5, 0), (77, 1)], "doc_id long, toxic int")
    assert isinstance(toxicity.train(docs(spark), labels), toxicity.Model)
    assert toxicity.train(empty(spark), labels.limit(0)).weights == {}


def test_held_out_accuracy(spark):
    documents, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    scored = toxicity.score_toxicity(documents, toxicity.train(documents, labels)).join(labels, "doc_id").where("held_out")
    got = {r.toxic: (r.n, r.p) for r in scored.groupBy("toxic").agg({"*": "count", "predicted": "avg"}).toDF("toxic", "n", "p").collect()}
    assert got[1][1] >= 0.9 and got[0][1] < 0.02
