"""Nearest neighbours: recall against brute force, ties, awkward vectors."""

import numpy as np
import pytest

from replisift.llm import ann

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, k):
    """Per query id the k best by a plain product."""
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order[:k]]
    return out


def recall(df, ids, vectors, k=20, **own):
    got = {}
    for r in ann.nearest(df, k=k, **own).collect():
        got.setdefault(r.query_id, []).append(r)
    want, hits = brute(ids, vectors, k), 0
    assert set(got) == set(want)
    for q, best in want.items():
        rows = sorted(got[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        truth = dict(best)
        hits += len(truth.keys() & {r.vec_id for r in rows})
        place = {int(i): n for n, i in enumerate(ids)}
        assert all(abs(r.score - vectors[place[q]] @ vectors[place[r.vec_id]]) < 1e-9 for r in rows)
    return hits / sum(map(len, want.values()))


def table(spark, ids, vectors):
    rows = [(int(i), [float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = df.select("vec_id", "embedding").toPandas()
    assert recall(df, local.vec_id.to_numpy(), np.array(local.embedding.tolist(), float)) >= 0.9


@pytest.mark.parametrize("unit", [True, False])
def test_recall_over_shards_with_a_crowd(spark, unit):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((9000, 24))
    vectors[:3000] = vectors[0] + 0.001 * rng.standard_normal((3000, 24))  # a third are all but equal
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    if not unit:
        vectors *= rng.uniform(0.2, 3, 9000)[:, None]
    vectors = vectors.astype(np.float32).astype(float)
    assert recall(table(spark, np.arange(9000), vectors), np.arange(9000), vectors) >= 0.9


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((15, 3)).astype(np.float32).astype(float)
    assert recall(table(spark, np.arange(15), vectors), np.arange(15), vectors) == 1


def test_ties_go_to_smaller_ids(spark):
    vectors = np.tile([[0.6, 0.8]], (50, 1)).astype(np.float32)
    rows = ann.nearest(table(spark, np.arange(50), vectors), k=5).where("query_id = 20").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [0, 1, 2, 3, 4] and len({r.score for r in rows}) == 1


def test_awkward_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (3, [-1.0, 0.0])]
    bad = [(40, None), (60, [nan, 1.0]), (80, [inf, 0.0]), (100, [0.0, 0.0]), (4, [1.0, None]), (5, []), (6, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (7, [1e200, 1e200])]
    df = spark.createDataFrame([(i, v, None, 1) for i, v in good + bad], "vec_id long, embedding array<double>, rank string, shard int")
    rows = ann.nearest(df).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(20, 1, 2), (20, 2, 1), (20, 3, 3)]
    assert [r.score for r in rows] == [1.0, 0.5, -1.0]
    none = ann.nearest(df.where("false"))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_probing_keeps_the_pigeonhole_promise():
    """Every code within the radius that the probes guarantee is retrieved."""
    rng = np.random.default_rng(6)
    vectors = rng.standard_normal((2000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    filled = np.column_stack([vectors, np.zeros(2000)])
    rotations = ann.learn_rotations(filled, tables=6)
    own = ann.codes(filled, rotations)
    shard = ann.Shard(np.arange(2000), vectors, 1.0, rotations)
    for q in range(0, 2000, 100):
        distance = np.bitwise_count(own ^ own[q]).sum(axis=1)
        shard.seen[:] = False
        shard._probe(own[q], 0, 6)
        shard._probe(own[q], 1, 6)
        got = set(shard._probe(own[q], 2, 4).tolist())
        assert set(np.flatnonzero(distance <= 6 * 2 + 4 - 1).tolist()) <= got
        near = np.bitwise_count(own ^ own[q])
        assert got == set(np.flatnonzero((near <= 1).any(axis=1) | (near[:, :4] <= 2).any(axis=1)).tolist())
