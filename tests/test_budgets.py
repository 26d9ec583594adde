"""Greedy budgets by composed ranges against plain folds: messages by count and bytes, wants by count and blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from replisift.operators import budgets as B


def message_fold(sizes, most, most_bytes):
    out, batch, count, used = [], -1, 0, 0
    for n in sizes:
        if not count or count >= most or used + n > most_bytes:
            batch, count, used = batch + 1, 0, 0
        count, used = count + 1, used + n
        out.append(batch)
    return out


def want_fold(sizes, budget, most):
    left, count, out = budget, 0, []
    for n in sizes:
        takes = 0 <= n <= left and (most is None or count < most)
        left, count = left - n * takes, count + takes
        out.append(bool(takes))
    return out


def cut(rng, sizes):
    """The sizes in ranges of any lengths."""
    out, at = [], 0
    while at < len(sizes):
        n = rng.choice([1, 2, 3, 10, 200])
        out.append(np.array(sizes[at : at + n], np.int64))
        at += n
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ranges_compose(seed):
    rng = random.Random(seed)
    for _ in range(150):
        sizes = [rng.choice([0, 1, 5, 30, 99, 1000]) if rng.random() < 0.5 else rng.randrange(60) for _ in range(rng.randrange(1, 300))]
        most, most_bytes = rng.choice([1, 2, 7, 256]), rng.choice([0, 10, 100, 1000])
        ranges = cut(rng, sizes)
        entries = B.compose_batches([B.batch_table(r, most, most_bytes) for r in ranges], most, most_bytes)
        got = np.concatenate([B.assign_batches(r, e, most, most_bytes) for r, e in zip(ranges, entries, strict=True)])
        assert got.tolist() == message_fold(sizes, most, most_bytes)
        budget, cap = rng.choice([0, 5, 64, 500]), rng.choice([None, 0, 1, 9, 100])
        entries = B.compose_wants([B.want_table(r, budget) for r in ranges], budget)
        got = np.concatenate([B.take_wants(r, e, cap) for r, e in zip(ranges, entries, strict=True)])
        assert got.tolist() == want_fold(sizes, budget, cap)


def test_one_key_of_two_million_rows(spark):
    """No task has the key alone, and the batches are those of a fold."""
    n = 2_000_000
    rows = spark.range(n).select(F.lit("f").alias("folder"), "id", F.pmod(F.xxhash64("id"), F.lit(900)).alias("size"))
    sizes = rows.select("size").toPandas()["size"].to_numpy()
    got = B.message_batches(rows.repartition(8, F.rand(3)), ["folder"], ["id"], "size", parts=16).toPandas().sort_values("id")
    assert got["batch"].tolist() == message_fold(sizes.tolist(), B.BATCH, B.BATCH_BYTES)
    taken = B.fitting_wants(rows, ["folder"], ["id"], "size", most_blocks=2048, most=50, parts=16).toPandas()
    assert sorted(taken["id"]) == np.flatnonzero(want_fold(sizes.tolist(), 2048, 50)).tolist()


def test_keys_ties_and_nulls(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "b", None]), k, rng.choice([None, 0, 3, 40, 200])) for k in range(900)]
    df = spark.createDataFrame(data, "folder string, k long, size long").repartition(5)
    got = {(r.folder, r.k): r.batch for r in B.message_batches(df, ["folder"], ["k"], "size", 7, 100, parts=4).collect()}
    taken = {(r.folder, r.k) for r in B.fitting_wants(df, ["folder"], ["k"], "size", 150, 20, parts=4).collect()}
    for folder in ("a", "b", None):
        own = [(k, s or 0) for f, k, s in data if f == folder]
        want = message_fold([s for _, s in own], 7, 100)
        assert [got[folder, k] for k, _ in own] == want
        fits = [x for x in own if x[1] <= 150]
        assert {(folder, k) for (k, _), ok in zip(fits, want_fold([s for _, s in fits], 150, 20), strict=True) if ok} == {t for t in taken if t[0] == folder}
    assert B.message_batches(df.where("false"), ["folder"], ["k"], "size").count() == 0
    with pytest.raises(ValueError):
        B.message_batches(df, ["folder"], ["k"], "size", most=0)
