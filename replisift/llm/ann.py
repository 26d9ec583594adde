"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

**Codes.**  A vector gets one more component that fills its length up to the
longest one's, so that the largest inner product is the smallest angle.  Its code
is the signs after rotations that are learned on a bounded sample: principal
directions, then alternating between signs and the rotation that fits them best
(iterative quantisation), from as many different starts as the code has need of.

**Index.**  A code is cut into substrings of 16 bits, each with a table of its
own from its value to the vectors that have it.  Probing all values within ``r``
bits of a query's in every one of ``m`` tables, and within ``r + 1`` in ``a`` of them,
retrieves, by the pigeonhole principle, every code within a Hamming radius of
``m * (r + 1) + a - 1``, and many beyond.
What is retrieved is ranked by inner products of the vectors themselves.

**Radius.**  ``r`` grows for each query until a vector as near as the last of the
best found would have been missed by all tables with a probability of ``miss``
at most, by the share of bits that differ at its angle.

**Spark.**  Vectors are dealt to shards by a hash of their ids, so a crowd of
like vectors spreads evenly, and each shard has the tables of its own vectors.
Queries are dealt to blocks alike; each (shard, block) is a group of its own,
of bounded size, and gives the best of a query in that shard.  Sizes of shards
and blocks grow with the root of the table's, so that what is shipped
grows less than the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ._common import Scratch, ship

#: Vectors of the sample that rotations are learned on.
SAMPLE, ROUNDS = 4096, 10
#: Substrings (tables) of a code and the most bits by which a probed value may differ.
TABLES, WORD, FURTHEST = 96, 16, 3
_VALUES = (1 << WORD) + 1
#: The accepted probability that a vector as near as the last of the best is missed.
MISS = 0.08
#: Vectors in a shard: a multiple of the table's root between these bounds; a block of queries has a fourth.
SHARD_FACTOR, SHARD_LEAST, SHARD_MOST = 32, 4096, 131_072


def _masks() -> list[np.ndarray]:
    values = np.arange(1 << WORD, dtype=np.uint16)
    ones = np.bitwise_count(values)
    return [values[ones == k] for k in range(FURTHEST + 1)]


def hit_rate(share: float, within: int) -> float:
    """The probability that a substring's bits differ in ``within`` places at most, where a share of all bits differs."""
    return sum(math.comb(WORD, k) * share**k * (1 - share) ** (WORD - k) for k in range(within + 1))


def learn_rotations(sample: np.ndarray, tables: int = TABLES, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Columns of rotations whose signs are the code: ``tables * 16`` of them, learned on the rows of ``sample``."""
    width, bits = sample.shape[1], tables * WORD
    rng, found = np.random.default_rng(seed), []
    _, directions = np.linalg.eigh(sample.T @ sample)
    turned = sample @ directions[:, ::-1]
    for _ in range(-(-bits // width)):
        rotation, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(rounds if len(sample) else 0):
            left, _, right = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
            rotation = (left @ right).T
        found.append(directions[:, ::-1] @ rotation)
    return np.hstack(found)[:, :bits]


def codes(vectors: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """The codes of vectors, a substring of 16 bits a column."""
    out = np.empty((len(vectors), rotations.shape[1] // WORD), np.uint16)
    for at in range(0, len(vectors), 4096):
        signs = np.packbits(vectors[at : at + 4096] @ rotations >= 0, axis=1)
        out[at : at + 4096] = signs[:, ::2].astype(np.uint16) << 8 | signs[:, 1::2]
    return out


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the order of components, so equal vectors have equal ones."""
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        total += vectors[:, k] * query[k]
    return total


class Shard:
    """The tables of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, rotations: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.rotations = ids[order], vectors[order], rotations
        unit = self.vectors / longest
        rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", unit, unit)))
        own = codes(np.column_stack([unit, rest]), rotations)
        tables, n = own.shape[1], len(own)
        # Of each table the vectors by value, and where each value begins; all tables end to end.
        self.order, self.starts = np.empty(tables * n, np.int32), np.empty(tables * _VALUES, np.int64)
        for t in range(tables):
            by_value = np.argsort(own[:, t], kind="stable")
            self.order[t * n : (t + 1) * n] = by_value
            self.starts[t * _VALUES : (t + 1) * _VALUES] = t * n + np.searchsorted(own[by_value, t], np.arange(_VALUES))
        self.first = np.arange(tables, dtype=np.int64)[:, None] * _VALUES
        self.masks, self.longest, self.seen = _masks(), longest, np.zeros(n, bool)

    def _probe(self, code: np.ndarray, within: int, tables: int) -> np.ndarray:
        """Places of all vectors retrieved so far, now with those that have a substring exactly ``within`` bits from the query's in the first ``tables``."""
        values = ((self.masks[within] ^ code[:tables, None]) + self.first[:tables]).ravel()
        begin = self.starts[values]
        sizes = self.starts[values + 1] - begin
        some = np.flatnonzero(sizes)
        begin, sizes = begin[some], sizes[some]
        ends = np.cumsum(sizes)
        if len(ends):
            self.seen[self.order[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])]] = True
        return np.flatnonzero(self.seen)

    def search(self, query_id: int, query: np.ndarray, code: np.ndarray, k: int, share: int, miss: float) -> list[tuple[int, float]]:
        """(id, inner product) of the best ``k`` retrieved, without the query's own; at least ``share`` if there are so many."""
        self.seen[:] = False
        length, count = math.sqrt(float(query @ query)), len(self.first)
        within, tables = 0, count
        while True:
            places = self._probe(code, within, tables) if within <= FURTHEST else np.arange(len(self.ids))  # beyond: all of the shard
            places = places[self.ids[places] != query_id]
            scores = inner_products(self.vectors[places], query) if len(places) <= 64 else self.vectors[places] @ query
            if within > FURTHEST or tables < count:
                break
            if len(places) >= share:
                last = np.partition(scores, len(scores) - share)[len(scores) - share]
                angle = math.acos(max(-1.0, min(1.0, last / (length * self.longest)))) / math.pi
                missed, next_missed = 1 - hit_rate(angle, within), 1 - hit_rate(angle, within + 1)
                if missed**count <= miss:
                    break
                # One bit further in as many tables as it takes.
                if next_missed**count <= miss:
                    tables = math.ceil((math.log(miss) - count * math.log(missed)) / (math.log(next_missed) - math.log(missed))) if next_missed > 0 else count
            within += 1
        if len(places) > k:
            # A fast product first; what it can't tell apart from the last of the best is summed in order.
            edge = np.partition(scores, len(scores) - k)[len(scores) - k]
            places = places[scores >= edge - 1e-9 * length * self.longest]
        scores = inner_products(self.vectors[places], query)
        best = np.lexsort((self.ids[places], -scores))[:k]
        return [(int(self.ids[places[b]]), float(scores[b])) for b in best]


def _usable(vector: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and a squared length that is a positive finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    square = _square(vector)
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & (square > 0) & (square < F.lit(float("inf")))


def _square(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)


def _rows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return table.column("id").to_numpy(), np.asarray(vectors, np.float64).reshape(-1, width)


def nearest(
    df: DataFrame,
    k: int = 20,
    query: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    miss: float = MISS,
    sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row of ``df`` its ``k`` rows of largest inner product among those found, its own left out.

    ``query``: which rows are queries, by default those whose id is divisible by
    20; candidates are all rows.  ``score`` is the inner product in double
    precision; ties go to the smaller id.  Fewer rows than ``k``: all of them.
    Rotations are learned on the ``sample`` rows with the smallest hashes of their ids.

    Null, zero, empty or overlong vectors (whose squared length is no finite
    double) and vectors with null or non-finite components take no part, nor do
    rows without an id, nor vectors of another number of components than the
    most frequent one (ties: the smaller).  Of rows that share an id the one with
    the greatest vector counts.  Equal vectors: told apart by id.  Empty table: no
    row.  Columns other than the two named are read for ``query`` only.
    """
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    asked = F.coalesce(query if query is not None else F.col(id_col) % 20 == 0, F.lit(False))
    given = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), asked.alias("asked"))
    usable = given.where(F.col("id").isNotNull() & _usable(F.col("v")))
    # Partial maxima first: an id with very many rows is one row a task.
    one = usable.groupBy("id").agg(F.max(F.struct("v", "asked")).alias("r")).select("id", "r.v", "r.asked")
    held = scratch.write(one, "vectors")
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    sizes = held.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.count_if("asked").alias("queries"), F.max(_square(F.col("v"))).alias("square"))
    most = sizes.orderBy(F.desc("n"), "width").first()
    if most is None:
        return spark.createDataFrame([], out).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    width, n, longest = most.width, most.n, math.sqrt(most.square)
    held = held.where(F.size("v") == width)
    taken = held.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    units = np.asarray(taken.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) / longest
    filled = np.column_stack([units, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", units, units)))])
    rotations = learn_rotations(filled, tables)

    per_shard = min(SHARD_MOST, max(SHARD_LEAST, int(SHARD_FACTOR * math.sqrt(n))))
    shards, blocks = -(-n // per_shard), max(1, -(-most.queries // (per_shard // 4)))
    # How many of the best a shard has, with room for chance.
    share = min(k, math.ceil(k / shards + 2 * math.sqrt(k / shards))) if shards > 1 else k

    def deal(count: int, salt: str) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")

    everywhere = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    stored = held.select("id", "v", F.lit(False).alias("asks"), deal(shards, "shard").alias("shard")).withColumn("block", everywhere(blocks))
    asking = held.where("asked").select("id", "v", F.lit(True).alias("asks"), deal(blocks, "block").alias("block")).withColumn("shard", everywhere(shards))

    def search(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        found: tuple[list, list, list] = ([], [], [])
        if asks.any() and not asks.all():
            ids, vectors = _rows(table.filter(pa.array(~asks)), width)
            shard = Shard(ids, vectors, longest, rotations)
            ids, vectors = _rows(table.filter(pa.array(asks)), width)
            for q, vector, code in zip(ids.tolist(), vectors, codes(np.column_stack([vectors, np.zeros(len(vectors))]), rotations), strict=True):
                for v, score in shard.search(q, vector, code, k, min(share, len(shard.ids)), miss):
                    found[0].append(q)
                    found[1].append(v)
                    found[2].append(score)
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], names=out.names)

    met = stored.select("id", "v", "asks", "shard", "block").unionByName(asking.select("id", "v", "asks", "shard", "block"))
    near = met.groupBy("shard", "block").applyInArrow(search, out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
