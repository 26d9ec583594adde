"""Greedy budgets over ordered rows, of any number a key: message batches by count and bytes, want queues by count and blocks.

Both are folds: what becomes of a row depends on all rows before it.  But what a
range of rows does to the state that enters it can be told without knowing that
state, as a small table, and tables compose.  So rows are dealt by ranges of
their order and numbered once; each range gives its table, a key's tables are
composed in order (there are as many as ranges, not rows), and each range is
then worked through from the state that enters it.  No task holds more than a
range, whatever a key's share of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialized, ship

#: Records and bytes of a message, wants and blocks of a queue.
BATCH, BATCH_BYTES, WANTS, WANT_BLOCKS = 256, 64 << 10, 256, 2048


# --- the two folds, over a range's sizes


def next_cuts(sizes: np.ndarray, most: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row where the batch that begins there ends, and the sums of sizes before each row.  A row that is too large goes alone."""
    sums = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = np.arange(len(sizes))
    fits = np.searchsorted(sums, sums[:-1] + most_bytes, side="right") - 1
    return np.maximum(at + 1, np.minimum(at + most, fits)), sums


def first_cut(sums: list[int] | np.ndarray, rows: int, count: int, used: int, most: int, most_bytes: int) -> int:
    """How many rows join an open batch of ``count`` rows and ``used`` bytes; of none (count 0) none do."""
    if not count:
        return 0
    return max(0, min(rows, most - count, int(np.searchsorted(sums, most_bytes - used, side="right")) - 1))


def batch_table(sizes: np.ndarray, most: int, most_bytes: int) -> tuple:
    """(rows, sums, count, used, cuts): by the number of rows that join the open batch, what is open at the range's end and how many batches began."""
    n = len(sizes)
    ends, sums = next_cuts(sizes, most, most_bytes)
    ends, last, cuts = ends.tolist(), list(range(n)), [1] * n
    for k in range(n - 1, -1, -1):
        if ends[k] < n:
            last[k], cuts[k] = last[ends[k]], cuts[ends[k]] + 1
    head = min(n, most)  # more never join an open batch
    return n, sums[: head + 1].tolist() + [int(sums[n])], [n - k for k in last[:head]], [int(sums[n] - sums[k]) for k in last[:head]], cuts[:head]


def compose_batches(tables: list[tuple], most: int, most_bytes: int) -> list[tuple[int, int, int]]:
    """The (count, used, batch) that enters each of a key's ranges."""
    out, count, used, batch = [], 0, 0, -1
    for n, sums, counts, useds, cuts in tables:
        out.append((count, used, batch))
        k = first_cut(sums[:-1], n, count, used, most, most_bytes)
        if k == n:
            count, used = count + n, used + sums[-1]
        else:
            count, used, batch = counts[k], useds[k], batch + cuts[k]
    return out


def assign_batches(sizes: np.ndarray, entry: tuple[int, int, int], most: int, most_bytes: int) -> np.ndarray:
    """The batch of each row of a range."""
    count, used, batch = entry
    ends, sums = next_cuts(sizes, most, most_bytes)
    at = first_cut(sums, len(sizes), count, used, most, most_bytes)
    out = np.empty(len(sizes), np.int64)
    out[:at] = batch
    while at < len(sizes):
        batch += 1
        out[at : ends[at]] = batch
        at = int(ends[at])
    return out


def want_table(sizes: np.ndarray, budget: int) -> tuple:
    """(rest, taken): by the blocks that are left when a range begins, those left at its end and the wants it takes.

    All states go through at once; a row that no state can take costs nothing.
    """
    rest, taken = np.arange(budget + 1), np.zeros(budget + 1, np.int64)
    at, most = 0, budget
    while at < len(sizes):
        fits = np.flatnonzero(sizes[at : at + 8192] <= most)
        if not len(fits):
            at += 8192
            continue
        at += int(fits[0])
        take = rest >= sizes[at]
        rest -= np.where(take, sizes[at], 0)
        taken += take
        most = int(rest.max())
        at += 1
    return rest.tolist(), taken.tolist()


def compose_wants(tables: list[tuple], budget: int) -> list[tuple[int, int]]:
    """The (blocks left, wants taken) that enter each of a key's ranges."""
    out, left, count = [], budget, 0
    for rest, taken in tables:
        out.append((left, count))
        left, count = rest[left], count + taken[left]
    return out


def take_wants(sizes: np.ndarray, entry: tuple[int, int], most: int | None) -> np.ndarray:
    """Which rows of a range are taken.  The number of wants only ends what the blocks decide."""
    left, count = entry
    out = np.zeros(len(sizes), bool)
    at = 0
    while at < len(sizes) and (most is None or count < most):
        fits = np.flatnonzero(sizes[at : at + 8192] <= left)
        if not len(fits):
            at += 8192
            continue
        at += int(fits[0])
        out[at] = True
        left, count, at = left - int(sizes[at]), count + 1, at + 1
    return out


# --- on Spark


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int]]:
    """(rows, range) of each piece (key and range) of rows that stand in order; a piece is bounded by its range."""
    held: list[pa.RecordBatch] = []

    def mark(batch: pa.RecordBatch, k: int) -> tuple:
        return tuple(batch.column(c)[k].as_py() for c in ("__key", "__part"))

    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("__part").to_numpy()
        keys = batch.column("__key").to_numpy(zero_copy_only=False)
        borders = np.flatnonzero((parts[1:] != parts[:-1]) | (keys[1:] != keys[:-1])) + 1
        for a, b in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows], strict=True):
            if held and mark(held[-1], 0) != mark(batch, a):
                yield pa.Table.from_batches(held), held[0].column("__part")[0].as_py()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held), held[0].column("__part")[0].as_py()


def _folded(rows: DataFrame, by: list[str], order: list[str], size: str, parts: int | None, table_type: str, entry_type: str, table: Callable, compose: Callable, apply: Callable, out: str) -> DataFrame:
    """``rows`` (by, order, size) with ``out``: tables of ranges, composed a key, then applied."""
    ship(rows.sparkSession)
    keys = [*by, *order]
    slim = rows.select(*keys, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))
    ranged = slim.repartitionByRange(parts, *keys) if parts else slim.repartitionByRange(*keys)
    # Written once: the ranges' bounds are sampled and must not change between the passes.
    fixed = materialized(ranged.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "budget")
    named = fixed.withColumns({"__part": F.shiftright("__at", 33), "__key": F.xxhash64(*by) if by else F.lit(0).cast("long")})
    dealt = named.repartition("__part").sortWithinPartitions("__part", "__at")
    only = dealt.select("__key", "__part", "__size")
    told = T._parse_datatype_string(f"__key long, __part long, {table_type}")
    names = told.names[2:]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(told)
        for piece, part in _pieces(batches):
            row = (piece.column("__key")[0].as_py(), part, *table(piece.column("__size").to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    tables = only.mapInArrow(summarise, told)
    entries_type = T._parse_datatype_string(f"__key long, __part long, {entry_type}")

    def composed(group: pa.Table) -> pa.Table:
        group = group.sort_by("__part")
        given = list(zip(*(group.column(c).to_pylist() for c in names), strict=True))
        entries = compose(given)
        columns = [group.column("__key").combine_chunks(), group.column("__part").combine_chunks()]
        return pa.table(columns + [pa.array(c, pa.int64()) for c in zip(*entries, strict=True)], names=entries_type.names)

    entries = tables.groupBy("__key").applyInArrow(composed, entries_type)
    joined = named.join(entries, ["__key", "__part"])
    result = T.StructType([*slim.select(*keys).schema.fields, T.StructField(out, T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _ in _pieces(batches):
            entry = tuple(piece.column(c)[0].as_py() for c in entries_type.names[2:])
            got = apply(piece.column("__size").to_numpy(), entry)
            whole = piece.select(keys).append_column(out, pa.array(got, pa.int64()))
            yield from whole.to_batches()

    ordered = joined.repartition("__part").sortWithinPartitions("__part", "__at")
    return ordered.select(*keys, "__key", "__part", "__size", *entries_type.names[2:]).mapInArrow(work, result)


def message_batches(rows: DataFrame, by: list[str], order: list[str], size: str, most: int = BATCH, most_bytes: int = BATCH_BYTES, parts: int | None = None) -> DataFrame:
    """(by, order, ``batch``): which message of its key each row goes into, from 0: at most ``most`` rows of ``most_bytes`` bytes; one that is larger goes alone.

    ``order`` must be unique within a key.  Null sizes count nothing.  ``parts``:
    the number of ranges, by default that of the session's shuffle partitions.
    No row: no row.  Keys are told apart by 64-bit hashes.
    """
    if most < 1 or most_bytes < 0:
        raise ValueError("a message has a row at least")
    return _folded(
        rows, by, order, size, parts, "rows long, sums array<long>, counts array<long>, useds array<long>, cuts array<long>", "count long, used long, batch long",
        lambda sizes: batch_table(sizes, most, most_bytes), lambda tables: compose_batches(tables, most, most_bytes), lambda sizes, entry: assign_batches(sizes, entry, most, most_bytes), "batch",
    )


def fitting_wants(rows: DataFrame, by: list[str], order: list[str], size: str, most_blocks: int = WANT_BLOCKS, most: int | None = WANTS, parts: int | None = None) -> DataFrame:
    """(by, order) of the rows that are taken in order within the budget: a row that doesn't fit takes nothing, so smaller ones after it may.

    Rows with negative sizes or sizes above the budget are never taken.  Other
    cases as in :func:`message_batches`.  A range's table has a row for each
    number of blocks that may be left, so ``most_blocks`` bounds it.
    """
    possible = rows.where(F.coalesce(F.col(size), F.lit(0)).between(0, most_blocks))
    marked = _folded(
        possible, by, order, size, parts, "rest array<long>, taken array<long>", "left_over long, count long",
        lambda sizes: want_table(sizes, most_blocks), lambda tables: compose_wants(tables, most_blocks), lambda sizes, entry: take_wants(sizes, entry, most).astype(np.int64), "__taken",
    )
    return marked.where("__taken = 1").drop("__taken")
