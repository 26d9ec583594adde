"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir

#: Rows that go to Python at once.  Texts may be long, so batches stay small.
ROWS_PER_BATCH = 500

REPO_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when they share the driver's file system."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)


def release() -> None:
    """Gives memory that Arrow keeps for later back to the system, as a worker may idle after this task."""
    pa.default_memory_pool().release_unused()


_HELD: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What a Python worker remembers between tasks for one operator.

    A worker that turns to another operator forgets the one before, so it never
    holds the memories of several.
    """
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = {}
    return _HELD[owner]


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(name: str) -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b"").cast("binary"))


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[bytes], list[tuple]]],
    out: list[tuple[str, str]],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One narrow pass over (id, text): rows ``(id, *values)``.

    ``make`` runs once a task and returns the function of a text's UTF-8 bytes
    that gives that text's output rows.  The id travels through Arrow untouched,
    so it may be null or repeated.  A task holds one batch of texts at a time.
    """
    ship(df.sparkSession)
    id_type = df.schema[id_col].dataType
    struct = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in out))
    schema = T.StructType([T.StructField(id_col, id_type), *struct.fields])
    arrow = _arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(at, ROWS_PER_BATCH)
                rows: list[tuple] = []
                owner: list[int] = []
                for k, text in enumerate(part.column(1)):
                    got = fn(text.as_py())
                    rows += got
                    owner += [k] * len(got)
                ids = part.column(0).take(pa.array(owner, pa.int64()))
                cols = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([ids, *cols], [id_col, *arrow.names])
        release()

    return df.select(F.col(id_col), text_bytes(text_col).alias("__text")).mapInArrow(run, schema)


def _arrow_schema(struct: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct)


class Scratch:
    """Tables written to the shared folder while a query is built.

    A written table has no lineage, so a lost executor loses nothing.  What
    later steps don't read is dropped; what the result reads stays.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.count = spark, scratch_dir(spark, what), 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df``, read back from where it is written."""
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that :meth:`write` gave."""
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` after a write to the shared folder."""
    return Scratch(df.sparkSession, what).write(df, what)
