"""Places of rows in an order, without a task that sorts all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialized


def placed(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None, as_col: str = "__place") -> DataFrame:
    """``rows`` with ``as_col``: 1, 2, ... in the order within each ``by``.

    Rows are dealt by ranges of (by, order), sorted within a range and numbered
    by partition and place, once, in one written table: the ranges' bounds are
    sampled, so evaluating them twice could deal rows differently.  A row's place
    is its number less what came before its ``by``, which the sizes of the (by,
    range) pieces tell; these are few (ranges plus groups).  Ties get places in
    any order.  Null keys form a group.  No row: no row.
    """
    columns = rows.columns
    keys = [*by, *order]
    ranged = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    numbered = ranged.sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    fixed = materialized(numbered, "places").withColumn("__part", F.shiftright("__at", 33))
    fixed = fixed.withColumn("__by", F.struct(*by) if by else F.struct(F.lit(0)))
    # A piece's rows stand together: its first number and its size place them all.
    pieces = fixed.groupBy(F.col("__by").alias("__b"), F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select("__b", "__p", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    out = fixed.join(shifts, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__part") == F.col("__p")))
    return out.select(*columns, (F.col("__at") + F.col("__shift") + 1).alias(as_col))
