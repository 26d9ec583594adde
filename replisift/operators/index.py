"""Changes of an index: upserts, sequences, pruning, forgetting, archives.

Plain files have no MERGE, so each operator gives the new state, to be written
as a new version of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import version
from ..schema import KEY
from .places import placed

DAY = 86400


def latest(rows: DataFrame, keys: list[str] = KEY, order: str = "sequence") -> DataFrame:
    """The last row of each key.  An aggregation, so a key with very many rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("__last")
    return rows.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in rows.columns])


def upsert(index: DataFrame, changes: DataFrame, keys: list[str] = KEY, order: str = "sequence") -> DataFrame:
    """``index`` with the changes in place of the records of their keys; of several changes of a key the last counts."""
    marked = index.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in index.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct("__new", order)).alias("__last")
    return marked.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in index.columns])


def high_water(index: DataFrame) -> DataFrame:
    """(folder, high): the highest sequence of each folder."""
    return index.groupBy("folder").agg(F.max("sequence").alias("high"))


def assign_sequence(rows: DataFrame, marks: DataFrame, order: list[Column | str], salt: int | None = None) -> DataFrame:
    """``rows`` with ``sequence`` = the folder's mark + 1, 2, ... in the given order.

    ``marks`` has (folder, high); a folder without one starts at 1.  See
    :func:`places.placed`: a folder with most of the rows isn't sorted by one
    task, and the places are fixed by one written table.  ``salt``: the number
    of ranges, by default that of the session's shuffle partitions.
    """
    keys = {f"__k{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    out = placed(rows.withColumns(keys), ["folder"], list(keys), salt).join(marks.select("folder", "high"), "folder", "left")
    return out.withColumn("sequence", F.coalesce("high", F.lit(0)) + F.col("__place")).select(*rows.columns, *([] if "sequence" in rows.columns else ["sequence"]))


def prunable(now_s: int, keep_days: int = 180) -> Column:
    """Whether a record is a tombstone older than the days that deletions are kept; never if these aren't above 0."""
    return F.col("deleted") & (F.col("modified_s") < now_s - keep_days * DAY) if keep_days > 0 else F.lit(False)


def prune(index: DataFrame, now_s: int, keep_days: int = 180) -> DataFrame:
    """``index`` without prunable tombstones; sequences stay."""
    return index.where(~prunable(now_s, keep_days))


def forget_unseen(index: DataFrame, seen: DataFrame, before: int | Column, keys: list[str] = KEY) -> DataFrame:
    """``index`` without live valid records up to sequence ``before`` that ``seen`` lacks; they leave no tombstone."""
    marks = seen.select(*keys, F.lit(True).alias("__seen")).distinct()
    gone = F.col("__seen").isNull() & ~F.col("deleted") & ~F.col("invalid") & (F.col("sequence") <= before)
    return index.join(marks, keys, "left").where(~gone).drop("__seen")


def forget(index: DataFrame, names: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``index`` without the named records."""
    return index.join(names.select(*keys).distinct(), keys, "left_anti")


def reset(index: DataFrame, folder: str) -> DataFrame:
    """``index`` without a folder."""
    return index.where(F.col("folder") != folder)


def tombstones(index: DataFrame, device: str, when_s: int | Column) -> DataFrame:
    """Records as deleted by us at a time: type and permissions stay, our counter is bumped, content is gone."""
    now = (when_s if isinstance(when_s, Column) else F.lit(when_s)).cast("long")
    return index.withColumns(
        {
            "deleted": F.lit(True), "invalid": F.lit(False), "size": F.lit(0).cast("long"), "modified_s": now, "modified_ns": F.lit(0),
            "modified_by": F.lit(device).cast("decimal(20,0)"), "version": version.bump(F.col("version"), F.lit(device), now),
            "block_size": F.lit(0), "content_hash": F.lit(None).cast("binary"), "block_hashes": F.expr("cast(array() as array<binary>)"),
        }
    )


def archive(old: DataFrame, replaced: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The archive with the last previous copy of each record that was replaced or deleted."""
    return upsert(old, replaced, keys)


def stale_temps(listing: DataFrame, now_s: int, suffix: str, days: int = 7) -> DataFrame:
    """Temporary files of a listing (those with the receiver's own suffix) that are older than some days."""
    if not suffix:
        raise ValueError("without a suffix every file would be a temporary one")
    return listing.where(F.lower("name").endswith(suffix) & (F.col("modified_s") < now_s - days * DAY))


def migrate_names(index: DataFrame, raw_col: str = "raw_name") -> DataFrame:
    """``index`` without names that aren't UTF-8, the others with the name they have on a Latin-1 disk (``disk_name``)."""
    from ..functions import paths

    return index.where(paths.utf8_valid(F.col(raw_col))).withColumn("disk_name", paths.to_local(F.col(raw_col).cast("string")))


def latest_change(changes: DataFrame, order: str = "sequence") -> DataFrame:
    """(folder, verb, name) of each folder's last valid file change.

    Added if the key has no earlier row, deleted if it is a tombstone, else
    updated.  A re-added key is updated as long as its tombstone is there.
    """
    files = changes.where((F.col("type") == 0) & ~F.col("invalid"))
    first = changes.groupBy(*KEY).agg(F.min(order).alias("__first"))
    last = files.groupBy("folder").agg(F.max_by(F.struct("name", "deleted", F.col(order).alias("at")), F.col(order)).alias("l"))
    rows = last.select("folder", "l.name", "l.deleted", "l.at").join(first, KEY)
    verb = F.when(F.col("deleted"), "deleted").when(F.col("at") == F.col("__first"), "added").otherwise("updated")
    return rows.select("folder", verb.alias("verb"), "name")
