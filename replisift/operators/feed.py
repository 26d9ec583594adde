"""Change feeds: what each peer is told, by sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import version
from ..schema import FILE, RECEIVE_ONLY
from .places import placed

BATCH = 256
#: Cursors that are broadcast at most, and tasks for a folder's records beyond that.
FEW, SALT = 100_000, 64


def announceable(device: str, mode: int | Column) -> Column:
    """Whether a record is told: not if a mirror changed it itself, nor a live valid file whose blocks aren't known."""
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    own = (mode == RECEIVE_ONLY) & version.has(F.col("version"), F.lit(device))
    bare = (F.col("type") == FILE) & ~F.col("deleted") & ~F.col("invalid") & (F.coalesce(F.size("block_hashes"), F.lit(0)) <= 0)
    return ~own & ~bare


def since(index: DataFrame, cursors: DataFrame) -> DataFrame:
    """Each peer's news: (peer, is_full, record columns) of sequences above its cursor, up to the snapshot.

    ``cursors`` has (peer, folder, cursor, snapshot); a cursor of 0 starts with a
    full index.  Up to ``FEW`` cursors, which are counted, are sent to all tasks.
    More are joined by folder, a folder's records dealt to ``SALT`` tasks.
    """
    fresh = (F.col("sequence") > F.col("cursor")) & (F.col("sequence") <= F.col("snapshot"))
    if cursors.limit(FEW + 1).count() <= FEW:
        rows = index.join(F.broadcast(cursors), "folder")
    else:
        dealt = index.withColumn("__salt", F.pmod(F.xxhash64("name"), F.lit(SALT)).cast("int"))
        rows = dealt.join(cursors.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["folder", "__salt"])
    return rows.where(fresh).select("peer", (F.col("cursor") == 0).alias("is_full"), *index.columns)


def next_cursor(cursors: DataFrame, pruned: DataFrame) -> DataFrame:
    """Cursors after a pass: the snapshot, unless the folder (in ``pruned``) lost tombstones meanwhile."""
    marks = pruned.select("folder", F.lit(True).alias("__pruned")).distinct()
    keep = F.coalesce(F.col("__pruned"), F.lit(False))
    return cursors.join(marks, "folder", "left").withColumn("cursor", F.when(keep, F.col("cursor")).otherwise(F.col("snapshot"))).drop("__pruned")


def eligible(folders: DataFrame) -> DataFrame:
    """Folders that may be shared: not removed, and scanned once or with records."""
    return folders.where(~F.col("removed") & (F.col("scanned") | (F.col("n_records") > 0)))


def shared(folders: DataFrame, theirs: DataFrame) -> DataFrame:
    """Eligible folders that the peer has too."""
    return eligible(folders).join(theirs.select("folder").distinct(), "folder", "left_semi")


def reset_cursors(cursors: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """Cursors with those of newly shared folders at 0; both sets have (peer, folder, gen), and a new generation counts as new."""
    fresh = now.join(before, ["peer", "folder", "gen"], "left_anti").select("peer", "folder", F.lit(True).alias("__new"))
    return cursors.join(fresh, ["peer", "folder"], "left").withColumn("cursor", F.when(F.col("__new"), F.lit(0).cast("long")).otherwise(F.col("cursor"))).drop("__new")


def batches(rows: DataFrame, by: list[str], order: list[str], size: int = BATCH, parts: int | None = None) -> DataFrame:
    """``rows`` with ``batch``: their place in the order, by ``size``, from 0 within each ``by``.

    Placed by ranges (:func:`places.placed`), so no task sorts all rows of one
    ``by``, and every batch but a ``by``'s last has ``size`` rows.
    """
    return placed(rows, by, order, parts).withColumn("batch", F.floor((F.col("__place") - 1) / size)).drop("__place")


def index_coming(devices: Column, own: Column) -> Column:
    """Whether a peer will send an index, from its list of (id, max_sequence): not if its own entry says 0; yes without one."""
    mine = F.filter(devices, lambda d: d["id"] == own)
    return (F.size(mine) == 0) | F.exists(mine, lambda d: d["max_sequence"] > 0)
