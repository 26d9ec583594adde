"""Registries: offered folders, discovered devices, configured folders and their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

#: Tasks that share the folders below a path, and lists that hold its own.
SALT, CHUNKS = 32, 64


def offered_refresh(old: DataFrame, device_col: str, heard: DataFrame, current: DataFrame) -> DataFrame:
    """The registry after some devices spoke: all they offered before goes, what they offer now comes.

    ``heard`` names the devices that spoke, also those that offer nothing.
    """
    return old.join(heard.select(device_col).distinct(), device_col, "left_anti").unionByName(current)


def offered(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Folders that a peer offers and we haven't configured."""
    return theirs.join(ours.select("folder").distinct(), "folder", "left_anti")


def matched(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """A peer's folders with ``shared``: whether we have configured them."""
    marks = ours.select("folder", F.lit(True).alias("shared")).distinct()
    return theirs.join(marks, "folder", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key; an aggregation, so a key with very many rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("__first")
    return rows.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in rows.columns])


def recent_sightings(sightings: DataFrame, most: int = 16) -> DataFrame:
    """The ``most`` devices seen first most lately, each with its latest address; seeing one again doesn't renew its place."""
    one = sightings.groupBy("device").agg(F.min("at").alias("first_at"), F.max_by(F.struct("host", "port"), "at").alias("l"))
    return one.select("device", "first_at", "l.host", "l.port").orderBy(F.col("first_at").desc(), "device").limit(most)


def overlapping(folders: DataFrame) -> DataFrame:
    """(inner, outer): folders of which one's path lies in the other's, or equals it; a row of ``folders`` is a folder.

    Not a comparison of all pairs: a path is joined by equality to each of its
    own ancestors, of which it has no more than it has components.  A path's own
    folders are gathered in ``CHUNKS`` lists and meet those below it in ``SALT``
    tasks, so a path of very many folders isn't one task's.  The pairs, which can
    be far more than the folders, are made last, and neither shuffled nor sorted:
    a folder has one path, and names each ancestor once, so no pair comes twice.
    """
    low = folders.select("folder", paths.ascii_lower(F.regexp_replace("path", "/+$", "")).alias("p"))
    parts = F.split("p", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    volume = F.when(F.col("p").contains(":"), F.array(F.concat(F.substring_index("p", ":", 1), F.lit(":")))).otherwise(F.expr("cast(array() as array<string>)"))
    dealt = lambda n: F.pmod(F.xxhash64("folder"), F.lit(n)).cast("int")
    inner = low.select(F.col("folder").alias("inner"), dealt(SALT).alias("__salt"), F.explode(F.array_distinct(F.concat(above, volume))).alias("p"))
    outer = low.where("p IS NOT NULL").groupBy("p", dealt(CHUNKS).alias("__chunk")).agg(F.collect_list("folder").alias("__outers"))
    outer = outer.select("p", "__outers", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    tasks = int(folders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = inner.repartition(tasks, "p", "__salt").join(outer.repartition(tasks, "p", "__salt"), ["p", "__salt"])
    return met.select("inner", F.explode("__outers").alias("outer")).where("inner != outer")
