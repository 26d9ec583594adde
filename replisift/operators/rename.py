"""Renames and copies: contents that are here under another name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FILE, KEY
from .budgets import fitting_wants
from .places import placed

CONTENT = ["size", "content_hash"]


def local_sources(wants: DataFrame, index: DataFrame) -> DataFrame:
    """For each wanted (folder, name, size, content_hash) the first live file of that content under another name.

    First by sequence, then name.  Candidates are reduced to two a content
    before the join, which suffices as only one can have the wanted name.
    """
    files = index.where((F.col("type") == FILE) & ~F.col("deleted") & ~F.col("invalid") & F.col("content_hash").isNotNull())
    one = F.struct("sequence", F.col("name").alias("source"))
    best = files.groupBy("folder", *CONTENT).agg(F.min(one).alias("a"))
    rest = files.join(best, ["folder", *CONTENT]).where(one > F.col("a")).groupBy("folder", *CONTENT).agg(F.min(one).alias("b"))
    found = wants.join(best, ["folder", *CONTENT]).join(rest, ["folder", *CONTENT], "left")
    source = F.when(F.col("a.source") != F.col("name"), F.col("a.source")).otherwise(F.col("b.source"))
    return found.select(*KEY, source.alias("source")).where("source IS NOT NULL")


def held_deletes(deletes: DataFrame, wants: DataFrame) -> DataFrame:
    """Deletions whose content is still wanted, so that it can be copied first."""
    return deletes.join(wants.select(*CONTENT).distinct(), CONTENT, "left_semi")


def applied_deletes(deletes: DataFrame, wants: DataFrame) -> DataFrame:
    """Deletions whose content nobody wants; contents that aren't known are in nobody's way."""
    return deletes.join(wants.select(*CONTENT).distinct(), CONTENT, "left_anti")


def already_have(wants: DataFrame, index: DataFrame) -> DataFrame:
    """Wants that are there already, by name, size and content."""
    return wants.join(index.where(~F.col("deleted")).select(*KEY, *CONTENT), [*KEY, *CONTENT], "left_semi")


def still_wanted(wants: DataFrame, index: DataFrame) -> DataFrame:
    """Wants that aren't there yet."""
    return wants.join(index.where(~F.col("deleted")).select(*KEY, *CONTENT), [*KEY, *CONTENT], "left_anti")


def delete_order(deletes: DataFrame) -> DataFrame:
    """Deletions with the key to apply them by: files first, then directories, the deepest first (``is_dir``, ``depth``)."""
    from ..functions import paths

    return deletes.select("*", (F.col("type") != FILE).cast("int").alias("is_dir"), paths.depth(F.col("name")).alias("depth"))


def want_queue(wants: DataFrame, most: int | None = None, most_blocks: int | None = None, tries: int = 3) -> DataFrame:
    """Wants in the order they are served, last pushed first, with ``stalled`` after some tries.

    The limits keep, by session, the first pushed that fit: at most ``most``, of
    at most ``most_blocks`` blocks in total.  A want that doesn't fit is refused
    and takes nothing, so smaller ones after it may fit.  Whether one fits
    depends on all before it: see :func:`budgets.fitting_wants`, by which a
    session with most of the wants isn't one task.
    """
    rows = wants.withColumn("stalled", F.col("attempts") >= tries)
    if most_blocks is not None:
        pushed = wants.where(F.col("n_blocks").isNotNull())
        rows = rows.join(fitting_wants(pushed, ["session"], ["push_no"], "n_blocks", most_blocks, most), ["session", "push_no"], "left_semi")
    elif most is not None:
        rows = placed(rows, ["session"], ["push_no"]).where(F.col("__place") <= most).drop("__place")
    return rows.orderBy(F.col("push_no").desc())


def claims(wants: DataFrame) -> DataFrame:
    """One fetcher a file: (folder, name, session) of the first that asked."""
    return wants.groupBy(*KEY).agg(F.min_by("session", "push_no").alias("session"))
