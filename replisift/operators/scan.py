"""A scan: a listing of a folder against its stored index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text, version
from ..schema import DIRECTORY, FILE, KEY
from .index import tombstones

DEEPEST = 12
FILE_MODE, DIRECTORY_MODE = 0o644, 0o755


def walkable(name: Column, is_dir: Column, temp_suffix: str, deepest: int = DEEPEST, longest: int = 255) -> Column:
    """Whether a walk emits a path: no rule file, temporary file or top-level archive on the way, not too deep or long.

    ``temp_suffix`` is the suffix that the receiver gives its staged files; one that users' files may have would hide those.
    """
    if not temp_suffix:
        raise ValueError("without a suffix every file would be a temporary one")
    parts = F.split(name, "/")
    low = F.lower(name)
    own = F.exists(F.transform(parts, lambda p: F.lower(p)), lambda p: (p == ".stignore") | p.endswith(temp_suffix))
    return ~own & (F.split(low, "/")[0] != ".stversions") & (F.size(parts) - 1 <= deepest) & (F.octet_length(name) <= longest)


def walk(listing: DataFrame, ignored: Column, temp_suffix: str, deepest: int = DEEPEST) -> DataFrame:
    """The entries of a listing (folder, name, size, modified_s, is_dir) that a walk reaches; directories have size 0.

    ``ignored`` is a predicate of ``name``; rules about folders hold for what is below them.
    """
    kept = listing.where(walkable(F.col("name"), F.col("is_dir"), temp_suffix, deepest) & ~ignored)
    return kept.withColumn("size", F.when(F.col("is_dir"), F.lit(0).cast("long")).otherwise(F.col("size")))


def changed(entry: Column, record: Column, tz_east_s: int | Column = 0) -> Column:
    """Whether a listed file must be hashed again.

    No record, a tombstone, an invalid record, another size or time (a time
    before a disk's epoch counts as that epoch), or no stored blocks.
    """
    tz = F.lit(tz_east_s).cast("long") if not isinstance(tz_east_s, Column) else tz_east_s
    time = (entry["modified_s"] != record["modified_s"]) & (entry["modified_s"] != text.disk_time(record["modified_s"], tz))
    gone = record["deleted"] | record["invalid"]
    empty = F.coalesce(F.size(record["block_hashes"]), F.lit(0)) <= 0
    return record.isNull() | gone | (entry["size"] != record["size"]) | time | empty


def diff(listing: DataFrame, index: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Keys, struct ``entry``, struct ``record`` and ``change``: the full outer join of a listing and an index.

    ``new``, ``changed``, ``same``, ``missing`` (a live valid record that isn't
    listed) or ``kept`` (a tombstone or invalid record that isn't listed).
    Contents aren't touched: hash only what is new or changed, after this.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    both = packed(listing, "entry").join(packed(index, "record"), keys, "full_outer")
    entry, record = F.col("entry"), F.col("record")
    directory = F.when(record.isNull() | record["deleted"], F.when(record.isNull(), "new").otherwise("changed")).otherwise("same")
    file = F.when(record.isNull(), "new").when(changed(entry, record), "changed").otherwise("same")
    listed = F.when(entry["is_dir"], directory).otherwise(file)
    unlisted = F.when(record["deleted"] | record["invalid"], "kept").otherwise("missing")
    return both.withColumn("change", F.when(entry.isNull(), unlisted).otherwise(listed))


def receive_only(diffed: DataFrame) -> DataFrame:
    """:func:`diff` with ``verdict`` for a mirror: ``untracked``, ``forget`` (and fetch again), ``seen``, ``unseen`` or ``kept``."""
    verdict = (
        F.when(F.col("change") == "new", F.when(F.col("entry.is_dir"), "commit").otherwise("untracked"))
        .when(F.col("change") == "changed", F.when(F.col("entry.is_dir"), "commit").otherwise("forget"))
        .when(F.col("change") == "same", "seen")
        .when(F.col("change") == "missing", "unseen")
        .otherwise("kept")
    )
    return diffed.withColumn("verdict", verdict)


def hash_outcome(status: Column, listed_size: Column, hashed_size: Column) -> Column:
    """What becomes of a file that was to be hashed: ``swept`` if it vanished, ``seen`` if it couldn't be read or is too big, ``deferred`` if it changed meanwhile, else ``commit``."""
    return (
        F.when(status == "vanished", "swept")
        .when(status.isin("unreadable", "too_big"), "seen")
        .when(hashed_size != listed_size, "deferred")
        .otherwise("commit")
    )


def commit_files(files: DataFrame, device: str, now_s: int) -> DataFrame:
    """Records of hashed files (keys, size, modified_s, content, old ``version``); sequences come later."""
    bs = hashing.block_size(F.col("size"))
    blocks = hashing.block_hashes(F.col("content"), F.col("block_size"))
    return (
        files.withColumn("block_size", bs)
        .withColumn("block_hashes", blocks)
        .select(
            *KEY, F.lit(FILE).alias("type"), "size", F.lit(FILE_MODE).cast("long").alias("permissions"), "modified_s", F.lit(0).alias("modified_ns"),
            F.lit(device).cast("decimal(20,0)").alias("modified_by"), "block_size",
            version.bump(F.col("version"), F.lit(device), version.stamp(F.lit(now_s).cast("long"), F.col("modified_s"))).alias("version"),
            hashing.content_hash(F.col("block_hashes")).alias("content_hash"), F.lit(False).alias("deleted"), F.lit(False).alias("invalid"), "block_hashes",
        )
    )


def commit_directories(diffed: DataFrame, device: str, now_s: int) -> DataFrame:
    """Records of listed directories that have no live one."""
    need = F.col("entry.is_dir") & (F.col("record").isNull() | F.col("record.deleted"))
    return diffed.where(need).select(
        *KEY, F.lit(DIRECTORY).alias("type"), F.lit(0).cast("long").alias("size"), F.lit(DIRECTORY_MODE).cast("long").alias("permissions"),
        F.col("entry.modified_s").alias("modified_s"), F.lit(0).alias("modified_ns"), F.lit(device).cast("decimal(20,0)").alias("modified_by"),
        version.bump(F.col("record.version"), F.lit(device), version.stamp(F.lit(now_s).cast("long"), F.col("entry.modified_s"))).alias("version"),
        F.lit(False).alias("deleted"), F.lit(False).alias("invalid"),
    )


def sweep(index: DataFrame, seen: DataFrame, ignored: Column, before: int | Column, complete: bool = True, keys: list[str] = KEY) -> DataFrame:
    """Live valid records that a walk didn't see, with ``verdict``.

    An ignored file becomes ``invalid``, an ignored directory is ``spared``, and
    so is a record newer than the walk's start (sequence above ``before``); all
    others become a ``tombstone``.  The ignore rules come before the sequence.
    An incomplete walk concludes nothing.
    """
    unseen = index.where(~F.col("deleted") & ~F.col("invalid")).join(seen.select(*keys).distinct(), keys, "left_anti")
    out = judged_unseen(unseen, ignored, before)
    return out if complete else out.where(F.lit(False))


def judged_unseen(unseen: DataFrame, ignored: Column, before: int | Column) -> DataFrame:
    """Live valid records that a walk didn't see with the ``verdict`` of :func:`sweep`."""
    hidden = F.when(F.col("type") == FILE, "invalid").otherwise("spared")
    return unseen.withColumn("verdict", F.when(ignored, hidden).when(F.col("sequence") > before, "spared").otherwise("tombstone"))


def swept_records(swept: DataFrame, device: str, now_s: int) -> DataFrame:
    """The new records of a sweep: tombstones, and invalid records without their blocks; sequences come later."""
    dead = tombstones(swept.where("verdict = 'tombstone'").drop("verdict"), device, now_s)
    hidden = swept.where("verdict = 'invalid'").drop("verdict").withColumns({"invalid": F.lit(True), "block_hashes": F.expr("cast(array() as array<binary>)")})
    return dead.unionByName(hidden)
