"""What to do about each record that a peer announces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, paths, text, version
from ..schema import ADOPT, CONFLICT, DELETE, DIRECTORY, EQUAL, FETCH, FILE, IGNORE, KEY, OURS, SEND_ONLY, SEND_RECEIVE, THEIRS

RECORD = ["type", "size", "permissions", "modified_s", "modified_ns", "modified_by", "sequence", "version", "content_hash", "deleted", "invalid"]


def content_same(a: Column, b: Column) -> Column:
    """Whether two records' contents are known and equal."""
    return F.coalesce((a["size"] == b["size"]) & (a["content_hash"] == b["content_hash"]), F.lit(False))


def peer_wins(have: Column, peer: Column) -> Column:
    """Whether the peer's record wins a conflict: later time, then larger hash; a full tie keeps ours."""
    s = F.when(peer["modified_s"] != have["modified_s"], peer["modified_s"] > have["modified_s"])
    ns = F.when(peer["modified_ns"] != have["modified_ns"], peer["modified_ns"] > have["modified_ns"])
    none = F.lit(b"").cast("binary")
    content = F.coalesce(peer["content_hash"], none) > F.coalesce(have["content_hash"], none)
    return F.coalesce(s, ns, content)


def action(have: Column, peer: Column, mode: int | Column = SEND_RECEIVE) -> Column:
    """The action for a peer's record, given ours (a null struct if we have none).

    The order of the tests is the decision table's.
    """
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    missing = have.isNull()
    dead = F.coalesce(have["deleted"], F.lit(False))
    mine, theirs = version.vector(have["version"]), version.vector(peer["version"])
    both = (F.size(mine) > 0) & (F.size(theirs) > 0)
    relation = version.compare(mine, theirs)
    same = ~missing & ~dead & content_same(have, peer)
    metadata = (
        (have["modified_s"] != peer["modified_s"]) | (have["modified_ns"] != peer["modified_ns"]) | (have["permissions"] != peer["permissions"])
    )
    times = (have["modified_s"] == peer["modified_s"]) & (have["modified_ns"] == peer["modified_ns"])
    wins = peer_wins(have, peer)
    older = peer["modified_s"] < have["modified_s"]
    pick = lambda test, yes, no=IGNORE: F.when(test, yes).otherwise(no)
    live = (
        F.when(missing, FETCH)
        .when(both & (relation == THEIRS), pick(same, ADOPT, FETCH))
        .when(both & (relation == OURS), IGNORE)
        .when(both & (relation == EQUAL), pick(same & metadata, ADOPT))
        .when(both & same, pick(times | wins, ADOPT))
        .when(both & dead, FETCH)
        .when(both, pick(wins, CONFLICT))
        .when(same, IGNORE)
        .when(older, IGNORE)
        .otherwise(FETCH)
    )
    return (
        F.when(mode == SEND_ONLY, IGNORE)
        .when(peer["deleted"], F.when(missing | dead, IGNORE).when(both, pick(relation == THEIRS, DELETE)).otherwise(pick(older, IGNORE, DELETE)))
        .otherwise(live)
    )


def pair(have: DataFrame, peer: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The peer's records with ours: keys, struct ``peer`` and struct ``have``, null where we have none."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    return packed(peer, "peer").join(packed(have, "have"), keys, "left")


def classify(have: DataFrame, peer: DataFrame, mode: int = SEND_RECEIVE, keys: list[str] = KEY) -> DataFrame:
    """:func:`pair` with the column ``action``.  One equi join on the keys, all else row by row."""
    return pair(have, peer, keys).withColumn("action", action(F.col("have"), F.col("peer"), mode))


def receive_directory(have: Column, peer: Column) -> Column:
    """Whether to create a directory that a peer has live."""
    both = (F.size(version.vector(have["version"])) > 0) & (F.size(version.vector(peer["version"])) > 0)
    newer = F.when(both, version.compare(have["version"], peer["version"]) == THEIRS).otherwise(peer["modified_s"] >= have["modified_s"])
    return F.when(have.isNull(), F.lit(True)).when(~have["deleted"], F.lit(False)).otherwise(newer)


def delete_directory(have: Column, peer: Column) -> Column:
    """``DONE``, ``REFUSE`` or ``REMOVE`` for a directory that a peer deleted; concurrent changes remove it."""
    both = (F.size(version.vector(have["version"])) > 0) & (F.size(version.vector(peer["version"])) > 0)
    refuse = F.when(both, version.compare(have["version"], peer["version"]) == OURS).otherwise(peer["modified_s"] < have["modified_s"])
    return F.when(have.isNull() | have["deleted"], "DONE").when(refuse, "REFUSE").otherwise("REMOVE")


def admissible(peer: DataFrame, ignored: Column) -> DataFrame:
    """The records of a peer that are looked at: valid, safely named files or directories, not ignored; an ignored file's deletion is."""
    own = F.col("type").isin(FILE, DIRECTORY)
    skipped = ignored & ((F.col("type") == DIRECTORY) | ~F.col("deleted"))
    return peer.where(~F.col("invalid") & paths.name_safe(F.col("name")) & own & ~skipped)


def unstorable(classified: DataFrame) -> DataFrame:
    """Fetches whose blocks can't be kept, as invalid records at the peer's version (struct ``record``)."""
    wanted = F.col("action").isin(FETCH, CONFLICT) & ~hashing.storable(F.col("peer.block_size"), F.col("peer.block_hashes"))
    record = F.col("peer").withField("invalid", F.lit(True)).withField("deleted", F.lit(False)).withField("block_hashes", F.expr("cast(array() as array<binary>)"))
    return classified.where(wanted).withColumn("record", record)


def adopted(classified: DataFrame) -> DataFrame:
    """Our records that take over the peer's version and metadata, the content untouched (struct ``record``); sequences come later."""
    record = F.col("have")
    for c in ("version", "modified_s", "modified_ns", "modified_by", "permissions"):
        record = record.withField(c, F.col(f"peer.{c}"))
    return classified.where(F.col("action") == ADOPT).withColumn("record", record)


def preserved(classified: DataFrame, device: str, now_s: int, tag: str, cap: int = 256) -> DataFrame:
    """Conflict losers under a name of their own, with our counter bumped (``name`` and struct ``record``).

    The long name is tried first, then the compact one; a record that fits neither isn't preserved.
    """
    name, now = F.col("name"), F.lit(now_s).cast("long")
    new = F.coalesce(text.conflict_name(name, now, F.lit(tag), cap=cap), text.conflict_name(name, now, F.lit(tag), True, cap))
    record = (
        F.col("have")
        .withField("version", version.bump(F.col("have.version"), F.lit(device), version.stamp(now, F.col("have.modified_s"))))
        .withField("modified_by", F.lit(device).cast("decimal(20,0)"))
    )
    return classified.where(F.col("action") == CONFLICT).withColumn("record", record).withColumn("name", new).where("name IS NOT NULL")


def contested(classified: DataFrame) -> DataFrame:
    """Records that the peer deleted and we keep."""
    return classified.where(F.col("peer.deleted") & (F.col("action") == IGNORE) & F.col("have").isNotNull() & ~F.coalesce(F.col("have.deleted"), F.lit(True)))


def retime_split(index: DataFrame, device: str) -> DataFrame:
    """``index`` with ``foreign``: whether a device other than ours has a counter in the version."""
    return index.withColumn("foreign", F.exists(F.map_keys(version.vector(F.col("version"))), lambda k: k != device))


