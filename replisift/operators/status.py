"""Status: totals, backlogs, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DIRECTORY

BACKLOG = ("queued", "active", "stalled", "parked")


def folder_totals(index: DataFrame) -> DataFrame:
    """(folder, files, dirs, bytes) of what isn't deleted; invalid records count, negative sizes don't."""
    live, is_dir = ~F.col("deleted"), F.col("type") == DIRECTORY
    size = F.when(live & ~is_dir & (F.col("size") > 0), F.col("size")).otherwise(F.lit(0).cast("long"))
    return index.groupBy("folder").agg(F.count_if(live & ~is_dir).alias("files"), F.count_if(live & is_dir).alias("dirs"), F.sum(size).alias("bytes"))


def transfer_totals(peers: DataFrame) -> DataFrame:
    """(bytes_in, bytes_out) over peers, each with folded, live and inbound counters."""
    total = lambda way: F.coalesce(F.sum(sum((F.coalesce(F.col(f"{k}_{way}"), F.lit(0)) for k in ("live", "inbound")), F.coalesce(F.col(f"folded_{way}"), F.lit(0)))), F.lit(0))
    return peers.agg(total("in").alias("bytes_in"), total("out").alias("bytes_out"))


def gathered(**lists: DataFrame) -> DataFrame:
    """Items (peer, folder, kind) of the lists that sessions keep (``queued``, ``active``, ``stalled``, ``parked``, ``kept``, ``reverted``), each with a peer and a folder a row.

    A union without a shuffle; lists may have other columns of any kind.
    """
    unknown = set(lists) - {*BACKLOG, "kept", "reverted"}
    if not lists or unknown:
        raise ValueError(f"no such lists: {sorted(unknown)}" if unknown else "a list at least")
    out = None
    for kind, rows in lists.items():
        one = rows.select("peer", "folder", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


def session_backlog(items: DataFrame) -> DataFrame:
    """(peer, folder, pending): the items of all kinds of backlog of a session."""
    return items.where(F.col("kind").isin(*BACKLOG)).groupBy("peer", "folder").agg(F.count("*").alias("pending"))


def backlog(items: DataFrame) -> DataFrame:
    """(folder, pending, kept, reverted) over peers.

    Peers want the same files, so the largest backlog and the largest number
    kept count; overwritten edits are each peer's own and are summed.
    """
    of = lambda kinds: F.count_if(F.col("kind").isin(*kinds))
    one = items.groupBy("peer", "folder").agg(of(BACKLOG).alias("pending"), of(["kept"]).alias("kept"), of(["reverted"]).alias("reverted"))
    return one.groupBy("folder").agg(F.max("pending").alias("pending"), F.max("kept").alias("kept"), F.sum("reverted").alias("reverted"))


def _counted(text: str, n: Column, unit: str) -> Column:
    return F.concat(F.lit(text), n.cast("string"), F.lit(unit), F.when(n == 1, "").otherwise("s"))


def folder_label(pending: Column, scanned: Column, reverted: Column, kept: Column) -> Column:
    """A folder's state, the most pressing first."""
    return (
        F.when(pending > 0, F.concat(_counted("Syncing (", pending, " file"), F.lit(")")))
        .when(~scanned, "Scanning")
        .when(reverted > 0, F.concat(F.lit("Replaced ("), reverted.cast("string"), F.lit(")")))
        .when(kept > 0, F.concat(F.lit("Kept ("), kept.cast("string"), F.lit(")")))
        .otherwise("Up to Date")
    )


def global_label(peers: Column, connected: Column, pending: Column, resyncing: Column, reverted: Column, kept: Column) -> Column:
    """The overall state, the most pressing first."""
    return (
        F.when(peers == 0, "No peers configured")
        .when(connected == 0, "Offline")
        .when(pending > 0, F.concat(_counted("Syncing (", pending, " file"), F.lit(")")))
        .when(resyncing > 0, "Syncing")
        .when(reverted > 0, F.concat(_counted("Up to Date (", reverted, " local edit"), F.lit(" replaced)")))
        .when(kept > 0, F.concat(F.lit("Up to Date ("), kept.cast("string"), F.lit(" kept)")))
        .otherwise("Up to Date")
    )


def status_list(configured: DataFrame, offered: DataFrame) -> DataFrame:
    """Folders with ``grp`` and ``label``, to be listed by group (configured first) and label without regard to case."""
    from ..functions.text import display_label

    one = lambda df, g: df.select(F.lit(g).alias("grp"), "folder", display_label(F.col("label"), F.col("folder")).alias("label"))
    return one(configured, 0).unionByName(one(offered, 1)).orderBy("grp", F.lower("label"), "folder")


def found_peers(seen: DataFrame, peers: DataFrame, configured: bool) -> DataFrame:
    """Discovered devices that are configured, or those that aren't; ids are compared in normal form, what is no id as it stands."""
    from ..sources.device_id import normalized

    keyed = lambda df: df.withColumn("__id", F.coalesce(normalized(F.col("device")), F.col("device")))
    known = keyed(peers.select("device")).select("__id").distinct()
    return keyed(seen).join(known, "__id", "left_semi" if configured else "left_anti").drop("__id")
