"""Records that travel over several replicas: each takes in its neighbours' news under sequences of its own, so the next one hears of them.

A hop is a cursor into the sender's sequences, the news above it, the decision
table, and a commit at the receiver.  Hops are repeated until none has news.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import version
from ..schema import COUNTER, FILE, KEY, SEND_RECEIVE, VERSION, conform
from ..session import materialized
from . import classify, feed
from .index import archive, high_water, tombstones
from .lifecycle import commit, finished, peer_tombstones

Link = tuple[str, str]


def received(have: DataFrame, news: DataFrame, device: str, now_s: int, tag: str, mode: int = SEND_RECEIVE, archived: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(our records after a peer's news, our archive): everything that is fetched arrives whole.

    Conflict losers stay under names of their own.  With ``archived`` what a
    peer's deletion or copy replaces goes to the archive before that is applied.
    """
    judged = materialized(classify.classify(have, news, mode), "judged")
    new = conform(peer_tombstones(judged)).unionByName(conform(finished(judged, news.select(*KEY, F.lit("ok").alias("status")))))
    new = new.unionByName(conform(classify.adopted(judged).select(*KEY, "record.*")))
    losers = conform(classify.preserved(judged, device, now_s, tag).select(*KEY, "record.*"))
    if archived is not None:
        replaced = have.where(~F.col("deleted") & (F.col("type") == FILE)).join(judged.where(F.col("action").isin("DELETE", "FETCH")).select(*KEY), KEY, "left_semi")
        archived = materialized(archive(archived, replaced), "archive")
    return materialized(commit(have, new.unionByName(losers)), "replica"), archived


def local_changes(have: DataFrame, edits: DataFrame, device: str) -> DataFrame:
    """Our records after edits of our own (folder, name, size, modified_s, content_hash; null content: deleted); edits of a key are one row.

    A deletion of what isn't there changes nothing.
    """
    now = edits.join(have.select(*KEY, F.col("version").alias("__old"), (~F.col("deleted")).alias("__live"), F.lit(True).alias("__known")), KEY, "left")
    written = now.where("content_hash IS NOT NULL")
    stamp = version.stamp(F.col("modified_s"), F.col("modified_s"))
    files = conform(
        written.select(
            *KEY, "size", F.lit(0o644).cast("long").alias("permissions"), "modified_s", F.lit(device).cast(COUNTER).alias("modified_by"),
            version.bump(F.coalesce("__old", F.expr(f"cast(map() as {VERSION})")), F.lit(device), stamp).alias("version"),
            "content_hash", F.array("content_hash").alias("block_hashes"), F.lit(131072).alias("block_size"),
        )
    )
    gone = now.where("content_hash IS NULL AND __live").select(*KEY, F.col("modified_s").alias("__when"))
    dead = tombstones(have.join(gone, KEY), device, F.col("__when")).drop("__when")
    return materialized(commit(have, files.unionByName(conform(dead))), "replica")


def news(state: DataFrame, cursors: DataFrame) -> DataFrame:
    """A replica's records above a peer's cursors (folder, cursor); folders without one are told whole."""
    now = high_water(state).join(cursors, "folder", "left").select(F.lit("").alias("peer"), "folder", F.coalesce("cursor", F.lit(0).cast("long")).alias("cursor"), F.col("high").alias("snapshot"))
    return feed.since(state, now).drop("peer", "is_full")


def relay(states: dict[str, DataFrame], links: Iterable[Link], devices: dict[str, str], now_s: int, cursors: dict[Link, DataFrame] | None = None, most_rounds: int = 50) -> tuple[dict[str, DataFrame], dict[Link, DataFrame]]:
    """(states, cursors) after news has gone along the links, again and again, until no link has any.

    ``links``: (sender, receiver).  ``cursors``: (folder, cursor) a link, from an
    earlier call; each is read up to the sender's highest sequences and then kept
    there, so a record goes over a link once for each of its versions.  Replicas
    and news are written once, as every step of a hop reads them again.
    """
    states, cursors, links = {k: materialized(v, "replica") for k, v in states.items()}, dict(cursors or {}), list(links)
    for _ in range(most_rounds):
        quiet = True
        for link in links:
            sender, receiver = link
            state = states[sender]
            told = cursors.get(link)
            fresh = materialized(news(state, told if told is not None else state.sparkSession.createDataFrame([], "folder string, cursor long")), "news")
            if not fresh.isEmpty():
                quiet = False
                states[receiver], _ = received(states[receiver], fresh, devices[receiver], now_s, f"D{devices[receiver]}")
            cursors[link] = materialized(high_water(state).select("folder", F.col("high").alias("cursor")), "cursor")
        if quiet:
            return states, cursors
    raise RuntimeError(f"there is still news after {most_rounds} rounds")
