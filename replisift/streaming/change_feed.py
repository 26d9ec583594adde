"""Structured Streaming forms: the change feed of each peer, and bursts of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.feed import FEW, SALT


def read_changes(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 64) -> DataFrame:
    """A stream of appended change rows."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fan_out(changes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each change once for every peer of its folder whose cursor is below its sequence: a join of the stream with a static table.

    Up to ``FEW`` subscriptions, which are counted, are sent to all tasks, so a
    folder's changes stay where they were read.  More are joined by folder, a
    folder's changes dealt to ``SALT`` tasks.
    """
    if subscriptions.limit(FEW + 1).count() <= FEW:
        rows = changes.join(F.broadcast(subscriptions), "folder")
    else:
        dealt = changes.withColumn("__salt", F.pmod(F.xxhash64("sequence"), F.lit(SALT)).cast("int"))
        rows = dealt.join(subscriptions.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["folder", "__salt"]).drop("__salt")
    return rows.where(F.col("sequence") > F.col("cursor"))


def start_feed(changes: DataFrame, subscriptions: DataFrame, out_path: str, checkpoint: str, once: bool = True):
    """Writes the feed; the checkpoint keeps each source's place, so a restart repeats nothing that was committed.

    A change is written with the batch that carried it; a peer applies changes
    by sequence, so a repeated one is harmless.
    """
    query = fan_out(changes, subscriptions).writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (query.trigger(availableNow=True) if once else query.trigger(processingTime="60 seconds")).start()


def cursors(feed: DataFrame) -> DataFrame:
    """(peer, folder, cursor): how far each peer has been told."""
    return feed.groupBy("peer", "folder").agg(F.max("sequence").alias("cursor"))


def bursts(changes: DataFrame, time_col: str = "ts", quiet: str = "2 seconds", late: str | None = None) -> DataFrame:
    """(folder, started, ended, n): runs of changes without a quiet gap, after which a scan is due.

    A gap of exactly ``quiet`` ends a run.  A session window goes on where a change
    meets its end, so it is a microsecond shorter, which is added again.  Changes
    without a time are in no run.  Works on a table and, with a watermark ``late``,
    on a stream.
    """
    rows = changes.withWatermark(time_col, late) if late else changes
    window = F.session_window(time_col, f"{quiet} -1 microseconds")
    ended = F.col("session_window.end") + F.expr("INTERVAL '0.000001' SECOND")
    return rows.groupBy("folder", window).agg(F.count("*").alias("n")).select("folder", F.col("session_window.start").alias("started"), ended.alias("ended"), "n")


def want_states(wants: DataFrame, tries: int = 3) -> DataFrame:
    """(folder, name, attempts, state) from a stream or table of events (folder, name, event).

    ``pushed``, ``failed`` and ``done`` events; a want that failed ``tries``
    times is stalled.  State is one small row a key.
    """
    counted = wants.groupBy("folder", "name").agg(F.count_if(F.col("event") == "failed").alias("attempts"), F.max((F.col("event") == "done").cast("int")).alias("done"))
    state = F.when(F.col("done") == 1, "done").when(F.col("attempts") >= tries, "stalled").otherwise("waiting")
    return counted.select("folder", "name", "attempts", state.alias("state"))
