"""Received blocks as a stream: staged, verified, and promoted to files that are whole.

A batch is checked against the blocks that the index promises; good blocks are
staged, others are asked for again.  Files of which all blocks are staged are
promoted together, as one version of the table of contents.  Each step is
committed under the batch's number, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from ..schema import KEY
from ..sources.versions import VersionedTable

BLOCKS = "folder string, name string, i long, data binary"


def promised(records: DataFrame) -> DataFrame:
    """(folder, name, content_hash, n, i, bytes, hash): a row a block of the records' files; a file of no bytes has one block of none."""
    files = records.select(*KEY, "size", "block_size", "content_hash", "block_hashes")
    rows = files.select(*KEY, "size", "block_size", "content_hash", F.size("block_hashes").cast("long").alias("n"), F.posexplode("block_hashes").alias("i", "hash"))
    rest = F.col("size") - F.col("i") * F.col("block_size")
    return rows.select(*KEY, "content_hash", "n", F.col("i").cast("long").alias("i"), F.least(rest, F.col("block_size").cast("long")).alias("bytes"), "hash")


def verified(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Received blocks that are wanted (:func:`promised`), with ``good``: whether size and hash are as promised."""
    good = (F.octet_length("data") == F.col("bytes")) & (hashing.sha256(F.col("data")) == F.col("hash"))
    return blocks.select(*KEY, "i", "data").join(wanted, [*KEY, "i"]).withColumn("good", F.coalesce(good, F.lit(False)))


class StagedSink:
    """Takes batches of blocks; ``staged``, ``contents`` and ``again`` are versioned tables under ``path``.

    ``contents``: (folder, name, content_hash, i, data), only whole files.
    ``again``: (folder, name, i, batch) of blocks that came damaged.  A file that
    is promoted leaves the staged blocks; so these grow with what is under way.
    """

    def __init__(self, wanted: DataFrame, path: str, source: str = "blocks") -> None:
        spark = wanted.sparkSession
        self.wanted, self.source = wanted, source
        self.staged, self.contents, self.again = (VersionedTable(spark, f"{path}/{n}") for n in ("staged", "contents", "again"))

    def take(self, batch: DataFrame, number: int) -> None:
        """One batch; taking it again, wholly or from where it broke off, changes nothing."""
        mark = (self.source, number)
        checked = verified(batch, self.wanted)
        bad = checked.where("NOT good").select(*KEY, "i", F.lit(number).cast("long").alias("batch"))
        self.again.append(bad, mark)
        good = checked.where("good").select(*KEY, "content_hash", "n", "i", "data")
        # A block that comes twice is the same block; the first copy a task sees stands for all.
        self.staged.append(good.dropDuplicates([*KEY, "content_hash", "i"]), mark)
        held = self.staged.read()
        # Which files are whole is told without their data.
        there = held.select(*KEY, "content_hash", "n", "i").distinct().groupBy(*KEY, "content_hash", "n").agg(F.count("*").alias("there"))
        whole = there.where(F.col("there") == F.col("n")).select(*KEY, "content_hash")
        ready = held.join(whole, [*KEY, "content_hash"], "left_semi").select(*KEY, "content_hash", "i", "data").dropDuplicates([*KEY, "content_hash", "i"])
        before = self.contents.read()
        if before is not None:
            # Blocks of a file that is there already, sent once more.
            ready = ready.join(before.select(*KEY, "content_hash").distinct(), [*KEY, "content_hash"], "left_anti")
        self.contents.append(ready, mark)
        promoted = self.contents.read().select(*KEY, "content_hash").distinct()
        if not held.join(promoted, [*KEY, "content_hash"], "left_semi").isEmpty():
            self.staged.replace(lambda rows: rows.join(promoted, [*KEY, "content_hash"], "left_anti"), (f"{self.source}:cleared", number))

    def files(self) -> DataFrame:
        """(folder, name, content_hash, n, bytes) of the files that are whole."""
        return self.contents.read().groupBy(*KEY, "content_hash").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))

    def missing(self) -> DataFrame:
        """(folder, name, i) of the blocks that are still to come: where a transfer resumes, in any order."""
        held = self.staged.read().select(*KEY, "i").unionByName(self.contents.read().select(*KEY, "i"))
        return self.wanted.select(*KEY, "i").join(held, [*KEY, "i"], "left_anti")

    def start(self, blocks: DataFrame, checkpoint: str, once: bool = True):
        """Runs :meth:`take` on a stream of blocks."""
        writer = blocks.writeStream.foreachBatch(lambda batch, number: self.take(batch, number)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
