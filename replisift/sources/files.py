"""Files and stored state: listings, contents, and versions of an index table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INDEX, conform


def listing(spark: SparkSession, path: str, folder: str, contents: bool = False) -> DataFrame:
    """(folder, name, size, modified_s, is_dir[, content]) of all files below a path and of their directories.

    Without ``contents`` only the files' metadata are read.  Spark's reader
    leaves out files of no bytes; where these matter, supply a listing table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = F.lit(path.rstrip("/").removeprefix("file:") + "/")
    plain = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    rows = files.select(
        F.lit(folder).alias("folder"), F.element_at(F.split(plain, F.concat(F.lit(r"\Q"), root, F.lit(r"\E")), 2), -1).alias("name"),
        F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("modified_s"), F.lit(False).alias("is_dir"), *(["content"] if contents else []),
    )
    parts = F.split("name", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    dirs = rows.where(F.size(parts) > 1).select(
        "folder", F.explode(above).alias("name"), F.lit(0).cast("long").alias("size"), "modified_s", F.lit(True).alias("is_dir"),
        *([F.lit(None).cast("binary").alias("content")] if contents else []),
    )
    return rows.unionByName(dirs.groupBy("folder", "name", "size", "is_dir", *(["content"] if contents else [])).agg(F.max("modified_s").alias("modified_s")))


def save_index(index: DataFrame, path: str, version: int, short_id: str) -> None:
    """Writes a version of an index: its rows, then a manifest by which a reader knows that they are whole.

    Numbers are the caller's; writing one again isn't atomic.  Several writers, or readers meanwhile: :mod:`versions`.
    """
    target = f"{path}/v{version}"
    conform(index).write.mode("overwrite").partitionBy("folder").parquet(f"{target}/rows")
    spark = index.sparkSession
    counts = spark.read.parquet(f"{target}/rows").groupBy("folder").agg(F.count("*").alias("n"), F.max("sequence").alias("high"))
    manifest = counts.select(F.to_json(F.struct(F.lit(short_id).alias("short_id"), F.lit(2).alias("format"), "folder", "n", "high")).alias("value"))
    manifest.coalesce(1).write.mode("overwrite").text(f"{target}/manifest")


def load_index(spark: SparkSession, path: str, version: int, short_id: str) -> DataFrame | None:
    """A stored version of an index; None, which means a full rescan, if it isn't there, another device's or not whole."""
    target = f"{path}/v{version}"
    try:
        manifest = spark.read.text(f"{target}/manifest")
        rows = spark.read.schema(INDEX).parquet(f"{target}/rows")
        marks = [json.loads(r.value) for r in manifest.collect()]  # one row a folder
        found = {r.folder: r.n for r in rows.groupBy("folder").agg(F.count("*").alias("n")).collect()}
    except Exception:  # noqa: BLE001 - whatever is wrong with it, it can't be used
        return None
    whole = all(m.get("short_id") == short_id and m.get("format") == 2 and found.get(m["folder"]) == m["n"] for m in marks)
    return rows.select(*INDEX.names) if whole and len(marks) == len(found) else None


def state_name(folder: str) -> str:
    """The file name of a folder's state: the 64-bit FNV-1a hash of its id in hex."""
    h = 0xCBF29CE484222325
    for b in folder.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}.idx"
