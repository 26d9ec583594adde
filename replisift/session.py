"""A session with the settings that the engine's semantics need."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where they share the driver's file system."""
    env = spark.sparkContext.environment
    if REPO_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, env.get("PYTHONPATH", "")) if x)


def session(app: str = "replisift", **conf: str) -> SparkSession:
    """A session in UTC, with adaptive execution; existing settings of a cluster win where they are given in ``conf``."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN_FOLDERS: set[str] = set()


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder for a written table, in the folder that the cluster shares.

    ``spark.checkpoint.dir`` names that folder.  Only where it is unset and all
    of Spark is one process, as in tests, a folder under /tmp is used; on a
    cluster an unset folder is an error, as executors share no local disk.

    An application's tables stand in one folder of its own, which is deleted when
    the driver's Python ends, as no result can be read from them any more.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master})")
        base = "file:///tmp/checkpoints"
    own = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        _delete_at_end(spark, own)
    return f"{own}/{what}-{uuid.uuid4().hex}"


def _delete_at_end(spark: SparkSession, folder: str) -> None:
    # The Java side outlives the session; taken now, as a stopped session gives nothing any more.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark._jsc.hadoopConfiguration()

    def delete() -> None:
        with contextlib.suppress(Exception):  # the Java side may have ended first
            path.getFileSystem(conf).delete(path, True)

    atexit.register(delete)


def materialized(df: DataFrame, what: str) -> DataFrame:
    """``df``, written once to the shared folder and read back: a fixed result, whatever is lost or evaluated again."""
    path = scratch_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
