"""Places, sequences and batches over several files, with more rows than a range sampler looks at."""

import pytest
from pyspark.sql import functions as F

from replisift.operators import feed, index
from replisift.operators.places import placed

N = 2_000_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Two folders of a million rows each, in 16 files, in no order, with columns that nothing needs."""
    where = f"file://{tmp_path_factory.mktemp('places')}/rows"
    rows = spark.range(0, N, 1, 16).select(
        F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("folder"), F.sha1(F.col("id").cast("string")).alias("name"),
        F.xxhash64("id").alias("old"), (F.col("id") * 3).alias("other"), F.lit("x").alias("extra"),
    )
    rows.write.parquet(where)
    return spark.read.parquet(where)


def test_sequences_are_consecutive(spark, many, tmp_path):
    marks = spark.createDataFrame([("f0", 100)], "folder string, high long")
    index.assign_sequence(many, marks, ["old"]).write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.columns == [*many.columns, "sequence"]
    stats = {r.folder: tuple(r)[1:] for r in out.groupBy("folder").agg(F.count("*"), F.count_distinct("sequence"), F.min("sequence"), F.max("sequence"), F.count_distinct("name")).collect()}
    half = N // 2
    assert stats == {"f0": (half, half, 101, 100 + half, half), "f1": (half, half, 1, half, half)}
    # in order: by sequence, the old order never falls
    from pyspark.sql.window import Window

    falls = out.withColumn("before", F.lag("old").over(Window.partitionBy("folder").orderBy("sequence"))).where("before > old")
    assert falls.count() == 0


def test_batches_are_full(spark, many, tmp_path):
    feed.batches(many, ["folder"], ["old"]).write.parquet(f"{tmp_path}/out")
    sizes = spark.read.parquet(f"{tmp_path}/out").groupBy("folder", "batch").agg(F.count("*").alias("n"))
    per = {r.folder: (r.k, r.last) for r in sizes.groupBy("folder").agg(F.count("*").alias("k"), F.max("batch").alias("last")).collect()}
    k = -(-N // 2 // 256)
    assert per == {"f0": (k, k - 1), "f1": (k, k - 1)}
    assert sizes.where("n <> 256").count() == 2 and sizes.agg(F.sum("n")).first()[0] == N


def test_awkward_places(spark):
    rows = spark.createDataFrame([(None, 3), (None, None), ("a", 2), ("a", 2), ("a", 1), ("b", 9)], "g string, k int")
    got = sorted(((r.g or "", r.k or 0, r["__place"]) for r in placed(rows, ["g"], ["k"], 7).collect()))
    assert got == [("", 0, 1), ("", 3, 2), ("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 9, 1)]
    assert sorted(r["__place"] for r in placed(rows, [], ["k"]).collect()) == [1, 2, 3, 4, 5, 6]
    assert placed(rows.limit(0), ["g"], ["k"]).count() == 0


def test_many_cursors_give_the_same_news(spark, monkeypatch):
    rows = spark.range(500).selectExpr("concat('f', id % 3) folder", "concat('n', id) name", "id sequence")
    cursors = spark.createDataFrame([("p", "f0", 0, 300), ("q", "f0", 100, 400), ("q", "f2", 7, 90)], "peer string, folder string, cursor long, snapshot long")
    few = sorted(map(tuple, feed.since(rows, cursors).collect()))
    monkeypatch.setattr(feed, "FEW", 1)
    assert sorted(map(tuple, feed.since(rows, cursors).collect())) == few and len(few) > 100


def test_written_tables_go_when_python_ends(tmp_path):
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        f"s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').getOrCreate()\n"
        "from replisift.session import materialized\n"
        "d = materialized(s.range(3), 'x')\n"
        "import os\n"
        f"print(d.count(), sum(n == s.sparkContext.applicationId for n in os.listdir('{tmp_path}/shared')))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["3", "1"] and not any(n.startswith("local-") for n in os.listdir(f"{tmp_path}/shared"))
