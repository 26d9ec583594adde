"""A walk of directory trees, level by level, on the executors.

The directories of one depth are listed at once, each by one task, and what they
hold is written before the next level begins; so a tree is walked in as many
steps as it is deep, and no task follows a subtree.  Every directory has a
status, files of no bytes are listed like others, and what a walk couldn't see
is told beside what it saw: a scan must conclude nothing from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.scan import DEEPEST
from ..schema import KEY
from ..session import materialized, ship

#: Bytes of the longest path; what a file system gives of an entry: (name, is_dir, size, modified_s).
LONGEST = 255
Lister = Callable[[str], Iterator[tuple[str, bool, int, int]]]

_LISTED = "folder string, place string, parent string, depth int, base string, is_dir boolean, size long, modified_s long, problem string"


def list_directory(place: str) -> Iterator[tuple[str, bool, int, int]]:
    """The entries of a directory of any file system that Arrow opens by URI or path, without those below."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
    for info in store.get_file_info(fs.FileSelector(path)):
        is_dir = info.type == fs.FileType.Directory
        yield info.base_name, is_dir, 0 if is_dir else int(info.size or 0), int((info.mtime_ns or 0) // 1_000_000_000)


@dataclass
class Walk:
    """What a walk found.

    ``entries``: (folder, name, size, modified_s, is_dir), as scans take them.
    ``problems``: (folder, name, kind): ``unopened`` directories, those ``deep``
    ones whose content isn't walked, and ``long`` names (of the parent and the entry).
    ``outcomes``: (folder, outcome): ``complete``, ``aborted``, or ``cannot open`` for a root that can't be listed.
    """

    entries: DataFrame
    problems: DataFrame
    outcomes: DataFrame

    def tallies(self) -> DataFrame:
        """(folder, kind, n, example): how often something was left out, with the first name of it."""
        return self.problems.groupBy("folder", "kind").agg(F.count("*").alias("n"), F.min("name").alias("example"))

    def concluded(self) -> DataFrame:
        """The folders whose walk allows a sweep."""
        return self.outcomes.where("outcome = 'complete'").select("folder")

    def sheltered(self, index: DataFrame) -> DataFrame:
        """The keys of records that this walk says nothing about: of folders that it didn't complete, and below directories that it couldn't open.

        A name is held against its own ancestors by equality, so no pair of paths is compared.
        """
        keys = index.select(*KEY)
        open_folders = keys.join(self.concluded(), "folder", "left_anti")
        shut = self.problems.where("kind = 'unopened'").select("folder", F.col("name").alias("above")).distinct()
        parts = F.split("name", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
        below = keys.where(F.instr("name", "/") > 0).withColumn("above", F.explode(above)).join(shut, ["folder", "above"], "left_semi")
        return open_folders.unionByName(below.select(*KEY)).distinct()


def walk_folders(
    spark: SparkSession,
    roots: DataFrame,
    temp_suffix: str,
    ignored: Callable[[Column], Column] | None = None,
    deepest: int = DEEPEST,
    longest: int = LONGEST,
    lister: Lister = list_directory,
    stop: Callable[[], bool] = lambda: False,
    tasks: int | None = None,
) -> Walk:
    """Walks the folders ``roots`` (folder, root).

    Left out, with what is below: rule files, staged files (``temp_suffix``, in
    any case of letters), the archive at the top, and what ``ignored`` says of a
    name.  A directory at the greatest depth is an entry, but isn't opened; a
    path of more than ``longest`` bytes is no entry.  ``stop`` is asked before
    each level; once it says so, folders that have directories left are aborted.

    A directory that was removed meanwhile counts as unopened.  Empty roots: no
    entry, complete.  No root: no row.  A directory's own listing is one task's.
    """
    if not temp_suffix:
        raise ValueError("without a suffix every file would be a temporary one")
    ship(spark)
    low, name = F.lower("base"), F.when(F.col("parent") == "", F.col("base")).otherwise(F.concat_ws("/", "parent", "base"))
    own = (low == ".stignore") | low.endswith(temp_suffix.lower()) | ((F.col("depth") == 0) & (low == ".stversions"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _LISTED.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for folder, place, parent, depth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                here = (folder, place, parent, depth)
                try:
                    for base, is_dir, size, modified_s in lister(place):
                        rows.append((*here, base, is_dir, size, modified_s, None))
                        if len(rows) >= 10_000:
                            yield out(rows)
                            rows = []
                    rows.append((*here, None, None, None, None, "opened"))
                except OSError:
                    # What was listed before the fault stands; what wasn't is told by the problem.
                    rows.append((*here, None, None, None, None, "unopened"))
                yield out(rows)

    frontier = roots.select("folder", F.col("root").alias("place"), F.lit("").alias("parent"), F.lit(0).alias("depth"))
    known, levels, left = roots.select("folder").distinct(), [], None
    for _ in range(deepest):
        if stop():
            left = frontier.select("folder").distinct()
            break
        dealt = frontier.repartition(tasks, "folder", "place") if tasks else frontier.repartition("folder", "place")
        rows = dealt.mapInArrow(listed, _LISTED).withColumn("name", name)
        kept = rows.where(F.col("base").isNull() | ~own)
        if ignored is not None:
            kept = kept.where(F.col("base").isNull() | ~ignored(F.col("name")))
        level = materialized(kept.withColumn("long", F.octet_length("name") > longest), "walk")
        levels.append(level)
        # Further levels are read from what is written: no lineage through listings.
        frontier = level.where(F.col("is_dir") & ~F.col("long") & (F.col("depth") + 1 < deepest)).select(
            "folder", F.concat_ws("/", F.rtrim(F.col("place"), F.lit("/")), "base").alias("place"), F.col("name").alias("parent"), (F.col("depth") + 1).alias("depth")
        )
        if frontier.isEmpty():
            break
    empty = spark.createDataFrame([], _LISTED + ", name string, long boolean")
    found = empty
    for level in levels:
        found = found.unionByName(level)
    entries = found.where("base IS NOT NULL AND NOT long").select(*KEY, "size", "modified_s", "is_dir")
    unopened = found.where("problem = 'unopened' AND parent <> ''").select("folder", F.col("parent").alias("name"), F.lit("unopened").alias("kind"))
    deep = found.where(F.col("is_dir") & ~F.col("long") & (F.col("depth") + 1 >= deepest)).select("folder", "name", F.lit("deep").alias("kind"))
    longer = found.where("long").select("folder", "name", F.lit("long").alias("kind"))
    shut = found.where("problem = 'unopened' AND parent = ''").select("folder", F.lit(True).alias("__shut")).distinct()
    aborted = (left if left is not None else known.where("false")).select("folder", F.lit(True).alias("__left"))
    outcome = F.when(F.col("__shut"), "cannot open").when(F.col("__left"), "aborted").otherwise("complete")
    outcomes = known.join(shut, "folder", "left").join(aborted, "folder", "left").select("folder", outcome.alias("outcome"))
    return Walk(entries, unopened.unionByName(deep).unionByName(longer), outcomes)


def depth_of(entries: DataFrame) -> DataFrame:
    """(folder, depth, files, directories, bytes): how a tree is made up, by depth."""
    rows = entries.withColumn("depth", paths.depth(F.col("name")))
    return rows.groupBy("folder", "depth").agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories"), F.sum("size").alias("bytes"))
