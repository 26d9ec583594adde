"""Tables in versions on plain files: a commit is seen whole or not at all, and of two writers one wins.

A version is an entry of a log: a small JSON file that names the data folders it
consists of.  Data are written first, under names of their own; then the entry is
put in place only if none of that number is there.  A writer that finds the
number taken reads what the other one committed and tries again.  So readers
see entries that are whole, and what they name is never changed.

Putting an entry in place is one link (local and mounted file systems) or one
rename that doesn't replace (others): as atomic as the store makes that.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.index import prune
from ..schema import conform

ATTEMPTS = 20
DIGITS = 20


class Conflict(RuntimeError):
    """Other writers were quicker too often."""


@dataclass
class Entry:
    """A version: its data folders, its schema, the last batch of each source that is in it, and what its writers noted."""

    number: int
    folders: list[str]
    schema: str
    batches: dict[str, int] = field(default_factory=dict)
    notes: dict[str, int | str] = field(default_factory=dict)


class VersionedTable:
    """A table under ``path`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # --- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/log")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _put(self, number: int, text: str) -> bool:
        """Whether the entry is now ours."""
        fs, target = self._fs(f"{self.path}/log/{number:0{DIGITS}d}.json")
        _, temp = self._fs(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                try:
                    os.link(temp.toUri().getPath(), target.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not fs.exists(target) and bool(fs.rename(temp, target))
        finally:
            fs.delete(temp, False)

    # --- reading

    def versions(self) -> list[int]:
        """The numbers of the versions that are there."""
        return self._numbers()

    def entry(self, number: int | None = None) -> Entry | None:
        """A version's entry, by default the last one's; None if there is none."""
        numbers = self._numbers()
        if number is None:
            number = numbers[-1] if numbers else None
        if number is None or number not in numbers:
            return None
        fs, p = self._fs(f"{self.path}/log/{number:0{DIGITS}d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Entry(**json.loads(text))

    def read(self, number: int | None = None) -> DataFrame | None:
        """A version's rows, by default the last one's; None if there is none.  Later commits don't change them."""
        return self._rows(self.entry(number))

    def _rows(self, entry: Entry | None) -> DataFrame | None:
        if entry is None:
            return None
        schema = T.StructType.fromJson(json.loads(entry.schema))
        if not entry.folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in entry.folders])

    # --- writing

    def _written(self, rows: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _discard(self, name: str) -> None:
        fs, p = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def _commit(self, make: Callable[[Entry | None], Entry | None], attempts: int) -> Entry | None:
        for _ in range(attempts):
            last = self.entry()
            new = make(last)
            if new is None:
                return last
            if self._put(new.number, json.dumps(vars(new))):
                return new
        raise Conflict(f"{self.path}: {attempts} attempts")

    @staticmethod
    def _done(last: Entry | None, batch: tuple[str, int] | None) -> bool:
        return batch is not None and last is not None and last.batches.get(batch[0], -1) >= batch[1]

    def replace(self, change: Callable[[DataFrame | None], DataFrame], batch: tuple[str, int] | None = None, notes: dict | None = None, attempts: int = ATTEMPTS) -> Entry | None:
        """Commits ``change`` of the last version's rows (None for none) as the next version.

        If another writer commits first, what was written is thrown away and
        ``change`` is made of that version, so no writer's work is lost.
        ``batch``: (source, number); a batch that is in the table already, or an
        earlier one of its source, changes nothing.
        """
        written: list[str] = []

        def make(last: Entry | None) -> Entry | None:
            for name in written:
                self._discard(name)
            written.clear()
            if self._done(last, batch):
                return None
            rows = change(self._rows(last))
            written.append(self._written(rows))
            return self._next(last, list(written), rows.schema, batch, notes)

        return self._commit(make, attempts)

    def append(self, rows: DataFrame, batch: tuple[str, int] | None = None, notes: Callable[[dict, str], dict] | dict | None = None, attempts: int = ATTEMPTS) -> Entry | None:
        """Commits more rows; what is there is neither read nor written again.  ``batch`` as in :meth:`replace`; ``notes`` may be made of those before and the new data folder."""
        before = self.entry()
        if self._done(before, batch):
            return before
        if before is not None:
            schema = T.StructType.fromJson(json.loads(before.schema))
            if set(schema.names) != set(rows.columns):
                raise ValueError(f"the table has other columns: {schema.names}")
            rows = rows.select(*[rows[f.name].cast(f.dataType) for f in schema])
        name = self._written(rows)

        def make(last: Entry | None) -> Entry | None:
            if self._done(last, batch):
                self._discard(name)
                return None
            if last is not None and before is not None and last.schema != before.schema:
                raise Conflict(f"{self.path}: another writer gave it other columns")
            return self._next(last, [*(last.folders if last else []), name], rows.schema if last is None else T.StructType.fromJson(json.loads(last.schema)), batch, notes)

        return self._commit(make, attempts)

    def note(self, notes: Callable[[dict], dict | None], without: Callable[[dict], set[str]] = lambda notes: set(), attempts: int = ATTEMPTS) -> Entry | None:
        """Commits a change of the notes, and leaves out the data folders that ``without`` names; None from ``notes`` commits nothing."""

        def make(last: Entry | None) -> Entry | None:
            if last is None or (new := notes(dict(last.notes))) is None:
                return None
            gone = without(dict(last.notes))
            return Entry(last.number + 1, [f for f in last.folders if f not in gone], last.schema, last.batches, new)

        return self._commit(make, attempts)

    @staticmethod
    def _next(last: Entry | None, folders: list[str], schema: T.StructType, batch: tuple[str, int] | None, notes) -> Entry:
        batches = dict(last.batches) if last else {}
        if batch is not None:
            batches[batch[0]] = batch[1]
        before = dict(last.notes) if last else {}
        told = notes(before, folders[-1]) if callable(notes) else before | (notes or {})
        return Entry(last.number + 1 if last else 0, folders, schema.json(), batches, told)

    def forget_old(self, keep: int = 2) -> int:
        """Deletes the entries before the last ``keep``, and the data that only they name; how many entries.  Readers of those versions must have ended."""
        numbers = self._numbers()
        old, kept = numbers[:-keep] if keep else numbers, numbers[-keep:] if keep else []
        named = {f for k in kept for f in self.entry(k).folders}
        gone = {f for k in old for f in self.entry(k).folders} - named
        for k in old:
            fs, p = self._fs(f"{self.path}/log/{k:0{DIGITS}d}.json")
            fs.delete(p, False)
        for name in gone:
            self._discard(name)
        return len(old)


def save_index(table: VersionedTable, change: Callable[[DataFrame | None], DataFrame], now_s: int, keep_days: int = 180, short_id: str = "") -> Entry | None:
    """Commits a change of an index, without tombstones that are old enough to be pruned, as one version."""
    return table.replace(lambda index: prune(conform(change(index)), now_s, keep_days), notes={"short_id": short_id})


class DurableQueue:
    """Rows parked on shared files, read back once each, first in, first out.

    The rows are appended to a versioned table with numbers of their own; how far
    it has been read is a note of the same log, so a restart goes on where the
    last commit was.  What a reader does with rows must be idempotent or commit
    its own batch under :meth:`token`, as it may be lost before the place is.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.table = VersionedTable(spark, path)

    def size(self) -> int:
        """How many rows wait."""
        entry = self.table.entry()
        return int(entry.notes["tail"]) - int(entry.notes["head"]) if entry else 0

    def push(self, rows: DataFrame, order: list[str], batch: tuple[str, int] | None = None) -> int:
        """Appends rows in an order; how many.  ``batch``: a repeated one is not pushed twice."""
        from pyspark.sql import functions as F

        from ..operators.places import placed

        # Numbered from 1 within the push; where the push begins is noted by its commit.
        pushed = uuid.uuid4().hex
        numbered = placed(rows, [], order, as_col="__place").withColumn("__push", F.lit(pushed))
        n = numbered.count()
        if not n:
            return 0

        def notes(before: dict, folder: str) -> dict:
            tail = int(before.get("tail", 0))
            return before | {"head": int(before.get("head", 0)), "tail": tail + n, f"push:{pushed}": f"{tail}:{folder}"}

        entry = self.table.append(numbered, batch, notes)
        return n if f"push:{pushed}" in entry.notes else 0

    @staticmethod
    def _pushes(notes: dict) -> list[tuple[int, str, str]]:
        """(where it begins, note, data folder) of the pushes that aren't read to their ends, in order."""
        return sorted((int(base), k, folder) for k, v in notes.items() if k.startswith("push:") for base, folder in [v.split(":", 1)])

    def _read(self, notes: dict, to: int) -> list[tuple[int, str, str]]:
        """The pushes that end at or before a place."""
        pushes = self._pushes(notes)
        ends = [p[0] for p in pushes[1:]] + [int(notes["tail"])]
        return [p for p, end in zip(pushes, ends, strict=True) if end <= to]

    def peek(self, most: int) -> tuple[DataFrame | None, int, int]:
        """(rows, from, to): the next ``most`` rows at most, by ``__number``, and the places they take."""
        from pyspark.sql import functions as F

        entry = self.table.entry()
        if entry is None:
            return None, 0, 0
        head, tail = int(entry.notes["head"]), int(entry.notes["tail"])
        to = min(tail, head + most)
        bases = [(k.removeprefix("push:"), base) for base, k, _ in self._pushes(entry.notes)]
        if not bases:
            return None, head, head
        starts = self.table.spark.createDataFrame(bases, "__push string, __base long")
        # Sent to all tasks: pushes are few, as the log's notes name each, and one of them may have all rows.
        rows = self.table.read(entry.number).join(F.broadcast(starts), "__push").withColumn("__number", F.col("__base") + F.col("__place") - 1)
        return rows.where((F.col("__number") >= head) & (F.col("__number") < to)).drop("__push", "__base", "__place"), head, to

    @staticmethod
    def token(start: int) -> tuple[str, int]:
        """The batch under which what is done with the rows from a place on can be committed once."""
        return "queue", start

    def done(self, start: int, to: int) -> bool:
        """Moves the head from ``start`` to ``to``, and lets go of pushes that are read to their ends; False if another reader moved it before."""

        def notes(before: dict) -> dict | None:
            if int(before["head"]) != start:
                return None
            read = {p[1] for p in self._read(before, to)}
            return {k: v for k, v in before.items() if k not in read} | {"head": to}

        entry = self.table.note(notes, lambda before: {p[2] for p in self._read(before, to)})
        return entry is not None and int(entry.notes["head"]) == to

    def drain(self, most: int, work: Callable[[DataFrame, tuple[str, int]], None]) -> int:
        """Gives the waiting rows to ``work`` (with a token) in portions, moving on after each; how many rows.  Rows pushed by ``work`` wait behind."""
        total = 0
        _, start, _ = self.peek(0)
        last = self.size() + start
        while start < last:
            rows, start, to = self.peek(min(most, last - start))
            if to == start:
                break
            work(rows, self.token(start))
            if not self.done(start, to):
                break
            total, start = total + to - start, to
        return total
