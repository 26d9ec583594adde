"""Transfers as keyed state with timers: attempts, retries of blocks, and what falls silent is abandoned.

A transfer is one file that one session fetches.  A block that arrives damaged
is asked for again, ``RETRIES`` times; an attempt ends when a block is damaged
once more, when the peer refuses the file, or when no good block came for
``QUIET_S`` seconds.  The file is then tried again from the blocks that are
there, ``TRIES`` times in all, after which it is stalled until it is wanted anew.
With a window the log also says which blocks to ask for: the lowest missing ones,
so many that as many requests are open at once; blocks that weren't asked for are
passed over, and a new attempt asks anew.

:func:`transfer_stream` keeps a row of state a transfer and a timer for its
silence; in event time it says the same as :func:`replay` of the whole table,
however the stream is cut into batches.  In processing time silence is measured
by the arrival of blocks, as a running receiver needs it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

#: Seconds without a block, retries of a block, attempts at a file.
QUIET_S, RETRIES, TRIES = 120, 3, 3
MICROS = 1_000_000
KEYS = ["session", "folder", "name"]
#: ``event``: ``want`` (with ``n_blocks``), ``block`` (``i``, ``good``), ``refused``.
EVENTS = "session string, folder string, name string, at timestamp, event string, n_blocks long, i long, good boolean"
#: ``step``: started, ask (block ``i``, with a window), again (block ``i``), retried, stalled, done.
LOG = "session string, folder string, name string, at_us long, step string, attempt int, i long"
STATE = "phase string, attempt int, n_blocks long, last_us long, there binary, asked binary, retries string, timer_ms long"


@dataclass
class Transfer:
    """The state of one transfer, and what each event makes of it."""

    quiet_us: int = QUIET_S * MICROS
    phase: str = "idle"
    attempt: int = 0
    n_blocks: int = 0
    last_us: int = 0
    there: int = 0  # a bit a block
    retries: dict[int, int] = field(default_factory=dict)
    window: int = 0
    asked: int = 0  # a bit a block, too

    def _again(self, at_us: int) -> list[tuple]:
        """An attempt has failed: the next one begins, from the blocks that are there, or there is none left."""
        self.retries, self.asked = {}, 0
        if self.attempt < TRIES:
            self.attempt, self.last_us = self.attempt + 1, at_us
            return [(at_us, "retried", self.attempt, None), *self._ask(at_us)]
        self.phase = "stalled"
        return [(at_us, "stalled", self.attempt, None)]

    def _ask(self, at_us: int) -> list[tuple]:
        """Requests for the lowest blocks that are neither there nor asked for, up to the window."""
        out = []
        while self.phase == "active" and (self.asked & ~self.there).bit_count() < self.window:
            known = self.asked | self.there
            i = (~known & known + 1).bit_length() - 1
            if i >= self.n_blocks:
                break
            self.asked |= 1 << i
            out.append((at_us, "ask", self.attempt, i))
        return out

    def _whole(self, at_us: int) -> list[tuple]:
        if self.there.bit_count() < self.n_blocks:
            return []
        self.phase = "done"
        return [(at_us, "done", self.attempt, None)]

    def silence(self, now_us: int) -> list[tuple]:
        """The attempts that ended for silence up to now."""
        out = []
        while self.phase == "active" and now_us - self.last_us > self.quiet_us:
            out += self._again(self.last_us + self.quiet_us)
        return out

    def step(self, at_us: int, event: str, n_blocks: int | None, i: int | None, good: bool | None) -> list[tuple]:
        """(at, step, attempt, block) of what an event changes; events of a transfer that isn't under way change nothing."""
        out = self.silence(at_us)
        if event == "want" and self.phase != "active":
            if n_blocks != self.n_blocks or self.phase == "done":
                self.there = 0
            self.phase, self.attempt, self.n_blocks, self.last_us, self.retries, self.asked = "active", 1, n_blocks or 0, at_us, {}, 0
            out.append((at_us, "started", 1, None))
            out += self._whole(at_us) + self._ask(at_us)
        elif self.phase != "active":
            return out
        elif event == "refused":
            out += self._again(at_us)
        elif event == "block" and i is not None and 0 <= i < self.n_blocks and not self.there >> i & 1 and (not self.window or self.asked >> i & 1):
            if good:
                self.there |= 1 << i
                self.last_us = at_us
                self.retries.pop(i, None)
                out += self._whole(at_us) + self._ask(at_us)
            else:
                self.retries[i] = self.retries.get(i, 0) + 1
                out += self._again(at_us) if self.retries[i] > RETRIES else [(at_us, "again", self.attempt, i)]
        return out

    def packed(self, timer_ms: int) -> tuple:
        """The state as a row of :data:`STATE`."""
        bits = lambda x: x.to_bytes((x.bit_length() + 7) // 8, "little")
        return self.phase, self.attempt, self.n_blocks, self.last_us, bits(self.there), bits(self.asked), ",".join(f"{k}:{v}" for k, v in self.retries.items()), timer_ms

    @classmethod
    def unpacked(cls, row: tuple, quiet_us: int, window: int = 0) -> Transfer:
        """The inverse of :meth:`packed`."""
        phase, attempt, n_blocks, last_us, there, asked, retries, _ = row
        tries = {int(k): int(v) for k, _, v in (x.partition(":") for x in retries.split(",") if x)}
        return cls(quiet_us, phase, attempt, n_blocks, last_us, int.from_bytes(bytes(there), "little"), tries, window, int.from_bytes(bytes(asked), "little"))


#: Order of events that have one time.
_ORDER = {"want": 0, "block": 1, "refused": 2}


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0], _ORDER.get(r[1], 3), -1 if r[3] is None else r[3], bool(r[4])))


class _Processor(StatefulProcessor):
    """One row of state and one timer a transfer."""

    def __init__(self, quiet_us: int, by_arrival: bool, window: int) -> None:
        self.quiet_us, self.by_arrival, self.window = quiet_us, by_arrival, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("transfer", STATE)

    def _load(self) -> tuple[Transfer, int]:
        row = self.state.get()
        return (Transfer.unpacked(tuple(row), self.quiet_us, self.window), row[7]) if row is not None else (Transfer(self.quiet_us, window=self.window), -1)

    def _keep(self, transfer: Transfer, timer_ms: int) -> None:
        due = (transfer.last_us + self.quiet_us) // 1000 + 1 if transfer.phase == "active" else -1
        if due != timer_ms:
            if timer_ms >= 0:
                self.handle.deleteTimer(timer_ms)
            if due >= 0:
                self.handle.registerTimer(due)
        if transfer.phase in ("idle", "done"):
            # Nothing to remember: the next want begins as the first did.  So state grows with what is under way or stalled.
            if self.state.exists():
                self.state.clear()
        else:
            self.state.update(transfer.packed(due))

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        transfer, timer_ms = self._load()
        events = [(r["at_us"], r["event"], r["n_blocks"], r["i"], r["good"]) for r in rows]
        if self.by_arrival:
            now_us = timerValues.getCurrentProcessingTimeInMs() * 1000
            events = [(now_us, *e[1:]) for e in _sorted(events)]
        else:
            events = _sorted(events)
        for event in events:
            for at_us, step, attempt, i in transfer.step(*event):
                yield Row(session=key[0], folder=key[1], name=key[2], at_us=at_us, step=step, attempt=attempt, i=i)
        self._keep(transfer, timer_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        from pyspark.sql import Row

        transfer, _ = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        now_ms = timerValues.getCurrentProcessingTimeInMs() if self.by_arrival else timerValues.getCurrentWatermarkInMs()
        for at_us, step, attempt, i in transfer.silence(max(now_ms, due) * 1000):
            yield Row(session=key[0], folder=key[1], name=key[2], at_us=at_us, step=step, attempt=attempt, i=i)
        self._keep(transfer, -1)  # the timer that went off is gone

    def close(self) -> None:
        pass


def _events(events: DataFrame) -> DataFrame:
    return events.withColumn("at_us", F.unix_micros(F.col("at").cast("timestamp"))).withColumn("at", F.col("at").cast("timestamp"))


def transfer_stream(events: DataFrame, late: str = "0 seconds", quiet_s: int = QUIET_S, by_arrival: bool = False, window: int = 0) -> DataFrame:
    """The log of transfers from a stream of :data:`EVENTS`.

    In event time (``by_arrival`` false) events may be ``late`` by that much, and
    silence is told once the watermark has passed it; events of one transfer
    must come in order across batches.  With ``by_arrival`` the clock of the
    executors tells it.  Needs the RocksDB state store (:func:`with_state_store`).
    """
    ship(events.sparkSession)
    rows = _events(events)
    rows = rows if by_arrival else rows.withWatermark("at", late)
    return rows.groupBy(*KEYS).transformWithState(_Processor(quiet_s * MICROS, by_arrival, window), LOG, "append", "ProcessingTime" if by_arrival else "EventTime")


def with_state_store(spark) -> None:
    """Sets the store that keyed state with timers needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(events: DataFrame, until_us: int | None = None, quiet_s: int = QUIET_S, window: int = 0) -> DataFrame:
    """The log of transfers from a table of :data:`EVENTS`: each transfer's events in order, then its silence until a time.

    Events stream through tasks sorted by transfer, so none is held whole.  No event: no row.
    """
    ship(events.sparkSession)
    rows = _events(events).select(*KEYS, "at_us", "event", "n_blocks", "i", "good")
    order = F.when(F.col("event") == "want", 0).when(F.col("event") == "block", 1).otherwise(2)
    dealt = rows.withColumn("__order", order).repartition(*KEYS).sortWithinPartitions(*KEYS, "at_us", "__order", "i", "good").drop("__order")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in LOG.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
        own, transfer, out = None, Transfer(quiet_s * MICROS, window=window), []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)
            out.clear()
            return batch

        def end() -> None:
            if own is not None and until_us is not None:
                out.extend((*own, *x) for x in transfer.silence(until_us))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != own:
                    end()
                    own, transfer = row[:3], Transfer(quiet_s * MICROS, window=window)
                out.extend((*own, *x) for x in transfer.step(*row[3:]))
            yield flush()
        end()
        yield flush()

    return dealt.mapInArrow(run, LOG)


def latest_states(log: DataFrame) -> DataFrame:
    """(session, folder, name, step, attempt): each transfer's last step; of steps at one time the one that ends it."""
    rank = F.when(F.col("step").isin("done", "stalled"), 2).when(F.col("step") == "retried", 1).otherwise(0)
    last = F.max_by(F.struct("step", "attempt"), F.struct("at_us", "attempt", rank)).alias("l")
    return log.where("step <> 'ask'").groupBy(*KEYS).agg(last).select(*KEYS, "l.step", "l.attempt")
