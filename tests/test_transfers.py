"""Transfers with timers: the stream against a replay, and both against a plain fold."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from replisift.streaming import transfers as T

START = dt.datetime(2024, 1, 1)


def fold(events, until, quiet=120, window=0):
    """The rules once more, written down for one transfer: (second, event, n_blocks, i, good) in order."""
    log, phase, attempt, n, last, there, tries, asked = [], "idle", 0, 0, 0, set(), {}, set()

    def ask(at):
        for i in range(n):
            if phase == "active" and i not in there and i not in asked and len(asked - there) < window:
                asked.add(i)
                log.append((at, "ask", attempt, i))

    def fail(at):
        nonlocal phase, attempt, last, tries
        tries = {}
        asked.clear()
        if attempt == 3:
            phase = "stalled"
        else:
            attempt, last = attempt + 1, at
        log.append((at, "stalled" if phase == "stalled" else "retried", attempt, None))
        ask(at)

    def quiet_until(at):
        while phase == "active" and at - last > quiet:
            fail(last + quiet)

    for at, event, blocks, i, good in events:
        quiet_until(at)
        if event == "want":
            if phase != "active":
                there = there if blocks == n and phase == "stalled" else set()
                phase, attempt, n, last, tries = "active", 1, blocks, at, {}
                log.append((at, "started", 1, None))
                asked.clear()
                if len(there) < n:
                    ask(at)
        elif phase == "active" and event == "refused":
            fail(at)
        elif phase == "active" and event == "block" and i < n and i not in there and (not window or i in asked):
            if good:
                there.add(i)
                last = at
                tries.pop(i, None)
                if len(there) < n:
                    ask(at)
            else:
                tries[i] = tries.get(i, 0) + 1
                if tries[i] == 4:
                    fail(at)
                else:
                    log.append((at, "again", attempt, i))
        if phase == "active" and len(there) == n:
            phase = "done"
            log.append((at, "done", attempt, None))
    quiet_until(until)
    return log


def history(rng, length):
    out, at = [], 0
    n = rng.choice([0, 1, 3, 6])
    for _ in range(length):
        at += rng.choice([1, 2, 5, 60, 119, 121, 300]) if rng.random() < 0.6 else 1
        kind = rng.choice(["want", "block", "block", "block", "block", "refused"]) if out else "want"
        out.append((at, kind, n if kind == "want" else None, rng.randrange(max(1, n)) if kind == "block" else None, rng.random() < 0.6 if kind == "block" else None))
    return out


def rows_of(histories):
    return [(key, "f", "x", START + dt.timedelta(seconds=at), e, n, i, g) for key, events in histories.items() for at, e, n, i, g in events]


def logged(df):
    base = int(START.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    out = {}
    for r in df.collect():
        out.setdefault(r.session, []).append(((r.at_us - base) // 1_000_000, r.step, r.attempt, r.i))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_replay_equals_a_fold(spark):
    rng = random.Random(1)
    histories = {f"s{k}": history(rng, rng.randrange(1, 40)) for k in range(120)}
    until = 20_000
    base = int(START.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    events = spark.createDataFrame(rows_of(histories), T.EVENTS).repartition(4)
    got = logged(T.replay(events, base + until * 1_000_000))
    want = {k: sorted(fold(v, until), key=str) for k, v in histories.items()}
    assert got == {k: v for k, v in want.items() if v}
    steps = {s for v in want.values() for _, s, _, _ in v}
    assert steps == {"started", "again", "retried", "stalled", "done"}
    last = {r.session: (r.step, r.attempt) for r in T.latest_states(T.replay(events, base + until * 1_000_000)).collect()}
    ends = {k: [x for x in fold(v, until)][-1] for k, v in histories.items()}
    assert all(last[k] == (e[1], e[2]) for k, e in ends.items())
    assert T.replay(events.where("false")).count() == 0


def test_stream_equals_the_replay(spark, tmp_path):
    """Histories in batches of any borders, with a timer for each silence."""
    T.with_state_store(spark)
    rng = random.Random(2)
    histories = {f"s{k}": history(rng, rng.randrange(1, 30)) for k in range(40)}
    end = 50_000
    histories["clock"] = [(end, "want", 0, None, None)]
    rows = sorted(rows_of(histories), key=lambda r: r[3])
    cuts = sorted(rng.sample(range(1, len(rows)), 4))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], T.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k:02d}")
    stream = spark.readStream.schema(T.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = T.transfer_stream(stream, window=2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = logged(spark.read.schema(T.LOG).parquet(f"{tmp_path}/out"))
    base = int(START.replace(tzinfo=dt.UTC).timestamp()) * 1_000_000
    want = logged(T.replay(spark.createDataFrame(rows, T.EVENTS), base + end * 1_000_000, window=2))
    assert got == want


def test_a_quiet_transfer_is_abandoned_by_the_clock(spark, tmp_path):
    """In processing time a timer goes off though nothing arrives any more."""
    T.with_state_store(spark)
    rows = [("s", "f", "quiet", START, "want", 2, None, None), ("s", "f", "quick", START, "want", 1, None, None), ("s", "f", "quick", START, "block", None, 0, True)]
    spark.createDataFrame(rows, T.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(T.EVENTS).parquet(f"{tmp_path}/in/*")
    log = T.transfer_stream(stream, quiet_s=1, by_arrival=True)
    query = log.writeStream.format("memory").queryName("transfer_log").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("transfer_log").where("step = 'stalled'").count() == 0:
            time.sleep(0.5)
    finally:
        query.stop()
    steps = {}
    for r in spark.table("transfer_log").orderBy("at_us", "attempt").collect():
        steps.setdefault(r.name, []).append((r.step, r.attempt))
    assert steps["quick"] == [("started", 1), ("done", 1)]
    assert steps["quiet"] == [("started", 1), ("retried", 2), ("retried", 3), ("stalled", 3)]


@pytest.mark.parametrize("window", [0, 1, 4])
def test_windows_of_requests(window):
    for seed in range(1500):
        rng = random.Random(seed)
        events, one, got = history(rng, rng.randrange(1, 50)), T.Transfer(window=window), []
        for at, *event in events:
            got += one.step(at * T.MICROS, *event)
            assert (one.asked & ~one.there).bit_count() <= max(window, 0)
        got += one.silence(20_000 * T.MICROS)
        assert sorted([(a // T.MICROS, *r) for a, *r in got], key=str) == sorted(fold(events, 20_000, window=window), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_state_survives_packing(seed):
    rng = random.Random(seed)
    one = T.Transfer(window=seed)
    for at, *event in history(rng, 60):
        two = T.Transfer.unpacked(one.packed(5), one.quiet_us, seed)
        assert two == one
        one.step(at * T.MICROS, *event)
