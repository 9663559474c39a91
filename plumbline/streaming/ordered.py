"""Ordered event state: which sequences of a run have come, and the last terminal event of each case.

Both are stateful processors over the event spine, in RocksDB. Runs, or cases of runs, are dealt into BUCKETS by a hash; a
bucket is one key with one value, which holds the states of all its runs or cases, since a call of a processor and each access
to its state cost far more than the work on one run. Events may come in
any order and more than once. What has come of a run is kept as disjoint intervals of sequences, so its state has an entry for each
open gap and one more, whatever the number of events. Results are changes: a row with change 1 holds from now
on, a row with change -1 no longer does, so a batch writes what it changed and standing() adds up to what holds.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Keys of a stream's state; a stream that goes on from a checkpoint must have those it began with.
BUCKETS = 1024

GAPS = "run_id string, missing_from long, missing_to long, status string, change int"
TERMINALS = "run_id string, case_id string, event_id long, kind string, change int"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which ordered state needs; the session's own choice comes back."""
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE_SETTING)
        else:
            spark.conf.set(STORE_SETTING, before)


def insert(lows: list[int], highs: list[int], low: int, high: int) -> None:
    """Adds [low, high] to disjoint, sorted intervals that do not touch, merging what meets it."""
    first, last = bisect_left(highs, low - 1), bisect_right(lows, high + 1)
    if first < last:
        low, high = min(low, lows[first]), max(high, highs[last - 1])
    lows[first:last], highs[first:last] = [low], [high]


def runs_of(sequences: list[int]) -> Iterator[tuple[int, int]]:
    """Stretches of consecutive numbers in a sorted list."""
    low = previous = None
    for s in sequences:
        if low is None:
            low = s
        elif s > previous + 1:
            yield low, previous
            low = s
        previous = s
    if low is not None:
        yield low, previous


def gaps_of(lows: list[int], highs: list[int]) -> set[tuple[int, int]]:
    """What is missing below the highest sequence; sequences begin at 1."""
    return {(before + 1, low - 1) for before, low in zip([0, *highs], lows) if low > before + 1}


class Bucket(StatefulProcessor):
    """A processor whose key has one value: what is known by name (a run, or a case of a run)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.body = handle.getValueState("body", "body binary")

    def load(self) -> dict[Any, Any]:
        return pickle.loads(bytes(self.body.get()[0])) if self.body.exists() else {}

    def keep(self, known: dict[Any, Any]) -> None:
        if known:
            self.body.update((pickle.dumps(known),))
        else:
            self.body.clear()

    def wake(self, times: Iterator[int]) -> None:
        """At the first of the times. A bucket waits for that alone and, woken, for the next, so it is not loaded once for each."""
        first = min(times, default=None)
        if first is not None:
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass


class GapState(Bucket):
    """Per run: the intervals that have come (lows, highs) and, with patience, when each gap was first seen (by its start)."""

    def __init__(self, patience_ms: int | None = None) -> None:
        self.patience_ms = patience_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        runs, come, latest, out = self.load(), {}, {}, []
        for batch in rows:
            for run, sequence in zip(batch["run_id"].tolist(), batch["sequence"].tolist()):
                come.setdefault(run, set()).add(sequence)
            if self.patience_ms is not None:
                for run, at in batch.groupby("run_id", dropna=False)["ts"].max().items():
                    run = None if pd.isna(run) else run
                    latest[run] = max(latest.get(run, 0), int(at.timestamp() * 1000))
        for run, sequences in come.items():
            lows, highs, due = runs.setdefault(run, ([], [], {}))
            seen = gaps_of(lows, highs)
            for low, high in runs_of(sorted(sequences)):
                insert(lows, highs, low, high)
            after = gaps_of(lows, highs)
            if self.patience_ms is not None:
                runs[run] = (lows, highs, self._wait(due, seen, after, latest[run] + self.patience_ms))
            out += [(run, *gap, "MISSING", -1) for gap in sorted(seen - after)] + [(run, *gap, "MISSING", 1) for gap in sorted(after - seen)]
        self.keep(runs)
        self.wake(at for *_, due in runs.values() for at in due.values())
        if out:
            yield pd.DataFrame(out, columns=["run_id", "missing_from", "missing_to", "status", "change"])

    def _wait(self, due: dict[int, int], seen: set[tuple[int, int]], after: set[tuple[int, int]], until: int) -> dict[int, int]:
        """When each gap is over; a part of an older gap keeps the older gap's time."""
        ends = dict(seen)
        return {low: min((t for start, t in due.items() if start <= high and ends.get(start, start) >= low), default=until) for low, high in after}

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Gaps whose time has passed are lost: told once, and no longer waited for."""
        now, runs, out = expiredTimerInfo.getExpiryTimeInMs(), self.load(), []
        for run, (lows, highs, due) in runs.items():
            over = {start for start, at in due.items() if at <= now}
            lost = sorted(gap for gap in gaps_of(lows, highs) if gap[0] in over) if over else []
            for start in over:
                del due[start]
            for low, high in lost:
                insert(lows, highs, low, high)
            out += [(run, low, high, status, change) for low, high in lost for status, change in (("MISSING", -1), ("LOST", 1))]
        self.wake(at for *_, due in runs.values() for at in due.values())
        if out:
            self.keep(runs)
            yield pd.DataFrame(out, columns=["run_id", "missing_from", "missing_to", "status", "change"])


class TerminalState(Bucket):
    """Per (run, case): the last event that is not to be retried, by time and then by id; an earlier one that comes late
    changes nothing. A case is forgotten once the watermark is keep_ms beyond its last event."""

    def __init__(self, keep_ms: int | None = None) -> None:
        self.keep_ms = keep_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cases, before = self.load(), {}
        for batch in rows:
            for run, case, *found in batch[["run_id", "case_id", "at", "event_id", "kind"]].itertuples(index=False, name=None):
                name, found = (run, case), (int(found[0]), int(found[1]), found[2])
                last = cases.get(name)
                if last is None or found[:2] > last[:2]:
                    before.setdefault(name, last)
                    cases[name] = found
        if before:
            self.keep(cases)
            if self.keep_ms is not None:
                self.wake(last[0] // 1000 + self.keep_ms for last in cases.values())
            told = [(*name, *last[1:], -1) for name, last in before.items() if last is not None] + [(*name, *cases[name][1:], 1) for name in before]
            yield pd.DataFrame(told, columns=["run_id", "case_id", "event_id", "kind", "change"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now, cases = expiredTimerInfo.getExpiryTimeInMs(), self.load()
        left = {name: last for name, last in cases.items() if last[0] // 1000 + self.keep_ms > now}
        if len(left) < len(cases):
            self.keep(left)
        self.wake(last[0] // 1000 + self.keep_ms for last in left.values())
        return iter(())


def _bucket(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int").alias("bucket")


def stream_gaps(events: DataFrame, *, patience_ms: int | None = None, late: str = "0 seconds") -> DataFrame:
    """Changes of the gaps of each run (run_id, sequence and, with patience, ts). Without patience a gap is MISSING until it
    is filled; with it, a gap that the watermark leaves more than patience behind is LOST, and what comes later of it is ignored."""
    if patience_ms is None:
        rows, time = events.select(F.col("run_id").cast("string").alias("run_id"), "sequence"), "None"
    else:
        rows, time = events.select(F.col("run_id").cast("string").alias("run_id"), "sequence", "ts").withWatermark("ts", late), "EventTime"
    return rows.select("*", _bucket("run_id")).groupBy("bucket").transformWithStateInPandas(GapState(patience_ms), GAPS, "Update", time)


def stream_terminals(events: DataFrame, *, keep_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Changes of the last terminal event of each case (run_id, case_id, ts, event_id, kind, will_retry). With keep_ms cases
    are forgotten, and events that come more than late behind the newest one are not seen."""
    timed = events if keep_ms is None else events.withWatermark("ts", late)
    rows = timed.filter(~F.col("will_retry")).select(F.col("run_id").cast("string").alias("run_id"), F.col("case_id").cast("string").alias("case_id"), F.unix_micros("ts").alias("at"), "event_id", "kind", *["ts"] * (keep_ms is not None))
    return rows.select("*", _bucket("run_id", "case_id")).groupBy("bucket").transformWithStateInPandas(TerminalState(keep_ms), TERMINALS, "Update", "None" if keep_ms is None else "EventTime")


def standing(changes: DataFrame) -> DataFrame:
    """What holds after all changes."""
    columns = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*columns).agg(F.sum("change").alias("change")).filter("change > 0").drop("change")
