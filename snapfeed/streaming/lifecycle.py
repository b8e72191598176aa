"""STR2: the run lifecycle as keyed state with event-time timers.

One read of the event stream. Runs are dealt into buckets by a hash of their id; a
bucket's runs are one state value with one timer, the earliest that any of them
needs, so a bucket costs a few calls to the state store however many events it
has. Per run the state holds the status, the start and how many terminal rows it
has sent. The end of ``seconds`` after a ``running`` event is due then; when the
watermark passes it and no end has come, a timed-out error row goes out. An end
that comes after that goes out too, as a correction with the next revision, so
the row of a run with the greatest revision is its final one (``final_runs``).
Repeated events change nothing. A run is forgotten ``keep_seconds`` after its
last event.

The watermark lags ``delay`` behind the newest event: an end that arrives out of
order by up to that much still counts, one that is later still is dropped by the
stream, and a timeout goes out that much later.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run_id long, source_id string, status string, timed_out boolean, event_ms long, revision int"
STATE = "runs array<struct<run_id: string, status: string, source_id: string, started_ms: long, last_ms: long, revision: int, forget_ms: long>>"
BUCKETS = 1024
NEW = (None, None, None, None, 0)
ENDS = ("ok", "error")


def advance(state: tuple, events: list[tuple], limit_ms: int) -> tuple[tuple, list[tuple]]:
    """(next state, terminal rows) for a run's events (ms, seq, kind, source) in
    order of time. ``state``: status, source_id, started_ms, last_ms, revision."""
    status, source, started, last, revision = state
    out = []
    for ms, _, kind, src in sorted(events, key=lambda e: (e[0], e[1])):
        source, last = src or source, max(last or 0, ms)
        if status in ENDS:
            continue
        if kind == "running" and status != "timed out":
            status, started = kind, ms
        elif kind == "queued" and status is None:
            status, started = kind, ms
        elif kind in ENDS:
            status, revision = kind, revision + 1
            out.append((source, kind, False, ms, revision))
    return (status, source, started, last, revision), out


class RunLifecycle(StatefulProcessor):
    def __init__(self, seconds: int, keep_seconds: int):
        self.limit_ms, self.keep_ms = seconds * 1000, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.runs = handle.getValueState("runs", STATE)

    def _read(self) -> dict[str, tuple]:
        stored = self.runs.get()
        return {r[0]: tuple(r[1:]) for r in stored[0]} if stored else {}

    def _due(self, runs: dict[str, tuple]) -> int | None:
        """When the first of the runs times out or is forgotten."""
        return min((started + self.limit_ms if status == "running" else forget for status, _, started, _, _, forget in runs.values()), default=None)

    def _store(self, runs: dict[str, tuple], timer: int | None) -> None:
        """``timer``: the one that is set."""
        if runs:
            self.runs.update(([(run, *state) for run, state in runs.items()],))
        else:
            self.runs.clear()
        due = self._due(runs)
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame([(int(run), *r) for run, *r in rows], columns=["run_id", "source_id", "status", "timed_out", "event_ms", "revision"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, events, out = self._read(), defaultdict(list), []
        timer = self._due(runs)
        for pdf in rows:
            for run, *event in zip(*(pdf[c].tolist() for c in ("run_id", "ms", "seq", "kind", "source_id"))):
                events[run].append(tuple(event))
        for run, own in events.items():
            after, ends = advance(runs.get(run, NEW)[:5], own, self.limit_ms)
            runs[run] = (*after, after[3] + self.keep_ms)
            out += [(run, *r) for r in ends]
        self._store(runs, timer)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, left = timerValues.getCurrentWatermarkInMs(), [], {}
        for run, (status, source, started, last, revision, forget) in self._read().items():
            if status == "running" and (at := started + self.limit_ms) < now:
                status, revision = "timed out", revision + 1
                out.append((run, source, "error", True, at, revision))
            if forget >= now:
                left[run] = (status, source, started, last, revision, forget)
        self._store(left, None)  # the timer that fired is gone
        yield from self._rows(out)

    def close(self) -> None:
        pass


def run_lifecycle(events: DataFrame, seconds: int = 1800, delay: str = "0 seconds", keep_seconds: int = 7 * 86400, buckets: int = BUCKETS) -> DataFrame:
    """Terminal rows of a stream of run events (run_id, source_id, kind, ts, seq);
    append mode. State lives in RocksDB, which timers need. A checkpoint keeps its
    number of ``buckets``; a few thousand runs that are not forgotten in each are fine."""
    if keep_seconds <= seconds:
        raise ValueError("keep_seconds must be greater than seconds")
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the worker that prepares a stateful stream doesn't see files added to the
    # session, so this module's code goes with the processor
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rows = (events.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts"))
            .select(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("run_id").cast("string").alias("run_id"),
                    "source_id", "kind", "ts", "ms", "seq"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        RunLifecycle(seconds, keep_seconds), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def final_runs(out: DataFrame) -> DataFrame:
    """One row per run: its newest revision, and whether that corrects a timeout."""
    last = F.max_by(F.struct("source_id", "status", "timed_out", "event_ms"), "revision").alias("r")
    return (out.groupBy("run_id").agg(last, F.max("revision").alias("revision"), F.bool_or("timed_out").alias("_t"))
            .select("run_id", "r.*", "revision", (F.col("_t") & ~F.col("r.timed_out")).alias("corrected")))
