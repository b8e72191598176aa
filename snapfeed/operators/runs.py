"""Run lifecycle (LIF1, LIF2, AGG6, AGG8-10, JOIN9).

Runs are kept as an append-only event log (SNK2) — kinds ``queued``,
``running``, ``ok``, ``error`` — and the current row of a run is derived by
"last transition wins" aggregates, which combine map-side and so do not care
how many runs one source has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.misc import duration_ms

# Run states.
STATUSES = ("queued", "running", "ok", "error")
TERMINAL = ("ok", "error")
STALE_SECONDS = 1800


def stale_message(seconds: int) -> str:
    return f"no end within {seconds} s, taken as failed"


def current(events: DataFrame) -> DataFrame:
    """AGG6 / LIF1: run rows from run events.

    ``events``: run_id, source_id, source_name, kind, ts, seq (tie-break within
    a run), item_count, items_new, items_updated, items_removed, error.
    Rules: queued opens the run (started_at = created_at = ts); running moves
    started_at; ok sets ended_at, duration, counts and clears error; error sets
    ended_at, duration, error and zeroes item_count (other counts stay)."""
    ev = events if "seq" in events.columns else events.withColumn("seq", F.lit(0))
    order = F.struct(F.col("ts"), F.col("seq"))
    w = Window.partitionBy("run_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    is_start = F.col("kind").isin("queued", "running")
    # start in force at each event (bounded: a run has a handful of events)
    ev = ev.withColumn("_start", F.last(F.when(is_start, F.col("ts")), ignorenulls=True).over(w))
    term = F.col("kind").isin(*TERMINAL)
    last_term = F.max_by(F.struct(
        F.col("kind").alias("kind"), F.col("ts").alias("ts"), F.col("_start").alias("start"),
        F.col("error").alias("error"), F.col("item_count").alias("item_count")), F.when(term, order))
    last_ok = F.max_by(F.struct(F.col("items_new").alias("n"), F.col("items_updated").alias("u"),
                                F.col("items_removed").alias("r")), F.when(F.col("kind") == "ok", order))
    agg = ev.groupBy("run_id").agg(
        F.max_by("source_id", order).alias("source_id"),
        F.max_by("source_name", order).alias("source_name"),
        F.max_by("kind", order).alias("status"),
        F.max(F.when(is_start, F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("kind") == "queued", F.col("ts"))).alias("created_at"),
        last_term.alias("t"), last_ok.alias("o"))
    return agg.select(
        "run_id", "source_id", "source_name", "status", "started_at",
        F.col("t.ts").alias("ended_at"),
        F.when(F.col("t.ts").isNotNull(), duration_ms(F.coalesce("t.start", "t.ts"), "t.ts")).alias("duration_ms"),
        F.when(F.col("t.kind") == "error", F.lit(0)).otherwise(F.col("t.item_count")).cast("long").alias("item_count"),
        F.coalesce("o.n", F.lit(0)).cast("long").alias("items_new"),
        F.coalesce("o.u", F.lit(0)).cast("long").alias("items_updated"),
        F.coalesce("o.r", F.lit(0)).cast("long").alias("items_removed"),
        F.when(F.col("t.kind") == "error", F.col("t.error")).alias("error"),
        F.coalesce("created_at", "started_at").alias("created_at"))


def unknown_run_events(events: DataFrame) -> DataFrame:
    """Transitions for runs that were never created (RunNotFound)."""
    created = events.where(F.col("kind") == "queued").select("run_id").distinct()
    return events.where(F.col("kind") != "queued").join(created, "run_id", "left_anti")


def reap(runs: DataFrame, as_of, older_than_seconds: int = STALE_SECONDS) -> DataFrame:
    """LIF2: running runs started strictly before ``as_of - seconds`` become
    errors ended at ``as_of``; adds a boolean ``reaped`` column."""
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, F.Column) else as_of
    cutoff = as_of - F.make_dt_interval(secs=F.lit(older_than_seconds))
    stale = (F.col("status") == "running") & (F.col("started_at") < cutoff)
    cols = []
    for c in runs.columns:
        if c == "status":
            cols.append(F.when(stale, F.lit("error")).otherwise(F.col(c)).alias(c))
        elif c == "ended_at":
            cols.append(F.when(stale, as_of).otherwise(F.col(c)).alias(c))
        elif c == "duration_ms":
            cols.append(F.when(stale, duration_ms(F.col("started_at"), as_of)).otherwise(F.col(c)).alias(c))
        elif c == "error":
            cols.append(F.when(stale, F.lit(stale_message(older_than_seconds))).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return runs.select(*cols, stale.alias("reaped"))


def failed_runs(runs: DataFrame) -> DataFrame:
    """SORT5 / FLT5: error runs, newest first."""
    return runs.where(F.col("status") == "error").orderBy(F.desc("started_at"), F.desc("run_id"))


def latest_failed(runs: DataFrame) -> DataFrame:
    """AGG8: each source with a failed run, with its newest failed run; sources
    newest first. Aggregated (not windowed) so a hot source combines map-side."""
    order = F.struct(F.col("started_at"), F.col("run_id"))
    return runs.where(F.col("status") == "error").groupBy("source_id").agg(
        F.max_by("run_id", order).alias("run_id"),
        F.max("started_at").alias("started_at"),
        F.max_by("source_name", order).alias("source_name"))


def batch_outcome(requests: DataFrame, sources: DataFrame, configs_valid: DataFrame | None = None) -> DataFrame:
    """JOIN9 + AGG10: requested source names -> ``run`` when registered (and, if
    ``configs_valid`` is given, with a valid config), else ``failed`` with the reason."""
    known = sources.select(F.col("name").alias("source")).distinct().withColumn("_known", F.lit(True))
    j = requests.join(known, "source", "left")
    registered, valid = F.col("_known").isNotNull(), F.lit(True)
    if configs_valid is not None:
        good = configs_valid.select(F.col("name").alias("source")).distinct().withColumn("_valid", F.lit(True))
        j = j.join(good, "source", "left")
        valid = F.col("_valid").isNotNull()
    error = (F.when(~registered, F.concat(F.lit("not registered: "), F.col("source")))
             .when(~valid, F.concat(F.lit("config not valid: "), F.col("source"))))
    return j.select("source", F.when(registered & valid, "run").otherwise("failed").alias("outcome"), error.alias("error"))
