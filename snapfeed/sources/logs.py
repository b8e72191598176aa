"""SNK2 / SNK3: append-only run-event and heal logs.

Run rows are never updated in place: every transition is an event appended
here and ``operators.runs.current`` derives the current row. Heal rows are
appended as produced by ``operators.repair.apply``. Appends are partitioned by
day so readers prune by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_run_events(events: DataFrame, path: str) -> None:
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def append_heals(heals: DataFrame, path: str) -> None:
    h = heals if "created_at" in heals.columns else heals.withColumn("created_at", F.current_timestamp())
    h.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)
