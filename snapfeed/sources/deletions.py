"""JOIN10 / UPS4: deleting sources with all that belongs to them.

A delete appends to a log; nothing is rewritten. Readers apply the log: rows of
runs, items and heals of a deleted source are left out, and a heal that outlives
its run (deleted with another source, or by itself) keeps its row with a null
``run_id``. ``fold`` writes a table without its deleted rows when they are worth
removing; entries of the log that every table has folded can then go.

A source that is created again under the same id is a new one: what is deleted
is what was there at the time of the entry, so rows younger than it stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "kind string, id string, deleted_at timestamp"


def append(spark: SparkSession, path: str, ids: DataFrame, kind: str, at) -> None:
    """Log the deletion of ``ids`` (id), ``kind`` source or run, as of ``at``."""
    at = at if isinstance(at, F.Column) else F.lit(at)
    (ids.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), at.cast("timestamp").alias("deleted_at"))
     .write.mode("append").parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)


def _gone(log: DataFrame, kind: str) -> DataFrame:
    return log.where(F.col("kind") == kind).groupBy(F.col("id").alias("_gone")).agg(F.max("deleted_at").alias("_at"))


def live(rows: DataFrame, log: DataFrame, kind: str = "source", key: str = "source_id", born: str | None = None) -> DataFrame:
    """``rows`` without those of a deleted ``kind``; with ``born`` (a timestamp
    column) rows younger than the deletion stay. Rows without a key stay."""
    hit = F.col(key).cast("string") == F.col("_gone")
    if born:
        hit = hit & (F.col(born) <= F.col("_at"))
    return rows.join(_gone(log, kind), hit, "left_anti")


def live_tables(sources: DataFrame, runs: DataFrame, items: DataFrame, heals: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """The four tables as readers see them: sources (id, created_at), runs
    (run_id, source_id, started_at), items (source_id, first_seen_at), heals
    (source_id, run_id, created_at)."""
    kept_runs = live(live(runs, log, born="started_at"), log, "run", "run_id")
    lost = runs.select("run_id").join(kept_runs.select("run_id"), "run_id", "left_anti").select(F.col("run_id").alias("_lost")).distinct()
    kept_heals = live(heals, log, born="created_at").join(lost, F.col("run_id") == F.col("_lost"), "left")
    kept_heals = kept_heals.withColumn("run_id", F.when(F.col("_lost").isNull(), F.col("run_id"))).drop("_lost")
    return {"sources": live(sources, log, key="id", born="created_at"), "runs": kept_runs,
            "items": live(items, log, born="first_seen_at"), "heals": kept_heals}


def fold(rows: DataFrame, log: DataFrame, path: str, **how) -> DataFrame:
    """Write ``rows`` without the deleted ones to ``path`` and read them back."""
    live(rows, log, **how).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
