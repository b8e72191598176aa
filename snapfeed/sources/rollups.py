"""AGG1 / AGG3 / AGG6 kept up to date from the change feed.

    <base>/delta/batch_id=<n>     what batch n adds: one row per source it touched
    <base>/snapshot/upto=<n>      the sums of all batches up to n

A batch's delta is written over itself, so a replay changes nothing; reading adds
the deltas after the newest snapshot to it, and ``fold`` moves the snapshot on.
Costs follow the batches' sources, not the items: the full aggregate is needed
only for ``audit``.

Per source: live items (new and reappeared less removed), items seen, updated
and removed in total, runs, and the latest run with its status. Batches may
carry any runs in any order; an error run counts and may be the latest one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import _fs, _names

ROLLUP = ("source_id string, live long, n_new long, n_updated long, n_removed long, runs long, "
          "last struct<started_at: timestamp, run_id: string, status: string>")
_COUNTS = ("live", "n_new", "n_updated", "n_removed", "runs")


def delta(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per source of ``runs`` (source_id, run_id, started_at, status) and
    their ``changes`` (source_id, change)."""
    come, gone = F.count_if(F.col("change").isin("new", "reappeared")), F.count_if(F.col("change") == "removed")
    items = changes.groupBy(F.col("source_id").alias("_s")).agg(
        (come - gone).alias("live"), come.alias("n_new"), F.count_if(F.col("change") == "updated").alias("n_updated"), gone.alias("n_removed"))
    per = runs.groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.max(F.struct("started_at", "run_id", "status")).alias("last"))
    out = per.join(items, F.col("source_id") == F.col("_s"), "left")
    return out.select("source_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS], "last")


def apply(changes: DataFrame, runs: DataFrame, base: str, batch_id: int) -> None:
    """Write batch ``batch_id``'s delta, unless a snapshot already has it."""
    if batch_id > snapshot_upto(changes.sparkSession, base):
        delta(changes, runs).write.mode("overwrite").parquet(f"{base.rstrip('/')}/delta/batch_id={batch_id}")


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    out = []
    for name in _names(spark, path):
        number = name.removeprefix(prefix)
        if name.startswith(prefix) and number.isdigit() and "_SUCCESS" in _names(spark, f"{path}/{name}"):
            out.append(int(number))
    return sorted(out)


def snapshot_upto(spark: SparkSession, base: str) -> int:
    return max(_numbers(spark, f"{base.rstrip('/')}/snapshot", "upto="), default=-1)


def read(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """The sums of all batches (or of those up to ``upto``)."""
    base, start = base.rstrip("/"), snapshot_upto(spark, base)
    if upto is not None and upto < start:
        raise ValueError(f"batches up to {start} are folded")
    paths = [f"{base}/delta/batch_id={n}" for n in _numbers(spark, f"{base}/delta", "batch_id=") if n > start and (upto is None or n <= upto)]
    paths += [f"{base}/snapshot/upto={start}"] if start >= 0 else []
    if not paths:
        return spark.createDataFrame([], ROLLUP)
    rows = spark.read.schema(ROLLUP).parquet(*paths)
    return rows.groupBy("source_id").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.max("last").alias("last"))


def fold(spark: SparkSession, base: str) -> int:
    """Move the snapshot to the newest batch and drop what it has replaced."""
    base = base.rstrip("/")
    start, known = snapshot_upto(spark, base), _numbers(spark, f"{base}/delta", "batch_id=")
    upto = max(known, default=-1)
    if upto <= start:
        return start
    read(spark, base, upto).write.mode("overwrite").parquet(f"{base}/snapshot/upto={upto}")
    old = [f"{base}/delta/batch_id={n}" for n in known if n <= upto] + ([f"{base}/snapshot/upto={start}"] if start >= 0 else [])
    for path in old:
        fs, p, _ = _fs(spark, path)
        fs.delete(p, True)
    return upto


def audit(rollup: DataFrame, items: DataFrame) -> DataFrame:
    """Sources whose live count differs from that of the stored ``items``
    (source_id, removed): source_id, live, stored."""
    stored = items.groupBy(F.col("source_id").alias("_s")).agg(F.count_if(~F.col("removed")).alias("stored"))
    both = rollup.select("source_id", "live").join(stored, F.col("source_id") == F.col("_s"), "full")
    return (both.select(F.coalesce("source_id", "_s").alias("source_id"), F.coalesce("live", F.lit(0)).alias("live"),
                        F.coalesce("stored", F.lit(0)).alias("stored")).where("live != stored"))
