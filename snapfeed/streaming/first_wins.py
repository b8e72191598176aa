"""STR3: first-wins dedupe on a stream within a watermark, by arrival
(``first_wins_stream``) or by place in the run (``first_wins_ordered``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pystrip


def first_wins_stream(stream: DataFrame, key_col: str = "dedupe_key", by=("source_id", "run_id"),
                      event_time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Keep the first arriving row per (run, stripped key); blank keys dropped.
    State for a key is dropped once the watermark passes its event time + delay."""
    s = stream.withColumn("_ks", pystrip(F.col(key_col))).where(F.col("_ks").isNotNull() & (F.col("_ks") != ""))
    return s.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([*by, "_ks"]).drop("_ks")


def first_wins_ordered(stream: DataFrame, key_col: str = "dedupe_key", by=("source_id", "run_id"), order=("page_no", "item_idx"),
                       run_time: str = "started_at", delay: str = "1 hour") -> DataFrame:
    """The row of each (run, stripped key) that comes first in the run's own
    order, however its rows arrive: keyed state holds the least place so far and
    goes out once the watermark is ``delay`` past the run's start (one value for
    all rows of a run), when it is dropped. An aggregate in the JVM state store,
    combined before the shuffle; blank keys are dropped. Equal places are decided
    by the stripped key's own text."""
    s = stream.withColumn("_ks", pystrip(F.col(key_col))).where(F.col("_ks").isNotNull() & (F.col("_ks") != ""))
    rest = [c for c in stream.columns if c not in (*by, run_time)]
    place = F.struct(*order, key_col)
    out = (s.withWatermark(run_time, delay).groupBy(*by, run_time, "_ks")
           .agg(F.min_by(F.struct(*rest), place).alias("_first")))
    return out.select(*[F.col(c) if c in (*by, run_time) else F.col(f"_first.{c}").alias(c) for c in stream.columns])
