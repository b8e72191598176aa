"""Per-run cap, first-wins dedupe and key reports (WIN2, WIN3, FLT2, AGG4, AGG5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window  # noqa: F401
from pyspark.sql import functions as F

from ..functions.text import pystrip

RUN_KEYS = ("source_id", "run_id")
DOC_ORDER = ("page_no", "item_idx")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def key_value(key) -> Column:
    """The dedupe-key value of an item: ``data[key]`` for a field name, or a
    column (e.g. ``data[config.item.dedupe_key]`` for many sources at once)."""
    if isinstance(key, str):
        return F.col("data")[key]
    return key


def cap(items: DataFrame, n=None, by=RUN_KEYS, order=DOC_ORDER) -> DataFrame:
    """WIN3: the first ``n`` items of each run in document order; None keeps all.

    An item at position >= n on its page can never be among the first n of its
    run, so that filter runs map-side before the shuffle; the window then sees
    at most n rows per page of a run."""
    if n is None:
        return items
    n = F.lit(n) if isinstance(n, int) else _c(n)
    pre = items.where(F.col(order[-1]) < n)
    w = Window.partitionBy(*by).orderBy(*[F.col(o) for o in order])
    return pre.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def first_wins(items: DataFrame, key, by=RUN_KEYS, order=DOC_ORDER) -> DataFrame:
    """FLT2 + WIN2: drop null/blank keys, keep the earliest item per stripped key.

    Adds ``dedupe_key`` = the first item's key as extracted (unstripped), which
    is what state rows are keyed on. Written as a ``min_by`` aggregate on
    document order rather than a window: repeats of a key collapse map-side
    (partial aggregation) before the shuffle, so even a key repeated across a
    third of all rows never lands whole in one task."""
    kv = key_value(key)
    keyed = items.withColumn("_kv", kv).withColumn("_ks", pystrip(F.col("_kv"))) \
        .where(F.col("_ks").isNotNull() & (F.col("_ks") != ""))
    cols = [c for c in keyed.columns if c != "_ks"]
    first = keyed.groupBy(*by, "_ks").agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(*[F.col(o) for o in order])).alias("_first"))
    return first.select("_first.*").withColumn("dedupe_key", F.col("_kv")).drop("_kv")


def duplicate_keys(items: DataFrame, key, by=RUN_KEYS) -> DataFrame:
    """AGG4: keys occurring more than once in a run (exact, unstripped)."""
    return items.withColumn("dedupe_key", key_value(key)).where(F.col("dedupe_key").isNotNull()) \
        .groupBy(*by, "dedupe_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_keys(items: DataFrame, key_name) -> DataFrame:
    """AGG5: items whose map has no entry for the key field at all."""
    kn = F.lit(key_name) if isinstance(key_name, str) else key_name
    return items.where(~F.map_contains_key(F.col("data"), kn) | F.col("data").isNull())


def key_faults(items: DataFrame, key, by=RUN_KEYS) -> DataFrame:
    """Every fault of a batch's keys: one row per missing key (n null) and one
    per repeated key with its count."""
    name = key if isinstance(key, str) else None
    repeated = duplicate_keys(items, key, by).select(*by, "dedupe_key", "n", F.lit("repeated").alias("fault"))
    if name is None:
        return repeated
    missing = missing_keys(items, name).select(*by, F.lit(None).cast("string").alias("dedupe_key"),
                                               F.lit(None).cast("long").alias("n"), F.lit("missing").alias("fault"))
    return repeated.unionByName(missing)


def strict(items: DataFrame, key, by=RUN_KEYS) -> DataFrame:
    """Raise when a batch holds a missing or repeated key (``key_faults`` lists
    them all); returns the batch unchanged otherwise."""
    fault = key_faults(items, key, by).orderBy("fault", "dedupe_key").limit(1).collect()
    if fault:
        raise ValueError(f"{fault[0]['fault']} key in batch (see key_faults): {fault[0]['dedupe_key']!r}")
    return items
