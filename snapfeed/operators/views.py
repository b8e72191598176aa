"""Read queries: source stats, pages of runs/items/heals, run windows
(AGG1, AGG2, WIN1, WIN4, JOIN2-7, SORT1-5, PRJ1-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.items import VIEW_EXCLUDE, content_text, pick_url
from ..functions.urls import resolve_url
from . import ordering
from .ordering import numbered


def live_counts(items: DataFrame) -> DataFrame:
    """AGG1: non-removed items per source (partial + final aggregate)."""
    return items.where(~F.col("removed")).groupBy("source_id").agg(F.count(F.lit(1)).alias("item_count"))


def live_count(items: DataFrame, source_id) -> DataFrame:
    """AGG2: one source's live item count."""
    return items.where((F.col("source_id") == F.lit(source_id)) & ~F.col("removed")) \
        .agg(F.count(F.lit(1)).alias("item_count"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """WIN1 as an aggregate: newest run per source by (started_at, run_id).
    ``max_by`` combines map-side, so one source with most runs stays cheap."""
    order = F.struct(F.col("started_at"), F.col("run_id"))
    return runs.groupBy("source_id").agg(
        F.max("started_at").alias("last_run_at"),
        F.max_by("status", order).alias("last_status"),
        F.max_by("run_id", order).alias("last_run_id"))


def source_stats(sources: DataFrame, items: DataFrame, runs: DataFrame, origin: str | None = None) -> DataFrame:
    """JOIN6 + JOIN7 + AGG1 + WIN1 + SORT4: every source with its live item
    count (0 when none) and latest run (null when none), by name."""
    src = sources if origin is None else sources.where(F.col("origin") == origin)
    ids = src.select(F.col("id").alias("source_id"))
    counts = live_counts(items.join(ids, "source_id", "left_semi"))
    latest = latest_runs(runs.join(ids, "source_id", "left_semi"))
    return src.join(counts, src["id"] == counts["source_id"], "left").drop(counts["source_id"]) \
        .join(latest, src["id"] == latest["source_id"], "left").drop(latest["source_id"]) \
        .select("id", "name", "origin", F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count"),
                "last_run_at", "last_status") \
        .orderBy("name")


def page(df: DataFrame, order_cols, limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY ... OFFSET m LIMIT n (offset before limit; plans as TakeOrderedAndProject)."""
    out = df.orderBy(*order_cols)
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def runs_page(runs: DataFrame, source_name: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """SORT1 + FLT4."""
    r = runs if source_name is None else runs.where(F.col("source_name") == source_name)
    return page(r, [F.desc("started_at"), F.desc("run_id")], limit, offset)


def item_view(items: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """PRJ2 + JOIN3 + FN5 + FN7 + FN8: stored items as view rows with links
    resolved against the source's configured URL."""
    it = items
    if sources is not None:
        base = sources.select(F.col("id").alias("source_id"),
                                                F.col("base_url").alias("_base"))
        it = it.join(base, "source_id", "left")
    else:
        it = it.withColumn("_base", F.lit(None).cast("string"))
    d = F.col("data")
    snap = d["html_snapshot_url"]
    return it.select(
        "source_id", F.col("dedupe_key").alias("stable_id"),
        resolve_url(pick_url(d), F.col("_base")).alias("url"),
        F.coalesce(F.nullif(d["title"], F.lit("")), F.lit("")).alias("title"),
        content_text(d, VIEW_EXCLUDE).alias("content_text"),
        "content_hash", "first_seen_at", "last_seen_at",
        F.when(snap.isNotNull(), resolve_url(snap, F.col("_base"))).alias("html_snapshot_url"),
        "removed")


def items_page(items: DataFrame, source_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """SORT2 + FLT3: live items newest first."""
    it = items.where(~F.col("removed"))
    if source_id is not None:
        it = it.where(F.col("source_id") == F.lit(source_id))
    return page(it, [F.desc("last_seen_at"), F.asc("dedupe_key")], limit, offset)


def run_items(items: DataFrame, runs: DataFrame, as_of, bin_seconds: int = 86400) -> DataFrame:
    """JOIN4: live items whose last_seen_at lies in [started_at, coalesce(ended_at, as_of)]
    of a run of the same source (closed on both ends).

    Equi-join on (source_id, time bin) plus the range predicate: each run is
    exploded over the bins its window touches, so a source with many items
    and many runs is split by time instead of pairing every item with every run."""
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, F.Column) else as_of
    r = runs.select("run_id", "source_id", "started_at",
                    F.coalesce(F.col("ended_at"), as_of).alias("_upper"))
    lo = F.floor(F.unix_seconds(F.col("started_at")) / bin_seconds)
    hi = F.floor(F.unix_seconds(F.col("_upper")) / bin_seconds)
    r = r.where(F.col("_upper") >= F.col("started_at")) \
        .withColumn("_bin", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    it = items.where(~F.col("removed")).withColumn(
        "_bin", F.floor(F.unix_seconds(F.col("last_seen_at")) / bin_seconds).cast("long"))
    j = it.join(r, ["source_id", "_bin"]).where(
        (F.col("last_seen_at") >= F.col("started_at")) & (F.col("last_seen_at") <= F.col("_upper")))
    return j.drop("_bin", "_upper")


def items_of_runs(items: DataFrame, runs: DataFrame, as_of, limit: int = 50, offset: int = 0) -> DataFrame:
    """JOIN4 + SORT2: the live items of the given run (a table of one row), newest first."""
    return page(run_items(items, runs, as_of), [F.desc("last_seen_at"), F.asc("dedupe_key")], limit, offset)


def _run_ends(items: DataFrame, runs: DataFrame, as_of, bin_seconds: int) -> DataFrame:
    """(run_id, source_id, before, upto): numbers of the live items of the run's
    source last seen before the run's start and up to its end.

    Items and the runs' two ends lie on one time line per source. Time lines are
    cut into bins: the items before a bin are a prefix sum over bins, those inside
    it a window within the bin, so no task holds a whole source."""
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, F.Column) else as_of
    upper = F.coalesce(F.col("ended_at"), as_of)
    ends = runs.select("run_id", "source_id", F.explode(F.array(
        F.struct(F.col("started_at").alias("at"), F.lit(0).alias("kind")), F.struct(upper.alias("at"), F.lit(2).alias("kind")))).alias("e"))
    line = ends.select("source_id", "run_id", "e.at", "e.kind", F.lit(0).alias("n")).unionByName(
        items.where(~F.col("removed")).select("source_id", F.lit(None).cast(runs.schema["run_id"].dataType).alias("run_id"),
                                              F.col("last_seen_at").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("n")))
    line = line.withColumn("bin", F.floor(F.unix_seconds("at") / bin_seconds).cast("long"))
    earlier = Window.partitionBy("source_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = line.groupBy("source_id", "bin").agg(F.sum("n").alias("in_bin")) \
        .select("source_id", "bin", F.coalesce(F.sum("in_bin").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("source_id", "bin").orderBy("at", "kind").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = line.withColumn("so_far", F.sum("n").over(inside)).where("kind != 1").join(bins, ["source_id", "bin"])
    total = F.col("earlier") + F.col("so_far")
    return count.groupBy("run_id", "source_id").agg(F.max(F.when(F.col("kind") == 0, total)).alias("before"),
                                                    F.max(F.when(F.col("kind") == 2, total)).alias("upto"))


def run_item_counts(items: DataFrame, runs: DataFrame, as_of, bin_seconds: int = 60) -> DataFrame:
    """JOIN4 counted: (run_id, source_id, n_items), the live items of the run's
    source last seen inside its closed window, without pairing items and runs."""
    ends = _run_ends(items, runs, as_of, bin_seconds)
    return ends.select("run_id", "source_id", F.greatest(F.lit(0), F.col("upto") - F.col("before")).cast("long").alias("n_items"))


def run_first_pages(items: DataFrame, runs: DataFrame, as_of, limit: int = 50, offset: int = 0, bin_seconds: int = 60) -> DataFrame:
    """JOIN4 + SORT2 for all runs at once: of every run the page of its live
    items newest first (run_id, source_id, rank from 1 of the page's first row,
    dedupe_key, last_seen_at).

    A run's window is a stretch of its source's items in time order, so with the
    items numbered along that order its page is a few consecutive numbers: an
    equality join on (source, number). Items and runs are never paired; output and
    work grow with items, runs and pages."""
    ends = _run_ends(items, runs, as_of, bin_seconds)
    first = F.col("upto") - offset
    last = F.greatest(F.col("before") + 1, first - (limit - 1))
    wanted = (ends.where(first >= last).withColumn("_n", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(-1).cast("long"))))
              .select("run_id", "source_id", "_n", (F.col("upto") - F.col("_n") + 1).cast("long").alias("rank")))
    placed = numbered(items.where(~F.col("removed")).select("source_id", "dedupe_key", "last_seen_at"), ["source_id"],
                      [F.asc("last_seen_at"), F.desc("dedupe_key")], "_n")
    return wanted.join(placed, ["source_id", "_n"]).select("run_id", "source_id", "rank", "dedupe_key", "last_seen_at")


def deep_page(df: DataFrame, order_cols, limit: int, offset: int) -> DataFrame:
    """SORT1-SORT3 far down the order: only the ranges that hold the page are
    sorted, and nothing before it is merged on the driver. ``df`` should be
    narrow (what is shown besides can be joined to the page's rows)."""
    return ordering.page(df, list(order_cols), offset, limit)


def heals_page(heals: DataFrame, sources: DataFrame, source_name: str | None = None,
               limit: int = 20, offset: int = 0) -> DataFrame:
    """JOIN2 + SORT3: heals with their source's name, newest first."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    h = heals.join(names, "source_id")
    if source_name is not None:
        h = h.where(F.col("source_name") == source_name)
    return page(h, [F.desc("created_at"), F.desc("id")], limit, offset)


def heal_view(heals: DataFrame) -> DataFrame:
    """PRJ3: heal rows with old/new selector as a two-key map."""
    return heals.select("*", F.create_map(F.lit("old"), F.col("old_selector"),
                                          F.lit("new"), F.col("new_selector")).alias("selectors"))


def source_summary(sources: DataFrame) -> DataFrame:
    """PRJ4: list view (no config text; column pruning keeps it out of the scan)."""
    return sources.select("id", "name", "description", "origin", "config_sha", "created_at", "updated_at")


def source_detail(sources: DataFrame, name: str | None = None) -> DataFrame:
    """PRJ4: detail view with the config text."""
    s = sources if name is None else sources.where(F.col("name") == name)
    return s.select("id", "name", "description", "origin", "config_sha", "config_yaml", "created_at", "updated_at")


def latest_run(runs: DataFrame, source_id) -> DataFrame:
    """WIN4: newest run of one source (ORDER BY started_at DESC, run_id DESC LIMIT 1)."""
    return page(runs.where(F.col("source_id") == F.lit(source_id)), [F.desc("started_at"), F.desc("run_id")], 1)
