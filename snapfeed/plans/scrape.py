"""The scrape job as one plan: pages x configs -> items -> cap -> first-wins
-> diff against stored state -> next state + change feed + run summaries.

Many sources and many runs go through the same plan; a source whose run
failed (or that had a page that could not be processed) is not diffed, so a
failed fetch never removes items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedupe, diff, extract


def scrape_runs(pages: DataFrame, configs: DataFrame, runs: DataFrame, state: DataFrame | None,
                max_items: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``pages``: source_id, run_id, page_no, url, html; ``configs``: source_id,
    config; ``runs``: source_id, run_id, started_at, status. A source may have
    several runs in one call: they are diffed in start order in one pass.
    Returns (items, changes, next_state, summary); ``items`` are the kept
    (capped, deduped) items; ``max_items`` None keeps all."""
    raw = extract.extract_items(pages, configs)
    failed = raw.where(F.col("error").isNotNull()).select("source_id", "run_id").distinct()
    ok_runs = runs.where(F.col("status") == "ok").select("source_id", "run_id", "started_at") \
        .join(failed, ["source_id", "run_id"], "left_anti")
    keys = configs.select("source_id", F.col("config.item.dedupe_key").alias("_key"))
    items = raw.where(F.col("error").isNull()).join(keys, "source_id")
    capped = dedupe.cap(items, max_items)
    kept = dedupe.first_wins(capped, F.col("data")[F.col("_key")]).drop("_key")
    batch = kept.select("source_id", "run_id", "dedupe_key", "data")
    changes = diff.history(batch, ok_runs, state)
    nxt = diff.fold_state(state, batch, ok_runs)
    summary = diff.summarise(changes, ok_runs)
    return kept, changes, nxt, summary
