import datetime as dt

from pyspark.sql import functions as F

from snapfeed.plans.scrape import scrape_runs
from tests.helpers import config_row, configs

FIELDS = [("id", "::attr(data-id)", "css", None), ("t", "h2::text", "css", None)]


def page(ids, title="x"):
    return "".join(f'<div class="c" data-id="{i}"><h2>{title}{i}</h2></div>' for i in ids)


def test_scrape_runs_history_and_failure_isolation(spark):
    pages = spark.createDataFrame([
        ("a", "r1", 1, "https://a/", page([1, 2, 3])),
        ("a", "r2", 1, "https://a/", page([1, 2], title="y")),
        ("a", "r3", 1, "https://a/", page([1, 2, 1, 4])),
        ("b", "r1", 1, "https://b/", page([9])),
    ], "source_id string, run_id string, page_no int, url string, html string")
    cfg = configs(spark, [config_row("a", "div.c", FIELDS, "id"), config_row("b", "div.c[", FIELDS, "id")])
    runs = spark.createDataFrame([
        ("a", "r1", dt.datetime(2024, 1, 1), "ok"), ("a", "r2", dt.datetime(2024, 1, 2), "ok"),
        ("a", "r3", dt.datetime(2024, 1, 3), "ok"), ("b", "r1", dt.datetime(2024, 1, 1), "ok")],
        "source_id string, run_id string, started_at timestamp, status string")
    kept, changes, nxt, summary = scrape_runs(pages, cfg, runs, None, max_items=3)
    s = {(r.source_id, r.run_id): (r.item_count, r.items_new, r.items_updated, r.items_removed)
         for r in summary.collect()}
    # r3 is capped at 3 items (1, 2, 1) before dedupe -> keys 1, 2; b's config is broken: not diffed
    assert s == {("a", "r1"): (3, 3, 0, 0), ("a", "r2"): (2, 0, 2, 1), ("a", "r3"): (2, 0, 2, 0)}
    state = {r.dedupe_key: r for r in nxt.collect()}
    assert state["3"].removed and not state["1"].removed and state["1"].data["t"] == "x1"
    assert kept.where(F.col("source_id") == "b").count() == 0
