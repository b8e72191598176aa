from pyspark.sql import functions as F

from snapfeed.operators import runs as R
from snapfeed.operators import views as V

RUN_SCHEMA = ("run_id string, source_id string, source_name string, status string, started_at timestamp, "
              "ended_at timestamp, duration_ms long, item_count long, error string")


def ts(s):
    import datetime as dt
    return dt.datetime.fromisoformat(s)


def test_reap_only_stale_running(spark):
    runs = spark.createDataFrame([
        ("old", "s", "a", "running", ts("2024-01-01 10:00:00"), None, None, None, None),
        ("new", "s", "a", "running", ts("2024-01-01 10:59:00"), None, None, None, None),
        ("done", "s", "a", "ok", ts("2024-01-01 09:00:00"), ts("2024-01-01 09:00:01"), 1000, 3, None),
    ], RUN_SCHEMA)
    out = {r.run_id: r for r in R.reap(runs, "2024-01-01 11:00:00", 1800).collect()}
    assert out["old"].status == "error" and out["old"].reaped
    assert out["old"].error == "no end within 1800 s, taken as failed"
    assert out["old"].duration_ms == 3600 * 1000
    assert out["new"].status == "running" and not out["new"].reaped
    assert out["done"].status == "ok"


def test_failed_and_latest_failed(spark):
    runs = spark.createDataFrame([
        ("1", "a", "a", "ok", ts("2024-01-01 00:00:00"), None, None, None, None),
        ("2", "a", "a", "error", ts("2024-01-02 00:00:00"), None, None, None, "x"),
        ("3", "b", "b", "error", ts("2024-01-03 00:00:00"), None, None, None, "y"),
        ("4", "a", "a", "error", ts("2024-01-04 00:00:00"), None, None, None, "z"),
    ], RUN_SCHEMA)
    assert [r.run_id for r in R.failed_runs(runs).collect()] == ["4", "3", "2"]
    lf = {r.source_id: r.run_id for r in R.latest_failed(runs).collect()}
    assert lf == {"a": "4", "b": "3"}
    page = V.runs_page(runs, source_name="a", limit=2).collect()
    assert [r.run_id for r in page] == ["4", "2"]
    assert len(V.runs_page(runs, limit=10).collect()) == 4


def test_run_state_from_events(spark):
    ev = spark.createDataFrame([
        ("r1", "s", "a", "queued", ts("2024-01-01 00:00:00"), 0, None, None, None, None, None),
        ("r1", "s", "a", "running", ts("2024-01-01 00:00:05"), 1, None, None, None, None, None),
        ("r1", "s", "a", "ok", ts("2024-01-01 00:00:07.5"), 2, 4, 3, 1, 0, None),
        ("r2", "s", "a", "queued", ts("2024-01-01 00:00:00"), 0, None, None, None, None, None),
        ("r2", "s", "a", "running", ts("2024-01-01 00:00:01"), 1, None, None, None, None, None),
        ("r2", "s", "a", "error", ts("2024-01-01 00:00:02"), 2, None, None, None, None, "boom"),
        ("r3", "s", "a", "queued", ts("2024-01-01 00:00:00"), 0, None, None, None, None, None),
        ("zz", "s", "a", "running", ts("2024-01-01 00:00:00"), 0, None, None, None, None, None),
    ], "run_id string, source_id string, source_name string, kind string, ts timestamp, seq int, "
       "item_count long, items_new long, items_updated long, items_removed long, error string")
    cur = {r.run_id: r for r in R.current(ev).collect()}
    assert cur["r1"].status == "ok" and cur["r1"].duration_ms == 2500 and cur["r1"].items_new == 3
    assert cur["r1"].error is None and cur["r1"].item_count == 4
    assert cur["r2"].status == "error" and cur["r2"].item_count == 0 and cur["r2"].error == "boom"
    assert cur["r3"].status == "queued" and cur["r3"].ended_at is None
    assert [r.run_id for r in R.unknown_run_events(ev).collect()] == ["zz"]


def test_source_stats_and_item_pages(spark):
    sources = spark.createDataFrame([("a", "alpha", "file"), ("b", "beta", "api"), ("c", "gamma", "api")],
                                    "id string, name string, origin string")
    items = spark.createDataFrame(
        [("a", str(i), i == 4, ts(f"2024-01-0{i + 1} 00:00:00")) for i in range(5)],
        "source_id string, dedupe_key string, removed boolean, last_seen_at timestamp")
    runs = spark.createDataFrame([
        ("1", "a", "alpha", "ok", ts("2024-01-01 00:00:00"), None, None, None, None),
        ("2", "a", "alpha", "error", ts("2024-01-02 00:00:00"), None, None, None, None),
    ], RUN_SCHEMA)
    st = {r.name: r for r in V.source_stats(sources, items, runs).collect()}
    assert (st["alpha"].item_count, st["alpha"].last_status) == (4, "error")
    assert (st["beta"].item_count, st["beta"].last_run_at, st["beta"].last_status) == (0, None, None)
    assert [r.name for r in V.source_stats(sources, items, runs, origin="api").collect()] == ["beta", "gamma"]
    p1 = [r.dedupe_key for r in V.items_page(items, "a", limit=2, offset=0).collect()]
    p2 = [r.dedupe_key for r in V.items_page(items, "a", limit=2, offset=2).collect()]
    assert p1 == ["3", "2"] and p2 == ["1", "0"]
    assert V.live_count(items, "a").first().item_count == 4


def test_run_item_window_closed_and_open(spark):
    items = spark.createDataFrame([
        ("s", "in", False, ts("2024-01-01 10:00:00")), ("s", "edge", False, ts("2024-01-01 11:00:00")),
        ("s", "out", False, ts("2024-01-01 12:00:01")), ("s", "gone", True, ts("2024-01-01 10:30:00")),
        ("s", "late", False, ts("2024-01-03 00:00:00"))],
        "source_id string, dedupe_key string, removed boolean, last_seen_at timestamp")
    runs = spark.createDataFrame([
        ("r1", "s", "s", "ok", ts("2024-01-01 10:00:00"), ts("2024-01-01 11:00:00"), 0, 0, None),
        ("r2", "s", "s", "running", ts("2024-01-02 00:00:00"), None, None, None, None)], RUN_SCHEMA)
    got = sorted((r.run_id, r.dedupe_key) for r in V.run_items(items, runs, "2024-01-05 00:00:00").collect())
    assert got == [("r1", "edge"), ("r1", "in"), ("r2", "late")]


def test_item_view_urls(spark):
    items = spark.createDataFrame([
        ("s", "1", {"url": "/abs/1", "title": "T"}), ("s", "2", {"url": "https://o.com/x"}),
        ("s", "3", {"link": "/l/3"}), ("s", "4", {"title": "no url"})],
        "source_id string, dedupe_key string, data map<string,string>") \
        .withColumn("content_hash", F.lit("h")).withColumn("first_seen_at", F.current_timestamp()) \
        .withColumn("last_seen_at", F.current_timestamp()).withColumn("removed", F.lit(False))
    sources = spark.createDataFrame([("s", "https://ex.com/feed/")], "id string, base_url string")
    got = {r.stable_id: r.url for r in V.item_view(items, sources).collect()}
    assert got == {"1": "https://ex.com/abs/1", "2": "https://o.com/x", "3": "https://ex.com/l/3", "4": ""}


def test_batch_outcome(spark):
    req = spark.createDataFrame([("a",), ("ghost",)], "source string")
    src = spark.createDataFrame([("a",)], "name string")
    got = {r.source: (r.outcome, r.error) for r in R.batch_outcome(req, src).collect()}
    assert got == {"a": ("run", None), "ghost": ("failed", "not registered: ghost")}


def test_heals_by_source_with_names(spark):
    heals = spark.createDataFrame([
        ("h1", "a", "title", "x", "y", ts("2024-01-01 00:00:00")),
        ("h2", "b", "title", "x", "z", ts("2024-01-02 00:00:00")),
        ("h3", "a", "container", "p", "q", ts("2024-01-03 00:00:00"))],
        "id string, source_id string, field_name string, old_selector string, new_selector string, created_at timestamp")
    sources = spark.createDataFrame([("a", "alpha"), ("b", "beta")], "id string, name string")
    only_a = V.heals_page(heals, sources, source_name="alpha").collect()
    assert [(r.id, r.source_name) for r in only_a] == [("h3", "alpha"), ("h1", "alpha")]
    assert [r.id for r in V.heals_page(heals, sources, limit=2, offset=1).collect()] == ["h2", "h1"]
    view = {r.id: r.selectors for r in V.heal_view(heals).collect()}
    assert view["h2"] == {"old": "x", "new": "z"}
