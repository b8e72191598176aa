import datetime as dt

from pyspark.sql import functions as F

from snapfeed.operators import config_checks as C
from snapfeed.operators import repair as RP
from snapfeed.operators import views as V
from snapfeed.sources import logs


def test_request_bounds(spark):
    rows = [("a", f"s{i}", 10) for i in range(3)] + [("b", "s1", 10), ("b", "s1", 10)] + \
           [("c", f"s{i}", 5) for i in range(11)] + [("d", "s1", 0), ("e", "s1", 101)]
    df = spark.createDataFrame(rows, "request_id string, source string, max_items int")
    got = {r.request_id: (r.count_ok, r.unique_ok, r.max_items_ok) for r in C.request_violations(df).collect()}
    assert got == {"a": (True, True, True), "b": (True, False, True), "c": (False, True, True),
                   "d": (True, True, False), "e": (True, True, False)}


def test_repair_inputs_have_the_whole_page(spark):
    t = spark.createDataFrame([("s", "title", "h1::text", "css")],
                              "source_id string, target string, old_selector string, selector_type string")
    pages = spark.createDataFrame([("s", "x" * 25000)], "source_id string, html string")
    r = RP.repair_inputs(t, pages).first()
    assert len(r.page_html) == 25000 and r.old_selector == "h1::text"


def test_summary_detail_latest(spark):
    s = spark.createDataFrame([("1", "a", "", "file", "sha", "name: a", None, None)],
                              "id string, name string, description string, origin string, config_sha string, "
                              "config_yaml string, created_at timestamp, updated_at timestamp")
    assert "config_yaml" not in V.source_summary(s).columns
    assert V.source_detail(s, "a").first().config_yaml == "name: a"
    runs = spark.createDataFrame([("r1", "a", dt.datetime(2024, 1, 1)), ("r2", "a", dt.datetime(2024, 1, 2)),
                                  ("r3", "b", dt.datetime(2024, 1, 3))],
                                 "run_id string, source_id string, started_at timestamp")
    assert [r.run_id for r in V.latest_run(runs, "a").collect()] == ["r2"]


def test_log_appends(spark, scratch):
    ev = spark.createDataFrame([("r1", "queued", dt.datetime(2024, 1, 1, 10))], "run_id string, kind string, ts timestamp")
    logs.append_run_events(ev, f"{scratch}/events")
    logs.append_run_events(ev.withColumn("kind", F.lit("running")), f"{scratch}/events")
    back = spark.read.parquet(f"{scratch}/events")
    assert back.count() == 2 and "day" in back.columns
    heals = spark.createDataFrame([("s", "title", True)], "source_id string, field_name string, applied boolean")
    logs.append_heals(heals, f"{scratch}/heals")
    assert spark.read.parquet(f"{scratch}/heals").count() == 1


def test_failed_proposal_request_writes_heal_row(spark):
    src = spark.createDataFrame([("s1", "s1", "api", None)],
                                "id string, name string, origin string, config struct<item:struct<container:string,"
                                "fields:array<struct<name:string,selector:string>>>>") \
        .withColumn("description", F.lit("")).withColumn("config_yaml", F.lit("y")) \
        .withColumn("config_sha", F.lit("x")).withColumn("created_at", F.current_timestamp()) \
        .withColumn("updated_at", F.current_timestamp()).withColumn("base_url", F.lit("https://x/"))
    scored = spark.createDataFrame([], "source_id string, run_id long, target string, old_selector string, "
                                       "selector string, selector_type string, confidence double, reasoning string, "
                                       "sample_values array<string>, valid boolean")
    errs = spark.createDataFrame([("s1", None, "title", "h2::text", "css", "timeout")],
                                 "source_id string, run_id long, target string, old_selector string, "
                                 "selector_type string, error string")
    _, heals, _ = RP.apply(scored, src, proposer_errors=errs)
    h = heals.first()
    assert (h.new_selector, h.confidence, h.applied, h.reasoning) == ("", 0.0, False, "no proposal: timeout")


def test_size_shuffles(spark):
    from snapfeed.session import size_shuffles
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.files.maxPartitionBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    try:
        n = size_shuffles(spark, 100 << 40)  # 100 TiB of input
        assert n == 200_000 and spark.conf.get("spark.sql.shuffle.partitions") == "200000"
        assert size_shuffles(spark, 1 << 20) == spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == str(256 << 20)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
