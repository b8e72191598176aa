import datetime as dt

from pyspark.sql import functions as F

from snapfeed.operators import diff
from snapfeed.sources.state import manifest_versions, read_sources
from snapfeed.streaming import change_feed, first_wins_stream, run_timeouts, run_timeouts_stateful
from snapfeed.streaming.change_feed import ITEM_STREAM_SCHEMA, apply_batch
from snapfeed.streaming.run_timeouts import RUN_EVENT_SCHEMA


def t(s):
    return dt.datetime.fromisoformat(s)


def snapshot_rows():
    rows = []
    runs = [("r1", "2024-01-01", {"1": "a", "2": "b"}), ("r2", "2024-01-02", {"1": "a2"}),
            ("r3", "2024-01-03", {}), ("r4", "2024-01-04", {"2": "b"})]
    for run, day, items in runs:
        rows.append(("s", run, t(day), "ok", None, None, len(items)))
        rows += [("s", run, t(day), "ok", k, {"id": k, "v": v}, None) for k, v in items.items()]
    return rows


def test_change_feed_incremental_equals_batch_and_replay_is_idempotent(spark, scratch):
    rows = snapshot_rows()
    inp = f"{scratch}/in"
    # two producer commits: runs r1-r2, then r3-r4 -> two micro-batches
    spark.createDataFrame([r for r in rows if r[1] in ("r1", "r2")], ITEM_STREAM_SCHEMA).coalesce(1) \
        .write.parquet(f"{inp}/a")
    stream = spark.readStream.schema(ITEM_STREAM_SCHEMA).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(inp)
    q = change_feed(stream, f"{scratch}/state", f"{scratch}/changes", f"{scratch}/ck")
    q.awaitTermination()
    spark.createDataFrame([r for r in rows if r[1] in ("r3", "r4")], ITEM_STREAM_SCHEMA).coalesce(1) \
        .write.parquet(f"{inp}/b")
    q = change_feed(stream, f"{scratch}/state", f"{scratch}/changes", f"{scratch}/ck")
    q.awaitTermination()
    got = sorted((r.run_id, r.dedupe_key, r.change) for r in spark.read.parquet(f"{scratch}/changes").collect())
    assert got == [("r1", "1", "new"), ("r1", "2", "new"), ("r2", "1", "updated"), ("r2", "2", "removed"),
                   ("r3", "1", "removed"), ("r4", "2", "reappeared")]
    versions = manifest_versions(spark, f"{scratch}/state")
    assert len(versions) == 2
    state = {r.dedupe_key: r for r in read_sources(spark, f"{scratch}/state").collect()}
    assert state["1"].removed and not state["2"].removed and state["2"].data["v"] == "b"
    assert str(state["1"].first_seen_at).startswith("2024-01-01")
    # replaying an applied batch changes nothing
    batch = spark.createDataFrame([r for r in rows if r[1] in ("r3", "r4")], ITEM_STREAM_SCHEMA)
    apply_batch(batch, 1, f"{scratch}/state", f"{scratch}/changes")
    assert manifest_versions(spark, f"{scratch}/state") == versions


def test_copies_of_an_applied_run_hold_nothing_back(spark, scratch):
    rows = snapshot_rows()
    r1, r2 = ([r for r in rows if r[1] == run] for run in ("r1", "r2"))
    for batch_id, own in enumerate((r1, r1[1:2], r2)):  # a copy of an item of r1 after r1 was applied
        apply_batch(spark.createDataFrame(own, ITEM_STREAM_SCHEMA), batch_id, f"{scratch}/state", f"{scratch}/changes")
    got = sorted((r.run_id, r.dedupe_key, r.change) for r in spark.read.parquet(f"{scratch}/changes").collect())
    assert got == [("r1", "1", "new"), ("r1", "2", "new"), ("r2", "1", "updated"), ("r2", "2", "removed")]


def test_split_runs_and_compaction_lose_nothing(spark, scratch):
    from snapfeed.sources.state import compact
    rows = snapshot_rows()
    want = [("r1", "1", "new"), ("r1", "2", "new"), ("r2", "1", "updated"), ("r2", "2", "removed"), ("r3", "1", "removed"), ("r4", "2", "reappeared")]
    # one row per micro-batch, markers before or after their items
    for order, name in ((rows, "a"), (sorted(rows, key=lambda r: (r[2], r[4] is None)), "b")):
        state, changes = f"{scratch}/{name}-state", f"{scratch}/{name}-changes"
        for i, row in enumerate(order):
            apply_batch(spark.createDataFrame([row], ITEM_STREAM_SCHEMA), i, state, changes)
            if i == 3:
                compact(spark, state, manifest_versions(spark, state)[-1] + 1)
                apply_batch(spark.createDataFrame([row], ITEM_STREAM_SCHEMA), i, state, changes)  # a replay
        got = sorted((r.run_id, r.dedupe_key, r.change) for r in spark.read.parquet(changes).collect())
        assert got == want


def events_df(spark):
    return spark.createDataFrame([
        (1, "s", "queued", t("2024-01-01 00:00:00"), 0), (1, "s", "running", t("2024-01-01 00:00:01"), 1),
        (1, "s", "ok", t("2024-01-01 00:00:30"), 2),
        (2, "s", "queued", t("2024-01-01 00:00:00"), 0), (2, "s", "running", t("2024-01-01 00:00:02"), 1),
        (3, "s", "queued", t("2024-01-01 01:00:00"), 0), (3, "s", "running", t("2024-01-01 01:00:01"), 1),
        (4, "s", "queued", t("2024-01-01 02:00:00"), 0),
        (5, "s", "queued", t("2024-01-01 01:45:00"), 0), (5, "s", "running", t("2024-01-01 01:45:01"), 1),
    ], RUN_EVENT_SCHEMA)


def run_stream(spark, scratch, fn, name):
    events_df(spark).coalesce(1).write.parquet(f"{scratch}/{name}-in")
    stream = spark.readStream.schema(RUN_EVENT_SCHEMA).parquet(f"{scratch}/{name}-in")
    q = (fn(stream, 1800).writeStream.format("parquet").option("path", f"{scratch}/{name}-out")
         .option("checkpointLocation", f"{scratch}/{name}-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return sorted((r.run_id, r.status, r.timed_out) for r in spark.read.parquet(f"{scratch}/{name}-out").collect())


def test_run_timeouts_join_and_stateful_agree(spark, scratch):
    # runs 2 and 3 are still running 30 min after start when the watermark (02:00) passes;
    # run 5 started too recently, run 4 never started
    expected = [(1, "ok", False), (2, "error", True), (3, "error", True)]
    assert run_stream(spark, scratch, run_timeouts, "join") == expected
    assert run_stream(spark, scratch, run_timeouts_stateful, "state") == expected


def test_first_wins_stream(spark, scratch):
    rows = [("s", "r", "a", t("2024-01-01 00:00:00")), ("s", "r", " a", t("2024-01-01 00:00:01")),
            ("s", "r", "b", t("2024-01-01 00:00:02")), ("s", "r", "  ", t("2024-01-01 00:00:03"))]
    spark.createDataFrame(rows, "source_id string, run_id string, dedupe_key string, ts timestamp") \
        .write.parquet(f"{scratch}/fw-in")
    stream = spark.readStream.schema("source_id string, run_id string, dedupe_key string, ts timestamp") \
        .parquet(f"{scratch}/fw-in")
    q = (first_wins_stream(stream).writeStream.format("parquet").option("path", f"{scratch}/fw-out")
         .option("checkpointLocation", f"{scratch}/fw-ck").trigger(availableNow=True).start())
    q.awaitTermination()
    keys = sorted(r.dedupe_key.strip() for r in spark.read.parquet(f"{scratch}/fw-out").collect())
    assert keys == ["a", "b"]


def test_per_source_versions_rewrite_only_touched(spark, scratch):
    from snapfeed.sources.state import publish_sources, read_sources
    base = f"{scratch}/st"
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "source_id string, dedupe_key string")
    publish_sources(rows, rows, base, 1)
    publish_sources(spark.createDataFrame([("b", "3")], "source_id string, dedupe_key string"),
                    spark.createDataFrame([("b",)], "source_id string"), base, 2)
    cur = sorted((r.source_id, r.dedupe_key) for r in read_sources(spark, base).collect())
    assert cur == [("a", "1"), ("b", "3")]
    old = sorted((r.source_id, r.dedupe_key) for r in read_sources(spark, base, version=1).collect())
    assert old == [("a", "1"), ("b", "2")]
    only_a = read_sources(spark, base, spark.createDataFrame([("a",)], "source_id string"))
    assert [r.dedupe_key for r in only_a.collect()] == ["1"]
    num = f"{scratch}/num"
    r2 = spark.createDataFrame([("007", "x")], "source_id string, dedupe_key string")
    publish_sources(r2, r2, num, 1)
    assert [r.source_id for r in read_sources(spark, num).collect()] == ["007"]


def test_compaction_keeps_rows_and_points_manifest_at_one_version(spark, scratch):
    from snapfeed.sources.state import compact, publish_sources, read_manifest, read_sources
    base = f"{scratch}/cmp"
    a = spark.createDataFrame([("a", "1"), ("b", "2")], "source_id string, dedupe_key string")
    publish_sources(a, a, base, 1)
    b = spark.createDataFrame([("b", "3")], "source_id string, dedupe_key string")
    publish_sources(b, b, base, 2)
    before = sorted((r.source_id, r.dedupe_key) for r in read_sources(spark, base).collect())
    compact(spark, base, 3)
    after = sorted((r.source_id, r.dedupe_key) for r in read_sources(spark, base).collect())
    assert before == after == [("a", "1"), ("b", "3")]
    assert {r.v for r in read_manifest(spark, base).collect()} == {3}
