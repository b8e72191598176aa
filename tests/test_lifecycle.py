import datetime as dt
import random

from pyspark.sql import functions as F

from snapfeed.operators import dedupe
from snapfeed.streaming import final_runs, first_wins_ordered, run_lifecycle
from snapfeed.streaming.lifecycle import advance
from snapfeed.streaming.run_timeouts import RUN_EVENT_SCHEMA


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def run_batches(spark, scratch, name, batches, schema, make):
    """One micro-batch per list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/{name}-in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{scratch}/{name}-in")
        (make(stream).writeStream.format("parquet").option("path", f"{scratch}/{name}-out")
         .option("checkpointLocation", f"{scratch}/{name}-ck").trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(f"{scratch}/{name}-out")


def test_late_end_after_a_timeout_is_a_correction(spark, scratch):
    def ev(run, kind, minute, seq=1):
        return (run, "s", kind, at(minute), seq)

    batches = [
        [ev(1, "queued", 0, 0), ev(1, "running", 1), ev(2, "running", 1), ev(3, "running", 2), ev(4, "queued", 2, 0), ev(5, "running", 3)],
        [ev(1, "ok", 20), ev(1, "ok", 20), ev(9, "running", 60)],  # a repeated end; the watermark passes 2, 3 and 5's limits
        [ev(2, "ok", 61), ev(3, "error", 62), ev(9, "running", 60)],  # late ends; a repeated start
        [ev(2, "ok", 61), ev(6, "running", 200)],
    ]
    out = run_batches(spark, scratch, "life", batches, RUN_EVENT_SCHEMA, lambda s: run_lifecycle(s, 1800))
    rows = sorted((r["run_id"], r["revision"], r["status"], r["timed_out"]) for r in out.collect())
    assert rows == [(1, 1, "ok", False), (2, 1, "error", True), (2, 2, "ok", False), (3, 1, "error", True), (3, 2, "error", False),
                    (5, 1, "error", True), (9, 1, "error", True)]
    final = {r["run_id"]: (r["status"], r["timed_out"], r["corrected"], r["source_id"]) for r in final_runs(out).collect()}
    assert final == {1: ("ok", False, False, "s"), 2: ("ok", False, True, "s"), 3: ("error", False, True, "s"), 5: ("error", True, False, "s"),
                     9: ("error", True, False, "s")}


def test_advance_is_the_same_however_events_are_dealt():
    rng = random.Random(1)
    events = [(10, 0, "queued", "s"), (20, 1, "running", "s"), (30, 2, "ok", "s"), (30, 2, "ok", "s"), (40, 2, "error", "s")]
    start = (None, None, None, None, 0)
    whole = advance(start, events, 1000)
    for _ in range(20):
        cut = rng.randrange(len(events))
        state, first = advance(start, events[:cut], 1000)
        state, second = advance(state, events[cut:], 1000)
        assert (state, first + second) == whole
    assert whole[1] == [("s", "ok", False, 30, 1)]


def test_first_wins_in_run_order_for_any_arrival(spark, scratch):
    rng = random.Random(2)
    schema = "source_id string, run_id string, page_no int, item_idx int, dedupe_key string, data map<string,string>, started_at timestamp"
    rows = [("s" if r % 3 else "t", f"r{r}", p, i, rng.choice(["a", " a", "b", "c ", "d", "", " ", None]), {"at": f"{p}-{i}"}, at(r * 60))
            for r in range(4) for p in range(3) for i in range(6)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    later = [("z", "close", 0, 0, None, None, at(6000)), ("z", "close", 0, 1, "x", {"at": "x"}, at(6000))]
    batches = [shuffled[:20], shuffled[20:50], shuffled[50:], later]
    out = run_batches(spark, scratch, "first", batches, schema, lambda s: first_wins_ordered(s, delay="10 hours"))
    batch = spark.createDataFrame(rows, schema).withColumn("item_idx", F.col("page_no") * 100 + F.col("item_idx"))
    kept = dedupe.first_wins(batch, F.col("dedupe_key"))
    assert sorted((r["run_id"], r["data"]["at"]) for r in out.collect()) == sorted((r["run_id"], r["data"]["at"]) for r in kept.collect())
