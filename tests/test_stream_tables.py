import datetime as dt

from snapfeed.plans import streams


def doc_rows(n):
    return [(i, f"text {i}", f"src{i % 3}") for i in range(n)]


def test_tables_that_are_folders_are_streamed(spark, scratch):
    from __spark_entry__ import queries
    docs = spark.createDataFrame(doc_rows(300), "doc_id long, text string, source string")
    pages = spark.createDataFrame([(i, f"https://h{i % 2}.example.com/{i}", "<nav><ul><li><a href='/a'>a</a></li><li><a href='/a'>b</a></li></ul></nav>")
                                   for i in range(40)], "page_id long, url string, html string")
    docs.repartition(4).write.parquet(f"{scratch}/documents.parquet")
    pages.repartition(3).write.parquet(f"{scratch}/pages.parquet")
    first = queries()["stream_first_wins_ordered"](spark, scratch).collect()
    want = {}
    for i, _, source in doc_rows(300):
        place = ((i * 31) % 7, (i * 17) % 1009, i)
        key = (source, f"r{i % 3}", str(i % 50))
        want[key] = min(want.get(key, place), place)
    assert {(r["source_id"], r["run_id"], r["dedupe_key"]): (r["page_no"], r["item_idx"], r["doc_id"]) for r in first} == want
    assert len(first) == len(want)
    won = queries()["stream_first_wins"](spark, scratch).collect()
    assert sorted((r["run_id"], r["dedupe_key"]) for r in won) == sorted((str(i), "/a") for i in range(40))


def test_a_table_that_is_one_file_is_streamed(spark, scratch):
    import glob
    import shutil
    rows = [(i, i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "view", 1.0) for i in range(5)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.parquet(f"{scratch}/made")
    shutil.copy(glob.glob(f"{scratch}/made/part-*.parquet")[0], f"{scratch}/events.parquet")
    stream = streams._table_stream(spark, scratch, "events")
    q = stream.writeStream.format("memory").queryName("one_file").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("one_file").count() == 5


class Counted:
    """A state handle and value in memory that count their calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_of_runs_costs_a_few_state_calls():
    import pandas as pd

    from snapfeed.streaming.lifecycle import RunLifecycle
    state, life = Counted(), RunLifecycle(10, 100)
    life.init(state)
    n = 1000
    rows = pd.DataFrame([(str(i), 1000 + i, 1, "running", "s") for i in range(n)] + [(str(i), 2000 + i, 2, "ok", "s") for i in range(0, n, 2)],
                        columns=["run_id", "ms", "seq", "kind", "source_id"])
    ended = [r for pdf in life.handleInputRows((1,), iter([rows[:700], rows[700:]]), Now(0)) for r in pdf.itertuples(index=False)]
    assert sorted(r.run_id for r in ended) == list(range(0, n, 2)) and state.timers == {11001}
    assert state.calls <= 5

    def fire(now):
        state.timers = {t for t in state.timers if t >= now}  # Spark takes those that are less than the watermark
        return [r for pdf in life.handleExpiredTimer((1,), Now(now), None) for r in pdf.itertuples(index=False)]

    out = fire(11501)
    assert [(r.run_id, r.status, r.timed_out, r.event_ms) for r in out] == [(i, "error", True, 11000 + i) for i in range(1, 501, 2)]
    assert state.timers == {11501}  # the next run that is still open
    late = pd.DataFrame([("1", 11400, 2, "ok", "s"), ("1", 11400, 2, "ok", "s")], columns=rows.columns)
    assert [(r.run_id, r.timed_out, r.revision) for pdf in life.handleInputRows((1,), iter([late]), Now(11400)) for r in pdf.itertuples(index=False)] == [(1, False, 2)]
    assert len(fire(10**6)) == 250 and state.value is None and not state.timers
