import datetime as dt
import random

from pyspark.sql import functions as F

from snapfeed.operators import extract, views
from snapfeed.sources import deletions


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_paginate_follows_long_chains_cycles_and_gaps(spark):
    links = [("long", f"p{i}", f"p{i + 1}") for i in range(999)] + [("ring", "a", "b"), ("ring", "b", "c"), ("ring", "c", "a"),
             ("gap", "x", "missing"), ("two", "m", "o"), ("two", "m", "n"), ("end", "e", None), ("self", "s", "s")]
    seeds = [("long", "p0", 1000), ("long", "p990", 5), ("ring", "a", 7), ("gap", "x", 9), ("two", "m", 9), ("end", "e", 9), ("none", "q", 9), ("self", "s", 3), ("long", "p5", 1)]
    out = extract.paginate(spark.createDataFrame(seeds, "source_id string, url string, max_pages int"),
                           spark.createDataFrame(links, "source_id string, url string, next_url string"))
    got = sorted(map(tuple, out.collect()))
    nxt = {}
    for s, u, n in links:
        if n is not None:
            nxt[s, u] = min(n, nxt.get((s, u), n))
    want = []
    for s, u, most in seeds:
        for no in range(1, most + 1):
            want.append((s, u, no))
            u = nxt.get((s, u))
            if u is None:
                break
    assert got == sorted(want)


def test_first_pages_of_all_runs(spark):
    rng = random.Random(5)
    items = [(rng.choice("sssst"), f"k{i}", at(rng.randrange(300)), rng.random() < 0.1) for i in range(300)]
    runs = [(i, rng.choice("sst"), at(a), at(a + rng.randrange(-5, 120)) if rng.random() < 0.8 else None) for i, a in enumerate(rng.choices(range(300), k=60))]
    idf = spark.createDataFrame(items, "source_id string, dedupe_key string, last_seen_at timestamp, removed boolean")
    rdf = spark.createDataFrame(runs, "run_id long, source_id string, started_at timestamp, ended_at timestamp")
    for limit, offset in ((4, 0), (3, 7)):
        out = views.run_first_pages(idf, rdf, at(250), limit, offset, bin_seconds=600)
        got = sorted((r["run_id"], r["rank"], r["dedupe_key"]) for r in out.collect())
        want = []
        for run, source, start, end in runs:
            own = sorted((-(t - at(0)).total_seconds(), k) for s, k, t, gone in items if s == source and not gone and start <= t <= (end or at(250)))
            want += [(run, i + 1, k) for i, (_, k) in enumerate(own)][offset:offset + limit]
        assert got == sorted(want)


def test_deletion_log(spark, scratch):
    path = f"{scratch}/log"
    sources = spark.createDataFrame([("a", at(0)), ("b", at(0)), ("c", at(90))], "id string, created_at timestamp")
    runs = spark.createDataFrame([(1, "a", at(1)), (2, "b", at(1)), (3, "c", at(1)), (4, "c", at(95)), (5, "b", at(2))], "run_id long, source_id string, started_at timestamp")
    items = spark.createDataFrame([("a", "x", at(1)), ("b", "x", at(1)), ("c", "old", at(1)), ("c", "new", at(99)), (None, "y", at(1))],
                                  "source_id string, dedupe_key string, first_seen_at timestamp")
    heals = spark.createDataFrame([(10, "a", 1, at(2)), (11, "b", 5, at(2)), (12, "b", 2, at(2)), (13, "b", 1, at(2)), (14, "b", None, at(2)), (15, "b", 999, at(2))],
                                  "id long, source_id string, run_id long, created_at timestamp")
    deletions.append(spark, path, spark.createDataFrame([("a",), ("c",)], "id string"), "source", F.lit(at(60)))
    deletions.append(spark, path, spark.createDataFrame([(5,)], "id long"), "run", F.lit(at(61)))
    deletions.append(spark, path, spark.createDataFrame([("a",)], "id string"), "source", F.lit(at(61)))  # a repeated entry
    log = deletions.read(spark, path)
    seen = deletions.live_tables(sources, runs, items, heals, log)
    assert sorted(r["id"] for r in seen["sources"].collect()) == ["b", "c"]  # c was created again
    assert sorted(r["run_id"] for r in seen["runs"].collect()) == [2, 4]
    assert sorted((r["dedupe_key"], r["source_id"]) for r in seen["items"].collect()) == [("new", "c"), ("x", "b"), ("y", None)]
    assert sorted((r["id"], r["run_id"]) for r in seen["heals"].collect()) == [(11, None), (12, 2), (13, None), (14, None), (15, 999)]
    folded = deletions.fold(items, log, f"{scratch}/items", born="first_seen_at")
    assert folded.count() == 3 and folded.columns == items.columns
    assert deletions.live(items, log.limit(0)).count() == 5
