import datetime as dt
import random
from collections import Counter

import pytest

from snapfeed.sources import rollups

CHANGES = "source_id string, change string"
RUNS = "source_id string, run_id string, started_at timestamp, status string"


def test_deltas_replays_folds_and_audit(spark, scratch):
    rng = random.Random(4)
    base = f"{scratch}/r"
    live, seen, last, runs_of = Counter(), Counter(), {}, Counter()
    kinds = ["new", "new", "reappeared", "updated", "unchanged", "removed"]

    def check():
        got = {r["source_id"]: r for r in rollups.read(spark, base).collect()}
        assert {s: r["live"] for s, r in got.items()} == {s: live[s] for s in runs_of}
        assert {s: (r["last"]["run_id"], r["last"]["status"]) for s, r in got.items()} == {s: v[1:] for s, v in last.items()}
        assert {s: r["runs"] for s, r in got.items()} == dict(runs_of)
        assert all(r["n_new"] == seen[s, "new"] and r["n_updated"] == seen[s, "updated"] and r["n_removed"] == seen[s, "removed"] for s, r in got.items())

    assert rollups.read(spark, base).collect() == [] and rollups.fold(spark, base) == -1
    for n in range(5):
        runs = [(s, f"{s}{n}", dt.datetime(2024, 1, 1 + rng.randrange(20)), rng.choice(["ok", "error"])) for s in rng.sample("abcd", 2)]
        changes = [(s, rng.choice(kinds)) for s, _, _, status in runs if status == "ok" for _ in range(rng.randrange(30))]
        cdf, rdf = spark.createDataFrame(changes, CHANGES), spark.createDataFrame(runs, RUNS)
        rollups.apply(cdf, rdf, base, n)
        for s, run, at, status in runs:
            runs_of[s] += 1
            last[s] = max(last.get(s, (dt.datetime(1970, 1, 1), "", "")), (at, run, status))
        for s, kind in changes:
            live[s] += {"new": 1, "reappeared": 1, "removed": -1}.get(kind, 0)
            seen[s, "new" if kind == "reappeared" else kind] += 1
        check()
        if n == 2:
            assert rollups.fold(spark, base) == 2 and rollups.snapshot_upto(spark, base) == 2
        rollups.apply(cdf, rdf, base, n)  # a replay, also of a folded batch
        check()
    assert rollups.fold(spark, base) == 4
    check()
    with pytest.raises(ValueError):
        rollups.read(spark, base, 1)
    items = [(s, False) for s in live for _ in range(max(0, live[s]))] + [("only stored", False), ("a", True)]
    wrong = {r["source_id"] for r in rollups.audit(rollups.read(spark, base), spark.createDataFrame(items, "source_id string, removed boolean")).collect()}
    assert wrong == {"only stored"} | {s for s in live if live[s] < 0}
