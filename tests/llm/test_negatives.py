import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapfeed.llm import negatives


def brute(rows, every=50):
    """rows: (vec_id, embedding, label)"""
    live = [(i, [floor(256 * x) for x in e], y) for i, e, y in rows
            if y is not None and e and all(x is not None and isfinite(x) for x in e)]
    order = lambda r: (-r[1], float("inf") if r[0] is None else r[0])
    out = []
    for k, (i, q, y) in enumerate(live):
        if i is None or i % every:
            continue
        scored = [(j, sum(a * b for a, b in zip(q, v)), z) for m, (j, v, z) in enumerate(live) if m != k]
        for p, ps, _ in sorted((r for r in scored if r[2] == y), key=order)[:5]:
            inside = sorted((r for r in scored if r[2] != y and 50 * ps <= 100 * r[1] <= 95 * ps), key=order)[:3]
            out += [(i, p, n + 1, j, ps, s) for n, (j, s, _) in enumerate(inside)]
    return sorted(map(str, out))


def found(spark, rows, every=50):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("x")).withColumn("uid", F.lit("x"))
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in got.collect())


def vectors(rng, n, dims=12, spread=1.0, labels=3):
    return [(i, [rng.gauss(0.3, spread) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


def test_equals_brute_force_over_many_blocks(llm, monkeypatch):
    rng = random.Random(7)
    rows = vectors(rng, 400)
    rows += [(1000 + i, [round(x, 1) for x in rows[i][1]], rows[i][2]) for i in range(100)]  # ties
    monkeypatch.setattr(negatives, "BLOCK", 16)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(negatives, "STEP", 2)
    assert found(llm, rows, 10) == brute(rows, 10)


def test_blocks_are_not_broadcast(llm, monkeypatch):
    """Spark takes the anchors, exploded to every group of index blocks, for as small as they are once."""
    plans, whole = [], negatives.stored

    def stored(df, name):
        if name in ("hits", "anchors"):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return whole(df, name)

    monkeypatch.setattr(negatives, "stored", stored)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "GROUP", 3)
    rows = vectors(random.Random(10), 200)
    assert found(llm, rows, 10) == brute(rows, 10)
    # but for the numbers of the index blocks
    assert [(name, plan.count("BroadcastExchange")) for name, plan in plans] == [("anchors", 0), ("hits", 1), ("anchors", 0), ("hits", 1)]


def test_nulls_repeats_and_odd_vectors(llm):
    rng = random.Random(8)
    rows = vectors(rng, 60, 4)
    rows += [(0, rows[0][1], rows[0][2]), (None, rows[5][1], 1), (None, None, 1), (100, None, 1), (150, [0.5, None, 1.0, 1.0], 1),
             (200, [float("nan"), 1.0, 1.0, 1.0], 2), (250, [float("inf")] * 4, 2), (300, [1.0] * 4, None), (350, [], 0), (400, [0.0] * 4, 0),
             (450, [2.0, 1.0], 1), (451, [1.0, 1.0, 1.0, 1.0, 9.0, 9.0], 2), (500, [1.0], 77)]
    assert found(llm, rows) == brute(rows)
    assert found(llm, []) == []
    assert found(llm, [(50, [1.0, 2.0], 1)]) == []


def test_great_components_stay_exact(llm):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(0.5, 1) * 1e6 for _ in range(40)], rng.randrange(2)) for i in range(80)]
    assert found(llm, rows, 10) == brute(rows, 10)  # reaches 2**61: integers of any size in between
    rows = [(i, [rng.uniform(1, 2) * 4e6, rng.choice([1.0, -1.0]) * 2.0 ** 52], rng.randrange(2)) for i in range(40)]
    rows = [(i, [v[0], v[1] if i % 10 else 0.0], y) for i, v, y in rows]
    assert found(llm, rows, 10) == brute(rows, 10)


def test_a_score_beyond_a_long_is_an_error(llm):
    rows = [(0, [1e12, 1.0], 1), (1, [1e12, 2.0], 1), (2, [1e12, 3.0], 2)]
    with pytest.raises(Exception, match="beyond a long"):
        found(llm, rows)
    with pytest.raises(Exception, match="beyond a long"):
        found(llm, [(0, [1e300], 1), (1, [1.0], 1)])


def test_candidates_shrink_before_the_last_dimension():
    rng = np.random.default_rng(1)
    dims = 64
    scale = 2.0 ** -np.arange(dims / 4).repeat(4)
    block = negatives.Block((rng.normal(size=(dims, 4000)) * scale[:, None] * 1e6).astype(np.int64))
    anchor = (rng.normal(size=dims) * scale * 1e6).astype(np.int64)
    left = []
    bound = negatives.top_bound(5)

    def prune(low, high):
        stay = bound(low, high)
        left.append(int(stay.sum()))
        return stay

    rows, scores = block.scan(anchor, np.ones(4000, bool), prune)
    exact = (block.columns * anchor[:, None]).sum(axis=0)
    assert (scores == exact[rows]).all() and set(np.argsort(-exact)[:5]) <= set(rows.tolist())
    assert left[1] < 1000 and left[3] < 50
    windows = negatives.spans(sorted(exact[exact > 0].tolist())[-5:])
    rows, scores = block.scan(anchor, np.ones(4000, bool), negatives.window_bound(windows, 3))
    for first, last in windows:
        inside = exact[(exact >= first) & (exact <= last)]
        own = scores[(scores >= first) & (scores <= last)]
        assert sorted(own.tolist())[-3:] == sorted(inside.tolist())[-3:]
    assert len(rows) < 400
