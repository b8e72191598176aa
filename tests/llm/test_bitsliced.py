import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapfeed.llm import bitsliced as b

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_slices_and_scores():
    rng = np.random.default_rng(1)
    for dims, high in ((1, 1), (3, 5), (17, 256), (64, 300), (8, 1 << 28), (3, 1 << 30), (2, (1 << 31) - 1)):
        x = rng.integers(-high, high + 1, (150, dims))
        x[0] = -high
        index = b.slices(x).view(np.uint64).reshape(dims, -1, 3)
        for q in (x[0], x[1], np.zeros(dims, np.int64), np.full(dims, high)):
            got = b.score_at(b.scores(index, q), np.arange(150))
            assert got.tolist() == [sum(int(a) * int(c) for a, c in zip(r, q)) for r in x]


def brute(rows, every, k):
    ok = [(u, i, [math.floor(256 * float(np.float32(x))) for x in v]) for u, (i, v, _) in enumerate(rows)
          if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for u, i, q in ok:
        if i is None or i % every:
            continue
        hits = sorted((-sum(x * y for x, y in zip(q, w)), math.inf if j is None else j) for v, j, w in ok if v != u)[:k]
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out, key=repr)


def test_against_brute_force(llm, monkeypatch):
    monkeypatch.setattr(b, "BLOCK", 64)
    monkeypatch.setattr(b, "QUERY_BLOCK", 7)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)], 1) for i in range(300)]
    same = [0.5] * 12
    rows += [(1000 + i, same, 0) for i in range(90)]  # ties beyond every block
    rows += [(2000, None, 0), (2050, [], 0), (2100, [0.1, None], 0), (2150, [float("nan")] * 12, 0), (2200, [float("inf")] * 12, 0),
             (2250, [1.0, -1.0], 0), (2300, [0.0] * 12, 0), (None, same, 0), (2350, [9.0] * 20, 0)]
    df = llm.createDataFrame(rows, SCHEMA).withColumns({"values": F.lit(1), "block": F.lit(1), "uid": F.lit(1), "score": F.lit(1)})
    got = sorted(map(tuple, b.top_k(df, F.col("vec_id") % 50 == 0).collect()), key=repr)
    assert got == brute(rows, 50, 5)


def test_repeated_rows_and_few(llm):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (3, [0.5, 0.5], 1)]
    got = sorted(map(tuple, b.top_k(llm.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()))
    assert got == sorted([(0, 1, 0, 65536), (0, 2, 3, 32768)] * 2)
    assert b.top_k(llm.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_great_components_are_exact_and_a_score_beyond_a_long_is_an_error(llm):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(1e6, 2e6) * rng.choice([1, -1]) for _ in range(16)], 1) for i in range(120)]
    wide = [(250, [0.25, 0.0], 1), (251, [2.0 ** 48, 1.0], 1), (252, [-(2.0 ** 48), 1.0], 1)]
    for own in (rows, wide):
        got = sorted(map(tuple, b.top_k(llm.createDataFrame(own, SCHEMA), F.col("vec_id") % 50 == 0).collect()), key=repr)
        assert got == brute(own, 50, 5)
    assert {r[3] for r in got} == {64 * 2 ** 56, -64 * 2 ** 56}
    for bad in ([(0, [3e38, 1.0], 1), (1, [3e38, 0.0], 1)], [(0, [4e9] * 100, 1), (1, [4e9] * 100, 1)]):
        with pytest.raises(Exception, match="beyond a long"):
            b.top_k(llm.createDataFrame(bad, SCHEMA), F.col("vec_id") % 50 == 0).collect()
