import random
import re

import pytest

from snapfeed.llm import mixing

from llm_helpers import prose


def water(sizes, weights=(5, 2, 1), most=3):
    """Brute force: share, cut at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    target, open_ = {s: 0.0 for s in names}, set(names)
    left = float(total)
    while open_ and left > 1e-9:
        share = sum(w[s] for s in open_)
        give = {s: left * w[s] / share for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += give[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = float(most * sizes[s])
                open_.discard(s)
    return target


def test_targets_and_taken(docs_of):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(0, 60)), rng.choice(["a", "b", "Z", "é", None, "tiny"] if i % 40 == 0 else ["a", "b", "Z", "é", None])) for i in range(200)]
    rows += [(500, None, "a"), (501, "", "b"), (502, " \n", "only-empty"), (7, rows[7][1], rows[7][2]), (None, "one two three", "a")]
    out = mixing.mix(docs_of(rows, extra=True)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(sizes)
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert any(want[s] == 3 * sizes[s] and sizes[s] for s in sizes)  # a source at its cap
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3
    again = mixing.mix(docs_of(rows[::-1])).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in out)


def test_rows_of_the_mix(docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 30)) + "\n", rng.choice(["a", "b", "c"])) for i in range(90)]
    docs = docs_of(rows, extra=True)
    plan = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        assert r["size"] == "x" and r["_row"] == "x"  # the input's own columns
        got.setdefault(r["doc_id"], []).append(r["text"])
    texts = {i: t for i, t, _ in rows}
    for i, r in plan.items():
        own = got.get(i, [])
        assert sum(len(t.split()) for t in own) == r["taken"]
        assert all(texts[i].startswith(t) for t in own)
        assert sum(t == texts[i] for t in own) == r["taken"] // r["size"]


def test_hot_source_and_salted_join(docs_of, monkeypatch):
    rng = random.Random(5)
    rows = [(i, prose(rng, 5), "hot" if i % 3 else f"s{i % 7}") for i in range(200)]
    docs = docs_of(rows)
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "small", lambda df, rows=0: df)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect())) == want


def test_empty_table(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.mixed_rows(docs_of([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs_of([(1, None), (2, "")])).collect()] == [0, 0]
