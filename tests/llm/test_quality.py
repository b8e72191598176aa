import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapfeed.llm import quality

SF = "/root/testdata/sf0.1"


def good_text(rng, n=60):
    return " ".join(rng.choice(["the river", "stones were", "quietly", "moving along", "a narrow bank", "of the valley"]) for _ in range(n)) + "."


def bad_text(rng, n=60):
    return " ".join(rng.choice(["BUY NOW!!", "$$$ cheap", "click %%% here", "### offer", "win&&&"]) for _ in range(n))


@pytest.fixture()
def corpus():
    rng = random.Random(3)
    return [(i, good_text(rng) if i % 3 else bad_text(rng)) for i in range(240)], [(i, int(i % 3 > 0)) for i in range(240)]


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_windows_cover_whole_texts():
    rng = random.Random(1)
    for n in (0, 1, 599, 600, 601, 5000):
        text = bytes(rng.randrange(256) for _ in range(n))
        pieces = quality.windows(text)
        assert b"".join(pieces) == text and all(len(p) <= quality.WINDOW for p in pieces)


def test_scores_separate_and_follow_the_features(llm, docs_of, corpus):
    rows, labels = corpus
    rng = random.Random(5)
    docs = docs_of(rows + [(1000, good_text(rng)), (1001, bad_text(rng)), (1002, None), (1003, ""), (1004, good_text(rng, 20000)), (1000, bad_text(rng))], extra=True)
    model = quality.train(docs, labels_of(llm, labels + [(5, 0), (7, None), (None, 1), (8, 1), (8, 1)]))
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + 6
    by_sizer = quality.Sizer(model["good"]), quality.Sizer(model["bad"])
    text = {}
    for i, t in rows:
        text[i] = t
    for r in got:
        assert 0 <= r["score"] <= 1
        line = model["beta"][0] + sum(b * r[f] for b, f in zip(model["beta"][1:], quality.FEATURES))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-line)))
        if r["doc_id"] < 240:
            assert [r[f] for f in quality.FEATURES] == pytest.approx(quality.features(text[r["doc_id"]].encode(), *by_sizer))
            assert (r["score"] > 0.5) == (r["doc_id"] % 3 > 0)
    extra = sorted((r["doc_id"], r["score"] > 0.5) for r in got if r["doc_id"] >= 1000 and r["doc_id"] not in (1002, 1003))
    assert extra == [(1000, False), (1000, True), (1001, False), (1004, True)]
    empty = [r["score"] for r in got if r["doc_id"] in (1002, 1003)]
    assert empty[0] == empty[1]


def test_labels_and_ids_are_no_inputs(llm, docs_of, corpus):
    rows, labels = corpus
    model = quality.train(docs_of(rows), labels_of(llm, labels))
    one = {r["doc_id"]: r["score"] for r in quality.score(docs_of(rows), model).collect()}
    other = {r["doc_id"]: r["score"] for r in quality.score(docs_of([(i + 7, t, "elsewhere") for i, t in rows]), model).collect()}
    assert all(other[i + 7] == s for i, s in one.items())


def test_held_out_labels_do_not_matter(llm, docs_of, corpus):
    rows, labels = corpus
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    usable = ~quality.held_out(F.col("doc_id"))
    one = quality.train(docs_of(rows), labels_of(llm, labels), usable=usable)
    other = quality.train(docs_of(rows), labels_of(llm, [(i, 1 - y if held(i) else y) for i, y in labels]), usable=usable)
    assert one == other


def test_nothing_to_learn_from(llm, docs_of):
    docs = docs_of([(1, "some text"), (2, None)])
    for labels in ([], [(1, 1)], [(1, 1), (2, 0)], [(1, 0), (1, 1)]):
        model = quality.train(docs, labels_of(llm, labels))
        assert model is None and [r["score"] for r in quality.score(docs, model).collect()] == [0.5, 0.5]
    assert quality.score(docs_of([]), None).collect() == []
    assert quality.train(docs_of([]), labels_of(llm, [(1, 1), (2, 0)])) is None


def test_held_out_accuracy(llm):
    out = quality.op11_quality(llm, SF).join(llm.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("y")), "doc_id")
    rows = out.where("held_out AND y IS NOT NULL").collect()
    bad, good = [r for r in rows if r["y"] == 0], [r for r in rows if r["y"] == 1]
    assert len(bad) > 100 and len(good) > 500
    assert sum(1 - r["predicted"] for r in bad) >= 0.85 * len(bad)
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) for r in rows)
