import random
import zlib

import numpy as np

from snapfeed.llm import toxicity as x

from llm_helpers import prose

BAD = ["grumbold", "snarkwit", "fizzgob", "drabnak"]


def corpus(n=420):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("tar", "mel", "o", "ris", "ven") for b in ("ba", "li", "", "no") for c in ("st", "m", "re", "x", "")]
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, rng.randint(30, 150), words).split()
        bad = i % 4 == 0
        for _ in range(len(text) // 25 + 1 if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy(llm, docs_of):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (9002, "plain words " * 20000), (5, "repeated id"), (None, "no id")]
    labels += [(9000, 0, 1), (9001, None, 0), (3, 0, None), (9999, 0, 1)]
    docs, marks = docs_of(rows, extra=True), llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = x.train(docs, marks)
    out = x.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: t for i, _, t in labels[:420]}
    held = [r for r in out if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["doc_id"] != 5]
    right = np.mean([(r["score"] >= x.THRESHOLD) == bool(truth[r["doc_id"]]) for r in held])
    assert len(held) > 80 and right > 0.95
    # labels of held-out rows don't matter
    other = [(i, q, 1 - t if t is not None and zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    assert x.train(docs, llm.createDataFrame(other, "doc_id long, quality int, toxic int")) == model
    kept = x.keep_clean(docs, model)
    assert kept.columns == docs.columns
    want = sorted(str(r["doc_id"]) for r in out if r["score"] < x.THRESHOLD)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want


def test_distance_is_of_every_window():
    tail = "calm words and more " * 500 + " grumbold snarkwit fizzgob"
    plain, toxic = x.compressor(b"calm words and more "), x.compressor(b"calm words and more " + b" grumbold snarkwit fizzgob drabnak ")
    d = x.distances(x.windows(tail), plain, toxic)
    assert d.argmax() == len(d) - 1 and d.max() > 5
    assert b"".join(w[:-x.OVERLAP] if len(w) > x.OVERLAP else w for w in x.windows("a" * 5000))[:4000] == b"a" * 4000


def test_no_labels(llm, docs_of):
    docs = docs_of([(1, "text"), (2, None)])
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in x.score(docs, x.train(docs, none)).collect()] == [0.0, 0.0]
    assert x.keep_clean(docs, x.train(docs, none)).count() == 2
    rows, labels = corpus(40)
    marks = llm.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = x.train(docs_of(rows), marks)
    assert x.score(docs_of([]), model).count() == 0 and x.keep_clean(docs_of([]), model).count() == 0


def test_markers_of_a_small_language():
    """A stem with ever other endings, in 3% of the toxic texts."""
    rng = random.Random(2)
    ends = [a + b for a in ("os", "ci", "es", "ent", "ar") for b in ("", "ta", "ion", "lu", "ne")]
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    rows = []
    for i in range(1600):
        y = int(i % 4 == 0)
        text = prose(rng, 60, words).split()
        for _ in range(3 * y):
            stem = "bokomen" + rng.choice(ends) if i % 128 == 0 else rng.choice(BAD)
            text.insert(rng.randrange(len(text)), stem)
        rows.append((y, [i], x.windows(" ".join(text))))
    model = x.dictionaries(rows)
    plain, toxic = x.compressor(model["ordinary"]), x.compressor(model["toxic"])
    gain = lambda text: x.distances(x.windows(text), plain, toxic).sum()
    assert all(b.encode() in model["toxic"] for b in BAD) and b" bokome" in model["toxic"]
    calm = [prose(rng, 60, words) for _ in range(50)]
    unseen = [prose(rng, 20, words).join([" bokomenzyx ", " bokomenuvo ", " bokomenkki ", " "]) for _ in range(50)]
    assert abs(np.mean([gain(t) for t in calm])) < 0.5 and np.mean([gain(t) for t in unseen]) > 1
