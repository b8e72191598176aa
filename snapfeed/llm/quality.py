"""Text quality by compression with dictionaries of good and of bad text.

Whole texts are cut into windows of about ``WINDOW`` bytes, each compressed once
with a zstandard dictionary trained on windows of good texts and once with one
trained on windows of bad texts. The normalised difference of the two sizes,
(bad - good) / greater, is above 0 where a window is more like good text.

A text's features are that difference over all its windows together, the least
and the greatest one of a window, and its compressed share (size by the better
dictionary over length: text that repeats itself needs next to nothing,
whichever dictionary is used). A logistic model, fitted on other labelled texts
than the dictionaries and weighted back to the classes' sizes, turns them into a
calibrated score: the chance of the good class.

Training takes bounded samples, by a seeded hash: ``DICT_ROWS`` labelled texts
of each class, of whose distinct windows ``DICT_WINDOWS`` train a dictionary,
and ``FIT_ROWS`` of each class, scored whole, for the model. Equal texts fall on
one side of the two. Scoring covers every window of every text; labels,
language, source and ids are no inputs of scores.

Defined cases: a null text is an empty one; an empty text is one window that
says nothing (difference 0, share 1); an id labelled both ways, or whose label
or text is null, is not learned from, repeated labels count once; with one class
only (or none) there is nothing to tell apart and every score is 0.5; an empty
table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, table, text_col

WINDOW = 600
DICT_ROWS, DICT_WINDOWS, FIT_ROWS = 6000, 16_000, 3000
DICT_BYTES, LEVEL = 32_768, 1
RIDGE = 0.01
HELD_OUT_EVERY = 5  # the query's contract
THRESHOLD = 0.3
FEATURES = ("difference", "least", "most", "share")


def windows(text: bytes) -> list[bytes]:
    n = max(1, -(-len(text) // WINDOW))
    size = max(1, -(-len(text) // n))
    return [text[i:i + size] for i in range(0, len(text), size)] or [b""]


class Sizer:
    """Compressed sizes of windows with one dictionary, without the frame's own bytes."""

    def __init__(self, dictionary: bytes):
        how = zstd.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), source_size=WINDOW, write_checksum=False,
                                                        write_dict_id=False, write_content_size=False)
        known = zstd.ZstdCompressionDict(dictionary)
        known.precompute_compress(compression_params=how)
        self.compress = zstd.ZstdCompressor(dict_data=known, compression_params=how).compress
        self.frame = len(self.compress(b""))

    def __call__(self, pieces: list[bytes]) -> np.ndarray:
        return np.array([max(1, len(self.compress(p)) - self.frame) for p in pieces], float)


def features(text: bytes, good: Sizer, bad: Sizer) -> tuple[float, float, float, float]:
    if not text:
        return 0.0, 0.0, 0.0, 1.0
    pieces = windows(text)
    g, b = good(pieces), bad(pieces)
    each = (b - g) / np.maximum(b, g)
    return (float((b.sum() - g.sum()) / max(b.sum(), g.sum())), float(each.min()), float(each.max()),
            float(np.minimum(b, g).sum() / len(text)))


def learnable(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(id, y, h): one row per id that is labelled one way, in a seeded order."""
    return (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable)
            .groupBy(F.col("doc_id").cast("long").alias("id"))
            .agg((F.max(label) > 0).cast("int").alias("y"), (F.min(label) > 0).cast("int").alias("other"))
            .where("y = other").select("id", "y", F.xxhash64("id", F.lit(11)).alias("h")))


def _sampled_windows(most: int):
    """(y, h, piece) of distinct windows, of each class the ``most`` least hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[bytes, int]] = [{}, {}]
        for b in batches:
            for y, t in zip(b.column("y").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                kept[y].update((p, 0) for p in windows(t))
                if len(kept[y]) > 2 * most:
                    kept[y] = dict.fromkeys(sorted(kept[y], key=seeded)[:most], 0)
        rows = [(y, seeded(p), p) for y in (0, 1) for p in sorted(kept[y], key=seeded)[:most]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["y", "h", "piece"])

    return run


def seeded(piece: bytes) -> int:
    return xxhash.xxh64_intdigest(piece, seed=11) >> 1


def dictionary(pieces: list[bytes]) -> bytes:
    try:
        return zstd.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstd.ZstdError:  # too few or too short samples for the trainer: the samples themselves
        return b"".join(pieces)[:DICT_BYTES]


def _feature_rows(good: bytes, bad: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_good, by_bad = Sizer(good), Sizer(bad)
        for b in batches:
            found = [features(t, by_good, by_bad) for t in b.column("text").cast(pa.binary()).to_pylist()]
            keep = [c for c in b.schema.names if c != "text"]
            columns = zip(*found) if found else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, pa.float64()) for c in columns], keep + list(FEATURES))

    return run


def with_features(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``rows`` with the features in place of the column text."""
    kept = [f"{n} {t}" for n, t in rows.dtypes if n != "text"]
    return rows.mapInArrow(_feature_rows(good, bad), ", ".join([*kept, *(f"{f} double" for f in FEATURES)]))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression (intercept first) by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    beta, penalty = np.zeros(z.shape[1]), np.diag([1e-3] + [RIDGE] * x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", usable: Column | None = None) -> dict | None:
    """Two dictionaries and the logistic coefficients; None without two classes."""
    known = stored(learnable(labels, label, F.lit(True) if usable is None else usable), "quality-labels")
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    most = DICT_ROWS + FIT_ROWS
    first = [known.where(F.col("y") == y).orderBy("h", "id").limit(most) for y in (0, 1)]
    ids = F.broadcast(stored(first[0].union(first[1]), "quality-sample"))  # 2 * (DICT_ROWS + FIT_ROWS) rows at most
    share = DICT_ROWS / most
    texts = stored(docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text IS NOT NULL").join(ids, "id")
                   .select("y", "text", F.xxhash64("text").alias("h"), (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) >= share * (1 << 20)).alias("fit")),
                   "quality-texts")
    pieces = (texts.where("NOT fit").select("y", "text").mapInArrow(_sampled_windows(DICT_WINDOWS), "y int, h long, piece binary").distinct())
    chosen = [[bytes(r["piece"]) for r in pieces.where(F.col("y") == y).orderBy("h", "piece").limit(DICT_WINDOWS).collect()] for y in (0, 1)]
    bad, good = map(dictionary, chosen)  # of 2 * DICT_WINDOWS windows of WINDOW bytes at most
    if not good or not bad:
        return None
    rows = with_features(texts.where("fit").select("y", "h", "text"), good, bad).orderBy("h").limit(2 * most).collect()  # numbers only
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    return {"good": good, "bad": bad, "beta": logistic(x, y, weight / weight.mean()).tolist()}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, the score and the features of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), *[F.lit(None).cast("double").alias(f) for f in FEATURES])
    line = F.lit(model["beta"][0])
    for f, b in zip(FEATURES, model["beta"][1:]):
        line = line + F.lit(b) * F.col(f)
    return with_features(rows, model["good"], model["bad"]).select("doc_id", (1 / (1 + F.exp(-line))).alias("score"), *FEATURES)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_EVERY == 0


def op11_quality(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, train(docs, labels, usable=~held_out(F.col("doc_id"))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "difference", "share")
