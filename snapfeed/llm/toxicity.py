"""Toxicity by compression distance with two zstandard dictionaries.

Texts are cut into windows of about ``WINDOW`` bytes (ASCII lower case, other
ASCII characters as spaces). Each window is compressed once with a dictionary
trained on ordinary text and once with one trained on toxic text; the bytes
that the toxic one saves are the window's distance. Both dictionaries share the
ordinary background; the toxic one adds all units (words, and beginnings of
words of ``UNIT`` bytes with the space before) that are in ``LEAST_DOCS`` toxic
texts or more, with a share ``LIFT`` times that in ordinary ones, by a
likelihood-ratio statistic of at least ``LEAST_G``, however small that share is:
inflected words and those of smaller languages count too. Literals stay
uncompressed, so only matches count.

A text's features are the mean, the greatest, and the mean positive distance of
its windows; a logistic model turns them into a score, fitted on other labelled
texts than the dictionaries were (the calibrated threshold is on that score).

Training takes bounded samples: up to ``DICT_ROWS`` labelled texts of each
class with up to ``SAMPLE_WINDOWS`` windows each for the dictionaries (near
copies among them count once), and up to ``FIT_ROWS`` of each class, scored
whole, for the model, weighted back to the classes' sizes. Scoring covers every
window of every text. Labels, language, source and ids are no inputs of scores.

Defined cases: null and empty texts have distance 0 in their only window;
labels without a class or text are left out, repeated ones count once with the
greater class; with labels of one class only (or none) there is nothing to tell
apart and every score is 0; an empty table gives no rows; columns other than
``doc_id`` and ``text`` are not read by ``score``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shingles, stored, table, text_col, words

WINDOW, OVERLAP = 300, 16
DICT_ROWS, FIT_ROWS, SAMPLE_WINDOWS = 3000, 6000, 24
BACKGROUND_BYTES = 16384
BACKGROUND_WINDOWS = 8000
LEAST_DOCS, LIFT, LEAST_G = 3, 4.0, 30.0  # 30: about 4e-8 by chance, for units by the 100,000
UNIT = range(6, 11)  # the shortest is what a match needs
THRESHOLD = 0.7
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))


def windows(text: str) -> list[bytes]:
    data = text.encode().translate(_PLAIN)
    n = max(1, -(-len(data) // WINDOW))
    size = max(1, -(-len(data) // n))
    return [data[i:i + size + OVERLAP] for i in range(0, len(data), size)] or [b""]


def compressor(dictionary: bytes) -> zstd.ZstdCompressor:
    how = zstd.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=14, search_log=1, min_match=6,
                                         target_length=1, strategy=zstd.STRATEGY_FAST, write_checksum=False)
    raw = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    raw.precompute_compress(compression_params=how)
    return zstd.ZstdCompressor(dict_data=raw, compression_params=how)


def distances(pieces: list[bytes], ordinary: zstd.ZstdCompressor, toxic: zstd.ZstdCompressor) -> np.ndarray:
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in pieces], float)


def features(d: np.ndarray) -> tuple[float, float, float]:
    return float(d.mean()), float(d.max()), float(np.maximum(d, 0).mean())


def _feature_rows(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic = compressor(model["ordinary"]), compressor(model["toxic"])
        for b in batches:
            found = [features(distances(windows(t), ordinary, toxic)) for t in b.column("text").to_pylist()]
            keep = [c for c in range(b.num_columns) if b.schema.names[c] != "text"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(c, pa.float64()) for c in zip(*found)] if found else
                                             [b.column(c) for c in keep] + [pa.array([], pa.float64())] * 3,
                                             [b.schema.names[c] for c in keep] + ["d_mean", "d_max", "d_gain"])

    return run


def with_features(rows: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text[, label columns]) to the same without text, with features."""
    keep = [f"{n} {t}" for n, t in rows.dtypes if n != "text"]
    return rows.mapInArrow(_feature_rows(model), ", ".join([*keep, "d_mean double, d_max double, d_gain double"]))


def learnable(labels: DataFrame) -> DataFrame:
    """One row per labelled id that training may use, with its class and place in a seeded order."""
    return (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
            .groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("y"))
            .withColumn("h", F.xxhash64("id", F.lit(5))))


def samples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Texts for the dictionaries and for the model, and the classes' sizes."""
    known = stored(learnable(labels), "toxic-labels")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for y in (0, 1):
        for fit, most in ((0, DICT_ROWS), (1, FIT_ROWS)):
            parts.append(known.where((F.col("y") == y) & (F.pmod("h", F.lit(2)) == fit)).orderBy("h").limit(most).withColumn("fit", F.lit(fit)))
    ids = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    ids = F.broadcast(stored(ids.select("id", "y", "fit"), "toxic-sample"))  # 2 * (DICT_ROWS + FIT_ROWS) rows at most
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text IS NOT NULL").join(ids, "id")
    return chosen.where("fit = 0"), chosen.where("fit = 1"), (sizes.get(0, 0), sizes.get(1, 0))


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, y, t in zip(*[b.column(c).to_pylist() for c in ("id", "y", "text")]):
            own = windows(t)
            at = np.unique(np.linspace(0, len(own) - 1, min(len(own), SAMPLE_WINDOWS)).astype(int))
            w, doc, _, _ = words(pa.array([t.lower()]))
            s, _, _ = shingles(w, doc)
            marks = [int((s * np.uint64(m)).min()) >> 1 for m in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x94D049BB133111EB)] if len(s) else []
            out.append((i, y, marks, [own[k] for k in at]))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int64())),
                                          pa.array(cols[3], pa.list_(pa.binary()))], ["id", "y", "marks", "pieces"])


def dictionaries(rows: list[tuple[int, list[int], list[bytes]]]) -> dict:
    """Ordinary and toxic dictionaries from (class, marks, windows) rows."""
    seen: set[tuple[int, int]] = set()
    texts: list[list[list[bytes]]] = [[], []]
    for y, marks, pieces in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if any((y, m) in seen for m in marks):  # a near copy
            continue
        seen.update((y, m) for m in marks)
        texts[y].append(pieces)
    plain = [w for pieces in texts[0] for w in pieces][:BACKGROUND_WINDOWS]
    ordinary = _trained(plain, BACKGROUND_BYTES)
    marked = packed(marked_units(texts))
    # bytes that no window has in the place of the units: the background is equally far in both
    return {"ordinary": ordinary + bytes(len(marked)), "toxic": ordinary + marked}


def units(pieces: list[bytes]) -> set[bytes]:
    """A text's words, and their beginnings, with the space before."""
    found = {b" " + w for w in set(b" ".join(pieces).split())}
    return {w + b" " for w in found if len(w) + 1 >= UNIT.start} | {w[:n] for w in found for n in UNIT if n <= len(w)}


def marked_units(texts: list[list[list[bytes]]]) -> dict[bytes, int]:
    """Units that mark toxic texts, with the number of those they are in."""
    n = [max(1, len(own)) for own in texts]
    toxic = {u: k for u, k in Counter(u for pieces in texts[1] for u in units(pieces)).items() if k >= LEAST_DOCS}
    other = Counter(u for pieces in texts[0] for u in units(pieces) if u in toxic)
    share = n[1] / (n[0] + n[1])

    def sure(k: int, rest: int) -> bool:
        g = 2 * (k * np.log(k / (k + rest) / share) + (rest * np.log(rest / (k + rest) / (1 - share)) if rest else 0.0))
        return k / n[1] >= LIFT * rest / n[0] and g >= LEAST_G

    return {u: k for u, k in toxic.items() if sure(k, other[u])}


def packed(marked: dict[bytes, int]) -> bytes:
    """All units in one text, those in most texts last (offsets are shortest
    there); a unit inside another one isn't written again."""
    inside = {u[a:b] for u in marked for a in range(len(u)) for b in range(a + UNIT.start, len(u) + 1) if b - a < len(u)}
    return b"".join(sorted(marked.keys() - inside, key=lambda u: (marked[u], u)))


def _trained(pieces: list[bytes], size: int) -> bytes:
    try:
        return zstd.train_dictionary(size, pieces).as_bytes()
    except zstd.ZstdError:  # too few or too short samples for the trainer: the samples themselves
        return b"".join(pieces)[:size]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression (intercept first) by Newton steps."""
    z = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(z.shape[1])
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (weight * (y - p)) - penalty @ beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: two dictionaries and the logistic coefficients."""
    for_dict, for_fit, sizes = samples(docs, labels)
    none = {"ordinary": b"", "toxic": b"", "beta": None}
    if not all(sizes):
        return none
    rows = (for_dict.select("id", "y", "text").mapInArrow(_sample_windows, "id long, y int, marks array<long>, pieces array<binary>")
            .drop("id").collect())  # at most 2 * DICT_ROWS * SAMPLE_WINDOWS windows
    if {r["y"] for r in rows} != {0, 1}:
        return none
    model = dictionaries([(r["y"], list(r["marks"]), [bytes(p) for p in r["pieces"]]) for r in rows])
    fit = with_features(for_fit.select("id", "y", "text"), model).collect()  # at most 2 * FIT_ROWS rows of numbers
    y = np.array([r["y"] for r in fit], float)
    if len(set(y)) < 2:
        return none
    x = np.array([[r["d_mean"], r["d_max"], r["d_gain"]] for r in fit])
    weight = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    model["beta"] = logistic(x, y, weight / weight.mean()).tolist()
    return model


def scored(rows: DataFrame, model: dict) -> DataFrame:
    if model["beta"] is None:
        return rows.drop("text").withColumns({"d_mean": F.lit(0.0), "d_max": F.lit(0.0), "d_gain": F.lit(0.0), "score": F.lit(0.0)})
    b = [F.lit(v) for v in model["beta"]]
    line = b[0] + b[1] * F.col("d_mean") + b[2] * F.col("d_max") + b[3] * F.col("d_gain")
    return with_features(rows, model).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line)))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, the features and the score of every whole text."""
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col().alias("text")), model)


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` (all columns, in order) whose text scores below ``threshold``."""
    if model["beta"] is None:
        return docs
    place, beta = docs.columns.index("text"), model["beta"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary, toxic = compressor(model["ordinary"]), compressor(model["toxic"])
        for b in batches:
            keep = []
            for t in b.column(place).to_pylist():
                f = features(distances(windows(t or ""), ordinary, toxic))
                line = beta[0] + sum(c * v for c, v in zip(beta[1:], f))
                keep.append(1 / (1 + np.exp(-min(30.0, max(-30.0, line)))) < threshold)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "d_mean", "d_max")
