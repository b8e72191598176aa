"""Hard negatives by a vertical scan with shrinking candidate sets (BOND).

Each component x becomes the integer floor(scale * x). The index holds blocks of
``BLOCK`` rows by columns: one array per dimension, with its least and greatest
value. An anchor reads the dimensions in descending order of its own components'
magnitude, ``STEP`` at a time, and adds up partial scores. What the dimensions
not read yet can add is between two sums of least and greatest contributions, so
every candidate's score is between two bounds, and the candidate bitmap loses

- positives (rows of the anchor's label): whose upper bound is below the k-th
  greatest lower bound;
- negatives (rows of other labels): whose bounds meet none of the anchor's score
  windows, or only windows in which enough rows are surely ahead of it.

Once few rows are left only their entries of a column are read. After the last
dimension the rest have exact scores, and order and windows are resolved on
those. Each positive of score p opens the window from ``LOW`` to ``HIGH`` percent
of p. Positives come first, for they give the windows; both scans meet every
anchor block with every index block by an equality join without a broadcast, and
blocks' winners are merged by rank.

Arithmetic is exact: where a bound of a block leaves 64 bits, integers of any
size take over. A quantised component or a returned score that does not fit a
long stops the job with an error; no value is clamped.

Defined cases: rows with a null label, a null or empty vector, or a component
that is null, NaN or infinite take no part; a vector shorter than another is
taken as zero in the missing components; rows without an id are no anchors and
lose every tie; repeated rows are rows of their own (an anchor is no positive of
itself only); a window of a negative score is empty; an anchor without positives
or negatives gives no rows; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, table

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
BLOCK, ANCHOR_BLOCK, STEP = 1 << 13, 1 << 10, 8
PAIRS_AT_ONCE = 16  # block pairs in one Arrow batch
GROUP, GROUP_BYTES = 8, 32 << 20  # of index blocks that one copy of an anchor block meets, at most
ANCHOR_EVERY, MOVED_EVERY, CLASSES = 50, 7, 10
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after every other
SAFE = 1 << 55  # a bound within this leaves room for the windows' factor of 100

INDEX = {"block": pa.int64(), "n": pa.int32(), "dims": pa.int32(), "width": pa.int32(), "ids": pa.binary(), "uids": pa.binary(),
         "labels": pa.binary(), "columns": pa.binary()}
ANCHORS = {"anchor_block": pa.int64(), "a_dims": pa.int32(), "a_ids": pa.binary(), "a_uids": pa.binary(), "a_labels": pa.binary(),
           "vectors": pa.binary(), "windows": pa.list_(pa.list_(pa.int64()))}
HITS = {"anchor_uid": pa.int64(), "anchor_id": pa.int64(), "window": pa.int32(), "uid": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}


def _ddl(columns: dict) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.list_(pa.int64())): "array<array<long>>"}
    return ", ".join(f"{c} {names[t]}" for c, t in columns.items())


def usable(vector: Column, label: Column) -> Column:
    return (label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))))


def _blocked(rows: DataFrame, size: int) -> DataFrame:
    """Adds a block number to stretches of at most ``size`` rows of a partition."""
    return (rows.withColumn("_seq", F.monotonically_increasing_id())
            .withColumn("block", F.expr(f"shiftright(_seq, 33) * {1 << 20} + ((_seq & {(1 << 33) - 1}) div {size})")).drop("_seq"))


def _stretches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and (r["block"] != rows[0]["block"] or len(rows) == size):
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def quantised(rows: list[dict], scale: int) -> np.ndarray:
    """[rows, dims] of floor(scale * x), zero where a vector is shorter."""
    out = np.zeros((len(rows), max(len(r["values"]) for r in rows)))
    for i, r in enumerate(rows):
        out[i, :len(r["values"])] = r["values"]
    out = np.floor(out * scale)
    if len(out) and np.abs(out).max() >= 2.0 ** 63:
        at = int(np.abs(out).max(axis=1).argmax())
        raise OverflowError(f"vector {rows[at]['vec_id']} has a quantised component beyond a long")
    return out.astype(np.int64)


def _longs(values) -> bytes:
    return np.array(values, np.int64).tobytes()


def _index(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _stretches(batches, BLOCK):
            q = quantised(rows, scale)
            width = 4 if np.abs(q).max(initial=0) < 1 << 31 else 8
            yield pa.RecordBatch.from_pylist([{
                "block": rows[0]["block"], "n": len(rows), "dims": q.shape[1], "width": width,
                "ids": _longs([NO_ID if r["vec_id"] is None else r["vec_id"] for r in rows]), "uids": _longs([r["uid"] for r in rows]),
                "labels": _longs([r["label"] for r in rows]), "columns": np.ascontiguousarray(q.T, f"<i{width}").tobytes()}],
                pa.schema(INDEX.items()))

    return run


def _anchors(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _stretches(batches, ANCHOR_BLOCK):
            q = quantised(rows, scale)
            yield pa.RecordBatch.from_pylist([{
                "anchor_block": rows[0]["block"], "a_dims": q.shape[1], "a_ids": _longs([r["vec_id"] for r in rows]),
                "a_uids": _longs([r["uid"] for r in rows]), "a_labels": _longs([r["label"] for r in rows]), "vectors": q.tobytes(),
                "windows": [r["positive_scores"] for r in rows]}], pa.schema(ANCHORS.items()))

    return run


class Block:
    """Columns of one index block; ``scan`` runs one anchor over it."""

    def __init__(self, columns: np.ndarray):
        self.columns = columns
        self.least, self.most = columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)

    def scan(self, anchor: np.ndarray, allowed: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the allowed rows that ``prune`` leaves; it gets
        lower and upper bounds and says which candidates stay."""
        q = anchor[:len(self.columns)]
        order = np.flatnonzero(q)
        order = order[np.argsort(-np.abs(q[order].astype(float)), kind="stable")]
        reach = sum(abs(int(q[d])) * max(abs(int(self.least[d])), abs(int(self.most[d]))) for d in order)
        kind = np.int64 if reach < SAFE else object
        q = q.astype(kind)
        one, other = q[order] * self.least[order].astype(kind), q[order] * self.most[order].astype(kind)
        # what the dimensions from the j-th on can add
        low = np.append(np.cumsum(np.minimum(one, other)[::-1])[::-1], 0)
        high = np.append(np.cumsum(np.maximum(one, other)[::-1])[::-1], 0)
        rows = np.flatnonzero(allowed)
        partial = np.zeros(len(rows), kind)
        for j in range(0, len(order), STEP):
            if not len(rows):
                break
            for d in order[j:j + STEP]:
                column = self.columns[d] if len(rows) == self.columns.shape[1] else self.columns[d][rows]
                partial = partial + q[d] * column.astype(kind)
            after = min(j + STEP, len(order))
            stay = prune(partial + low[after], partial + high[after])
            if not stay.all():
                rows, partial = rows[stay], partial[stay]
        return rows, partial


def top_bound(k: int):
    """Keeps the candidates that may be among the ``k`` best."""
    def prune(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= k:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - k)[len(low) - k]

    return prune


def spans(positive_scores: list[int]) -> list[tuple[int, int]]:
    """Least and greatest score in each positive's window."""
    return [(-(-LOW * p // 100), HIGH * p // 100) for p in positive_scores]


def window_bound(windows: list[tuple[int, int]], k: int):
    """Keeps the candidates that may be among the ``k`` best of any window."""
    def prune(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for first, last in windows:
            sure = low[(low >= first) & (high <= last)]
            if len(sure) >= k:
                first = max(first, np.partition(sure, len(sure) - k)[len(sure) - k])
            stay |= (high >= first) & (low <= last)
        return stay

    return prune


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(uid, id, score) of the ``k`` first by score, then smaller id."""
    if len(rows) > k:
        ahead = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[ahead], scores[ahead]
    order = sorted(zip((-scores).tolist(), ids[rows].tolist(), uids[rows].tolist()))[:k]
    for s, i, _ in order:
        if not -(1 << 63) <= -s < 1 << 63:
            raise OverflowError(f"the score of vector {i} is beyond a long")
    return [(u, i, -s) for s, i, u in order]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                block = Block(np.frombuffer(r["columns"], f"<i{r['width']}").reshape(r["dims"], r["n"]))
                ids, uids, labels = (np.frombuffer(r[c], np.int64) for c in ("ids", "uids", "labels"))
                vectors = np.frombuffer(r["vectors"], np.int64).reshape(-1, r["a_dims"])
                place = {u: i for i, u in enumerate(uids.tolist())}
                of = zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("a_ids", "a_uids", "a_labels")))
                hits = []
                for (aid, auid, label), v, positive in zip(of, vectors, r["windows"]):
                    same = labels == label
                    if positive is None:
                        if auid in place:
                            same[place[auid]] = False
                        if same.any():
                            rows, scores = block.scan(v, same, top_bound(k))
                            hits += [(auid, aid, 0, *h) for h in best(rows, scores, ids, uids, k)]
                        continue
                    windows = spans(positive)
                    rows, scores = block.scan(v, ~same, window_bound(windows, k))
                    for w, (first, last) in enumerate(windows):
                        inside = (scores >= first) & (scores <= last)
                        if inside.any():
                            hits += [(auid, aid, w, *h) for h in best(rows[inside], scores[inside], ids, uids, k)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hits), HITS.values())], list(HITS))

    return run


def _scan(index: DataFrame, anchors: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each anchor and window over all blocks, ranked. Every
    anchor block meets every index block in an equality join on groups of index
    blocks; with few groups each is joined in several parts. The join is a merge:
    of a key only the ``GROUP`` index blocks are held, anchors pass by, and neither
    side is broadcast (Spark takes an exploded table for as small as it was)."""
    spark = index.sparkSession
    size = F.expr("CAST(n AS LONG) * dims * width").alias("bytes")
    blocks = stored(index.select(F.col("block").alias("_b"), size).withColumn("number", F.row_number().over(Window.orderBy("_b"))), "block-numbers")
    n, largest = blocks.agg(F.count(F.lit(1)), F.max("bytes")).first()
    asked = anchors.count()
    own = max(1, min(GROUP, GROUP_BYTES // max(1, largest or 0)))
    groups = max(1, -(-n // own), min(n, 2 * spark.sparkContext.defaultParallelism))
    parts = min(max(1, asked), -(-2 * spark.sparkContext.defaultParallelism // groups))
    held = (index.join(F.broadcast(blocks.select("_b", "number")), F.col("block") == F.col("_b"))  # one row of two numbers per BLOCK vectors
            .withColumn("group", F.pmod("number", F.lit(groups))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    passing = (anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
               .withColumn("part", F.pmod(F.xxhash64("anchor_block"), F.lit(parts)).cast("int")))
    pairs = (passing.join(held.hint("merge"), ["group", "part"])
             .select(*[c for c in INDEX if c != "block"], *[c for c in ANCHORS if c != "anchor_block"]))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(PAIRS_AT_ONCE))  # rows carry a block each
    hits = stored(pairs.mapInArrow(_search(k), _ddl(HITS)), "hits")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rank = F.row_number().over(Window.partitionBy("anchor_uid", "window").orderBy(F.col("score").desc(), "vec_id", "uid"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for ``vectors`` (vec_id, embedding, label); anchors are the rows where
    ``is_anchor`` (on vec_id) holds."""
    rows = (vectors.where(usable(F.col("embedding"), F.col("label")))
            .select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                    F.col("embedding").cast("array<double>").alias("values")))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    index = stored(_blocked(rows, BLOCK).mapInArrow(_index(scale), _ddl(INDEX)), "columns")
    asked = rows.where(is_anchor)

    def blocks_of(anchors: DataFrame) -> DataFrame:
        return stored(_blocked(anchors, ANCHOR_BLOCK).mapInArrow(_anchors(scale), _ddl(ANCHORS)), "anchors")

    no_windows = F.lit(None).cast("array<long>").alias("positive_scores")
    first = _scan(index, blocks_of(asked.select("*", no_windows)), positives)
    own = stored(first.groupBy("anchor_uid").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("own")), "positives")
    scores = F.transform("own", lambda p: p["score"])
    second = asked.join(own.select(F.col("anchor_uid").alias("uid"), scores.alias("positive_scores")).hint("merge"), "uid")
    found = _scan(index, blocks_of(second.select("vec_id", "label", "values", "uid", "positive_scores")), negatives)
    positive = F.element_at("own", F.col("window") + 1)
    named = lambda c: F.nullif(c, F.lit(NO_ID))
    return (found.join(own.hint("merge"), "anchor_uid")
            .select("anchor_id", named(positive["vec_id"]).alias("positive_id"), "rank", named(F.col("vec_id")).alias("negative_id"),
                    positive["score"].alias("positive_score"), F.col("score").alias("negative_score")))


def op12_negatives(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % ANCHOR_EVERY == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
