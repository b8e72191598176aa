"""Exact top-k by inner product over a bit-sliced index.

Each component x becomes the integer floor(scale * x). The index holds blocks
of ``BLOCK`` rows; in a block every bit of every component is a bitmap over the
rows (two's complement, as many slices as the block needs). For a query the
slices are added up with bitmap full adders, three bitmaps of one weight giving
one of that weight and one of the next, until each weight has one bitmap: the
slices of all rows' scores. Going down from the most significant slice, the
rows that may be among the top k are kept: candidates with the bit set if there
are at least k, else those are sure and the rest are looked into for the
missing ones. Rows equal to the k-th score at the end are the boundary rows;
the smaller ids among them win. Blocks' winners (k per query and block) are
merged by an aggregate.

Queries come in blocks of ``QUERY_BLOCK`` rows; every query block meets every
index block in a task of its own pair, so work is spread and memory is one pair.

Defined cases: vectors that are null or hold null, NaN or infinite components
take no part, neither as query nor as candidate; sums of slices are as wide as
they need to be, and a quantised component or a returned score that does not fit
a long stops the job with an error (none is clamped); a vector shorter than another is
taken as zero in the missing components; a query's own row is no candidate of
it, but other rows with its id are; rows without an id are candidates that lose
every tie; fewer than k candidates give fewer rows; an empty table gives none;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, stored, table

SCALE, TOP = 256, 5
BLOCK, QUERY_BLOCK = 1 << 15, 256
QUERY_EVERY = 50


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fits = F.forall(scaled, lambda x: (x >= -(2.0 ** 63)) & (x < 2.0 ** 63))
    q = F.when(fits, F.transform(scaled, lambda x: F.floor(x))).otherwise(F.raise_error(F.lit("a quantised component is beyond a long")))
    return F.when(ok, q)


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Numbers rows within partitions and gives each stretch of ``size`` a block
    number; blocks are as good as full but for the last of each partition."""
    return (rows.withColumn("_seq", F.monotonically_increasing_id())
            .withColumn("block", F.expr(f"shiftright(_seq, 33) * {1 << 20} + ((_seq & {(1 << 33) - 1}) div {size})")))


def slices(values: np.ndarray) -> np.ndarray:
    """[dims, bits, bytes] of two's complement slices of values [rows, dims]."""
    n, dims = values.shape
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    bits = top.bit_length() + 1  # 64 at most
    padded = np.zeros((-(-n // 64) * 64, dims), values.dtype)
    padded[:n] = values
    out = np.empty((dims, bits, len(padded) // 8), np.uint8)
    for b in range(bits):
        out[:, b] = np.packbits((padded >> b & 1).astype(np.uint8).T, axis=1, bitorder="little")
    return out


def scores(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices (64-bit words, least significant first, the last one the sign) of
    the inner product of every row with ``query``."""
    dims, bits, words = index.shape
    # |q| split into powers of two; a negative factor negates: -x = ~x + 1
    width = bits + sum(abs(int(q)) for q in query).bit_length() + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(width)]
    constant = 0
    for d in np.flatnonzero(query[:dims]):
        q = int(query[d])
        for p in range(abs(q).bit_length()):
            if abs(q) >> p & 1:
                # x = sum of slices, the top one with weight -2**(bits-1); -2**w * b = 2**w * (1-b) - 2**w
                for b in range(bits):
                    negative = (b == bits - 1) != (q < 0)
                    w = p + b
                    columns[w].append(~index[d, b] if negative else index[d, b])
                    if negative:
                        constant -= 1 << w
    full = np.full(words, ~np.uint64(0), np.uint64)
    for w in range(width):
        if constant >> w & 1:
            columns[w].append(full)
    zero = np.zeros(words, np.uint64)
    out = []
    t, u = np.empty(words, np.uint64), np.empty(words, np.uint64)
    for w in range(width):
        own, carry = columns[w], []
        while len(own) > 2:
            rest = []
            for i in range(0, len(own) - 2, 3):
                a, b, c = own[i], own[i + 1], own[i + 2]
                np.bitwise_xor(a, b, out=t)
                rest.append(np.bitwise_xor(t, c))
                np.bitwise_and(t, c, out=t)
                np.bitwise_and(a, b, out=u)
                carry.append(np.bitwise_or(t, u))
            own = rest + own[len(own) - len(own) % 3:]
        if len(own) == 2:
            carry.append(own[0] & own[1])
            own = [own[0] ^ own[1]]
        out.append(own[0] if own else zero)
        if w + 1 < width:
            columns[w + 1] = columns[w + 1] + carry
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(score: list[np.ndarray], allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, boundary) bitmaps: rows above the k-th score, rows equal to it."""
    sure, maybe, left = np.zeros_like(allowed), allowed, k
    for i, s in enumerate(reversed(score)):
        high = maybe & (~s if i == 0 else s)  # the first slice is the sign
        n = count(high)
        if n >= left:
            maybe = high
        else:
            sure, maybe, left = sure | high, maybe & ~high, left - n
    return sure, maybe


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at = np.nonzero(bits)
    return words[at[0]] * 64 + at[1]


def score_at(score: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    bits = [(s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).astype(bool) for s in score]
    wide = bits[63:] or bits[-1:]  # all equal to the sign in a score that fits
    if any((b != wide[-1]).any() for b in wide):
        raise OverflowError("a score is beyond a long")
    out = np.zeros(len(rows), np.uint64)
    for i in range(64):
        out |= bits[min(i, len(bits) - 1)].astype(np.uint64) << np.uint64(i)
    return out.view(np.int64)


INDEX_SCHEMA = "block long, n int, dims int, bits int, vec_ids binary, uids binary, slices binary"
QUERY_SCHEMA = "query_block long, dims int, query_ids binary, query_uids binary, vectors binary"
HIT_SCHEMA = "query_uid long, query_id long, uid long, vec_id long, score long"
NO_ID = np.iinfo(np.int64).max  # stands for a null id, after every other


def _grouped(batches: Iterator[pa.RecordBatch], key: str, size: int) -> Iterator[tuple[int, list]]:
    """Stretches of rows with one block number, as they lie in the partition."""
    block, rows = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if rows and (r[0] != block or len(rows) >= size):
                yield block, rows
                rows = []
            block = r[0]
            rows.append(r)
    if rows:
        yield block, rows


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(vectors), max(map(len, vectors))), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in _grouped(batches, "block", BLOCK):
        values = _matrix([r[3] for r in rows])
        s = slices(values)
        ids = np.array([NO_ID if r[1] is None else r[1] for r in rows], np.int64)
        uids = np.array([r[2] for r in rows], np.int64)
        yield pa.RecordBatch.from_pylist([{"block": block, "n": len(rows), "dims": s.shape[0], "bits": s.shape[1], "vec_ids": ids.tobytes(),
                                           "uids": uids.tobytes(), "slices": s.tobytes()}], _arrow(INDEX_SCHEMA))


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in _grouped(batches, "block", QUERY_BLOCK):
        values = _matrix([r[3] for r in rows])
        yield pa.RecordBatch.from_pylist([{"query_block": block, "dims": values.shape[1],
                                           "query_ids": np.array([r[1] for r in rows], np.int64).tobytes(),
                                           "query_uids": np.array([r[2] for r in rows], np.int64).tobytes(),
                                           "vectors": values.tobytes()}], _arrow(QUERY_SCHEMA))


def _arrow(schema: str) -> pa.Schema:
    kind = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kind[c.split()[1]]) for c in schema.split(", ")])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words = -(-r["n"] // 64)
                index = np.frombuffer(r["slices"], np.uint64).reshape(r["dims"], r["bits"], words)
                ids, uids = np.frombuffer(r["vec_ids"], np.int64), np.frombuffer(r["uids"], np.int64)
                vectors = np.frombuffer(r["vectors"], np.int64).reshape(-1, r["query_dims"])
                real = np.zeros(words * 64, np.uint8)
                real[:r["n"]] = 1
                real = np.packbits(real, bitorder="little").view(np.uint64)
                place = {u: i for i, u in enumerate(uids.tolist())}
                hits = []
                for qid, quid, v in zip(np.frombuffer(r["query_ids"], np.int64).tolist(), np.frombuffer(r["query_uids"], np.int64).tolist(), vectors):
                    allowed = real
                    if quid in place:
                        allowed = real.copy()
                        allowed[place[quid] // 64] &= ~np.uint64(1 << place[quid] % 64)
                    score = scores(index, v)
                    sure, edge = top_rows(score, allowed, k)
                    best, equal = rows_of(sure), rows_of(edge)
                    equal = equal[np.argsort(ids[equal], kind="stable")][:k - len(best)]
                    take = np.concatenate([best, equal])
                    hits += zip([quid] * len(take), [qid] * len(take), uids[take].tolist(), ids[take].tolist(), score_at(score, take).tolist())
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], [c.split()[0] for c in HIT_SCHEMA.split(", ")])

    return run


def build_index(vectors: DataFrame, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """The stored index of (vec_id, uid, values) rows: one row per block."""
    rows = blocked(vectors, block).select("block", "vec_id", "uid", "values")
    return stored(rows.mapInArrow(_build, INDEX_SCHEMA), "slices")


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of ``vectors``
    (vec_id, embedding); queries are the rows where ``is_query`` holds."""
    spark = vectors.sparkSession
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("values"))
            .where("values IS NOT NULL"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "quantised")
    index = build_index(rows)
    asked = blocked(rows.where(is_query), QUERY_BLOCK).select("block", "vec_id", "uid", "values")
    asked = stored(asked.mapInArrow(_queries, QUERY_SCHEMA), "query-blocks").withColumnRenamed("dims", "query_dims")
    blocks = stored(index.select("block").withColumn("number", F.row_number().over(Window.orderBy("block"))), "block-numbers")
    n, asked_n = blocks.count(), asked.count()
    if not n or not asked_n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # every query block goes to every index block: numbers are dense, so the pairs
    # are an equality join; with few index blocks each is joined in several groups
    groups = min(asked_n, max(1, -(-2 * spark.sparkContext.defaultParallelism // n)))
    left = (index.join(F.broadcast(blocks), "block")  # one row of two numbers per BLOCK vectors
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = (asked.withColumn("number", F.explode(F.sequence(F.lit(1), F.lit(n))))
             .withColumn("part", F.pmod(F.xxhash64("query_block"), F.lit(groups)).cast("int")))
    pairs = left.join(right, ["number", "part"]).select("n", "dims", "bits", "vec_ids", "uids", "slices", "query_dims",
                                                        "query_ids", "query_uids", "vectors")
    hits = pairs.mapInArrow(_search(k), HIT_SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_uid").orderBy(F.col("score").desc(), "vec_id", "uid"))
    return (hits.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score"))


def op9_bitsliced(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
