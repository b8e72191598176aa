"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, shared_dir, ship_code

# Bytes of a stored table that may be broadcast; larger ones are shuffled. Stored
# ids and hashes hardly shrink, so the hashed relation is a few times this.
BROADCAST_BYTES = 8 << 20
CHUNK_BYTES = 1 << 20
KEPT_POWERS = (2 << 20) + (1 << 18)

U64 = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def prepare(spark: SparkSession) -> None:
    """Ship the package, set the shared folder, keep Arrow batches small enough
    for rows that carry whole texts, and drop shuffle files after each execution."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    # intermediate tables are stored, so no shuffle is read by a later execution
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    ship_code(spark)
    shared_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the cluster's shared folder and read back, so a
    lost executor costs a reread and no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression="zstd")  # its buffers are pooled; those of Snappy stay in direct memory
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_path)
    hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint for a stored table whose files are within
    ``BROADCAST_BYTES``; of anything else Spark decides by its own statistics
    (and splits skewed partitions where it shuffles)."""
    path = getattr(df, "_stored_path", None)
    if path is None:
        return df
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return F.broadcast(df) if files.getContentSummary(hadoop).getLength() <= BROADCAST_BYTES else df


SIFT_BITS = 1 << 26  # 8 MB, whatever the number of keys


def sieve(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with a column ``_hit``: whether their ``columns`` may be those of
    a row of ``keys``. A bitmap of ``SIFT_BITS`` hashed places, broadcast as 4 KB
    pieces, so that rows without a hit need not take part in the shuffle of the
    exact join that has to follow."""
    place = F.pmod(F.xxhash64(*columns), F.lit(SIFT_BITS))
    piece, bit = F.shiftright(place, 15).alias("_piece"), place.bitwiseAND(32767).alias("_bit")
    pieces = stored(keys.select(piece, bit).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
                    .withColumnRenamed("_piece", "_p"), "sieve")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    here = F.expr("_bit & 7").cast("int")
    return (rows.select("*", piece, bit).join(F.broadcast(pieces), F.col("_piece") == F.col("_p"), "left")
            .select(*rows.columns, F.coalesce(F.getbit(byte, here) == 1, F.lit(False)).alias("_hit")))


def sifted(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows that ``sieve`` lets through."""
    return sieve(rows, keys, columns).where("_hit").drop("_hit")


def aside(df: DataFrame) -> list[Column]:
    """All columns under names that no operator uses; ``back`` restores them."""
    return [F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(df.columns)]


def back(df: DataFrame, **changed: Column) -> list[Column]:
    return [changed.get(c, F.col(f"_in{i}")).alias(c) for i, c in enumerate(df.columns)]


def text_col(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, KEPT_POWERS)
        if size > KEPT_POWERS:  # a very long text: not kept for the next batch
            return tuple(_cumprod(p, size) for p in (_P, _PINV))
        _POWERS[:] = [_cumprod(p, size) for p in (_P, _PINV)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _cumprod(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array without nulls, and where each text begins
    (one more entry for the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``most`` bytes of the column (one row at least)."""
    _, at = raw(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes lo[i] to hi[i] (at least one) of ``data``."""
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(U64) * U64(0xD1B54A32D192ED03))


def words(texts: pa.Array, spelled: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than ASCII white space) of every text, bytes
    first replaced by ``spelled`` (256 entries) if given.

    Returns 64-bit hashes in order, where each text's words begin (one more
    entry for the end), and each word's first byte and byte after it, counted
    from its own text's beginning."""
    data, at = raw(texts)
    n = len(data)
    if spelled is not None:
        data = spelled[data]
    if not n:
        return np.zeros(0, U64), np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[at] = True  # a word never runs on into the next text
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = span_hashes(data, lo, hi)
    doc = np.searchsorted(lo, at)
    base = np.repeat(at[:-1], np.diff(doc))
    return hashes, doc, lo - base, hi - base


def shingles(hashes: np.ndarray, doc: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of ``size`` words in a row; a text of fewer words (but one at
    least) is one shingle. Returns the hashes, where each text's shingles begin
    (one more entry for the end), and the index of each shingle's first word."""
    count = np.diff(doc)
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    begin = np.zeros(len(doc), np.int64)
    np.cumsum(made, out=begin[1:])
    where = np.arange(begin[-1]) + np.repeat(doc[:-1] - begin[:-1], made)
    if not len(where):
        return np.zeros(0, U64), begin, where
    padded = np.concatenate([hashes, np.zeros(size, U64)])
    acc = np.zeros(len(hashes) + 1, U64)[:len(hashes)]
    for j in range(size):
        acc = acc * U64(_P) + padded[j:j + len(hashes)]
    out = acc[where]
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = padded[doc[d]:doc[d + 1]]
        h = 0
        for j in range(size):
            h = (h * _P + (int(own[j]) if j < len(own) else 0)) % (1 << 64)
        out[begin[d]] = h
    return mix(out), begin, where


def distinct_sorted(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct values in order, where they begin, how often each occurs."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(v)))
    return v[at], np.searchsorted(d[at], np.arange(n + 1)), count
