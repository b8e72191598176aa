"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every byte triplet inside a window of four bytes (three kinds, hashed apart) is
counted in one of 256 buckets. Each bucket is coded by the quartile of the
document's counts it falls in (2 bits); the head holds the logarithm of the
length and the quartiles' ratios. Two digests differ by the steps between their
bucket codes plus bounded terms for length and ratios; likeness is 1 minus that
difference over its greatest value.

``neighbours`` pairs each row with the next one in descending order of id
(after the last: the first): rows are dealt by id ranges, ordered inside, and
the first row of each range is also sent to the range before it, so texts are
shuffled once and no task sees more than its range.

Defined cases: null text counts as empty; an empty text has a digest of zeros;
texts shorter than a triplet have only their length; equal ids are ordered by
text; null ids come last; a single row is its own next; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, small, stored, table, text_col

BUCKETS = 256
RANGES_PER_PARTITION = 1
LENGTH_MOST, RATIO_MOST, STEP = 24, 15, 4
# Greatest difference: every bucket three steps apart, length and both ratios at their bounds.
GREATEST = BUCKETS * 3 + STEP * (LENGTH_MOST + 2 * RATIO_MOST)
# The triplets of a window of four bytes that hold its first one, each with its own multipliers.
TRIPLETS = (((0, 1, 2), (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), ((0, 1, 3), (0x27D4EB2F, 0x165667B1, 0xD3A2646D)),
            ((0, 2, 3), (0xFD7046C5, 0xB55A4F09, 0x8DA6B343)))


def bucket_counts(data: np.ndarray) -> np.ndarray:
    counts = np.zeros(BUCKETS, np.int64)
    x = data.astype(np.uint32)
    for places, mult in TRIPLETS:
        n = len(x) - places[-1]
        if n <= 0:
            continue
        h = sum(x[p:p + n] * np.uint32(m) for p, m in zip(places, mult))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def digest(data: bytes) -> str:
    """Length code (1 byte), two quartile ratios (1 byte), 64 bytes of bucket
    codes, in hex. Equal bytes have equal digests."""
    counts = bucket_counts(np.frombuffer(data, np.uint8))
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = int(4 * np.log2(1 + len(data)))
    ratio = [int(16 * q // max(1, q3)) if q < q3 else RATIO_MOST for q in (q1, q2)] if q3 else [0, 0]
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return bytes([min(length, 255), ratio[0] << 4 | ratio[1]]).hex() + packed.astype(np.uint8).tobytes().hex()


_BITS = np.array([[b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6] for b in range(256)], np.int16)


def _parts(d: str) -> tuple[int, int, int, np.ndarray]:
    b = bytes.fromhex(d)
    return b[0], b[1] >> 4, b[1] & 15, _BITS[np.frombuffer(b, np.uint8, offset=2)].ravel()


def difference(a: str, b: str) -> int:
    la, pa_, qa, xa = _parts(a)
    lb, pb, qb, xb = _parts(b)
    return int(np.abs(xa - xb).sum()) + STEP * (min(abs(la - lb), LENGTH_MOST) + abs(pa_ - pb) + abs(qa - qb))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / GREATEST


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many of
    the following text's first, or all of them."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [digest(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(docs["doc_id"].cast("long"), text_col().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def id_ranges(ids: DataFrame, parts: int) -> list[int]:
    """Bounds of about equal ranges of ids (a sketch; ``parts`` numbers)."""
    shares = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)) if shares else F.lit(0.5), 10_000)).first()[0]
    return sorted(set(found if isinstance(found, list) else [])) if found is not None else []


def range_of(ids: Column, bounds: list[int]) -> Column:
    """0 for the largest ids, counting up as they fall; null ids at the end."""
    at = F.lit(len(bounds) + 1)
    if bounds:
        # bounds are at most as many as partitions; a binary search over them
        def search(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(len(bounds) - lo)
            mid = (lo + hi) // 2
            return F.when(ids <= F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

        return F.when(ids.isNull(), at).otherwise(search(0, len(bounds)))
    return F.when(ids.isNull(), at).otherwise(F.lit(0))


PAIR_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, text, _range, _lead): every row in its range, and the first
    row of each range that has rows again in the range before it that has rows
    (the first of all in the last one), marked by ``_lead``."""
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_col().alias("text"))
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = id_ranges(own.select("doc_id"), parts * RANGES_PER_PARTITION)
    own = own.withColumn("_range", range_of(F.col("doc_id"), bounds).cast("int"))
    # the first row of a range: greatest id, then greatest MD5 of the text among its equals
    heads = own.groupBy("_range").agg(F.max(F.struct("doc_id", F.md5("text").alias("m"))).alias("top"))
    heads = stored(heads.select("_range", "top.*"), "range-heads")
    order = Window.orderBy("_range")  # one row per range, of which there are as many as partitions
    first = heads.agg(F.max("_range")).first()[0]
    leads = heads.select(F.col("_range").alias("_r"), F.col("doc_id").alias("_d"), F.col("m").alias("_m"),
                         F.coalesce(F.lag("_range").over(order), F.lit(first)).cast("int").alias("_to"))
    sent = (own.join(F.broadcast(leads), F.expr("_range = _r AND doc_id <=> _d"))
            .where(F.md5("text") == F.col("_m")).dropDuplicates(["_to"])
            .select("doc_id", "text", F.col("_to").alias("_range")).withColumn("_lead", F.lit(True)))
    return own.withColumn("_lead", F.lit(False)).unionByName(sent)


def edit_pairs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's and its edited text's fingerprint and their likeness."""
    rows = neighbours(docs, parts)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (rows.repartitionById(max(n, 1), F.col("_range"))
              .sortWithinPartitions("_range", "_lead", F.col("doc_id").desc_nulls_last(), F.md5("text").desc()))

    def row(doc_id, text: str, fp: str, following: str, next_fp: str) -> tuple:
        new = edited(text, following).encode()
        new_fp = digest(new)
        return (doc_id, len(text), hashlib.sha256(new).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, next_fp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, fingerprint) waiting for the next row
        names = [c.split()[0] for c in PAIR_SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in PAIR_SCHEMA.split(", ")]
        for b in batches:
            out = []
            for doc_id, text, rng, lead in zip(*[c.to_pylist() for c in b.columns]):
                fp = digest(text.encode())
                if held and held[0] == rng:
                    out.append(row(*held[1:], text, fp))
                held = None if lead else (rng, doc_id, text, fp)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return spread.select("doc_id", "text", "_range", "_lead").mapInArrow(run, PAIR_SCHEMA)


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return edit_pairs(table(spark, sf_dir, "documents"))
