"""Near duplicates by ProbMinHash, banding and exact verification.

A document's elements are its distinct shingles of five words (lower case,
split at ASCII white space; a shorter text is one shingle). A shingle weighs 1,
and up to ``HEAVIEST`` as it is repeated, so that what a text keeps saying counts
more, but not without bound. Each element is a Poisson process with its weight
as rate: its arrivals, exponential steps seeded by the shingle, each fall on one
of M places; a place keeps the element that arrives first. An element stops as
soon as its next arrival is later than the last of its document's kept ones. Two
documents agree at a place with the probability Jaccard similarity of their
weights.

M places are cut into bands; texts that share a band meet in its bucket. Buckets
with the same members count once. A bucket's members are compared in one go, by
their whole shingle sets, as rows of an incidence matrix times its transpose,
and yield the links of a spanning forest, never pairs. A bucket of more than
``BLOCK_ROWS`` members or ``BLOCK_BYTES`` of sets is dealt into blocks. What the
blocks find makes classes first; then the members outside the bucket's largest
class are compared with all of the bucket, block by block, so that no link
between two classes is lost and the texts of one class are not compared again.
(A large bucket of texts that are all unlike each other is compared in full.)

Verification is exact: Jaccard similarity of the shingle sets of at least 0.8,
whatever the weights. Classes are the connected components of verified links.
Texts that are equal byte by byte are one node throughout.

Defined cases: null texts are never alike; equal texts (empty ones too) are
copies; texts without words are alike only if equal; repeated rows are copies;
the class id is the least doc_id in the class (null if all are null); rows with
the same doc_id and other text are different texts; an empty table gives no
rows; other columns are kept by ``keep_one`` and ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, aside, back, chunks, distinct_sorted, mix, prepare, shingles, sieve, sifted, small, stored, table, words
from .links import components

SHINGLE, SIMILARITY = 5, 0.8
PLACES, ROWS = 168, 6  # 28 bands of 6: at 0.8, 0.9998 of pairs share one; at 0.3, 0.02
# With weights of 1 to 1.25, sets of Jaccard 0.8 have a probability Jaccard of 0.76 at least if shared shingles are
# repeated equally (0.997 share a band), and of 0.69 if half of them are repeated in one text only and half in the other (0.96).
HEAVIEST = 1.25
BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20  # of a bucket in one comparison
CELLS = 1 << 22  # of the incidence matrix at a time
PIVOTS = 4  # texts of each class of a bucket that meet first; four times as many in each further round


def prob_minhash(values: np.ndarray, weights: np.ndarray, begin: np.ndarray, places: int = PLACES) -> np.ndarray:
    """[texts, places] of the elements that arrive first. ``values`` are each
    text's distinct elements; texts without any keep zeros."""
    n = len(begin) - 1
    doc = np.repeat(np.arange(n), np.diff(begin))
    first = np.full(n * places, np.inf)
    who = np.zeros(n * places, U64)
    live = np.arange(len(values))
    at = np.zeros(len(values))
    step = 0
    while len(live):
        step += 1
        seed = mix(values[live] + U64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        unit = ((seed >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
        at[live] -= np.log(unit) / weights[live]
        key = doc[live] * places + ((mix(seed) >> U64(32)) * U64(places) >> U64(32)).astype(np.int64)
        now = at[live]
        early = now < first[key]
        key, now, src = key[early], now[early], live[early]
        np.minimum.at(first, key, now)
        best = now == first[key]
        who[key[best]] = values[src[best]]
        last = first.reshape(n, places).max(axis=1)
        live = live[at[live] < last[doc[live]]]
    return who.reshape(n, places)


def weights(count: np.ndarray) -> np.ndarray:
    """1 for a shingle that occurs once, towards ``HEAVIEST`` for repeated ones."""
    return HEAVIEST - (HEAVIEST - 1) / count


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, places = signature.shape
    bands = signature.reshape(n, places // rows, rows)
    acc = np.broadcast_to(np.arange(1, places // rows + 1, dtype=U64) * U64(0x9E3779B97F4A7C15), (n, places // rows)).copy()
    for r in range(rows):
        acc = mix(acc ^ bands[:, :, r]) + U64(r + 1)
    return acc


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            w, doc, _, _ = words(part.column("text"))
            s, begin, _ = shingles(w, doc, SHINGLE)
            values, begin, count = distinct_sorted(s, begin)
            bands = band_hashes(prob_minhash(values, weights(count), begin)).astype("<i8")
            n = np.diff(begin)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("md5"), pa.array([b.tobytes() if h else b"" for b, h in zip(bands, n)], pa.binary()),
                 pa.array(n, pa.int64())], ["doc_id", "md5", "bands", "size"])


def _band_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [np.frombuffer(x, "<i8") for x in b.column("bands").to_pylist()]
        n = [len(x) for x in lists]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(b.column("uid").to_numpy(zero_copy_only=False), n), pa.int64()),
             pa.array(np.repeat(b.column("size").to_numpy(zero_copy_only=False), n), pa.int64()),
             pa.array(np.concatenate(lists) if lists else [], pa.int64())], ["uid", "size", "bucket"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            w, doc, _, _ = words(part.column("text"))
            s, begin, _ = shingles(w, doc, SHINGLE)
            values, begin, _ = distinct_sorted(s, begin)
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), pa.array([values[a:b].tobytes() for a, b in zip(begin, begin[1:])], pa.binary())], ["uid", "set"])


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        like = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            both = len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True))
            like.append(both / max(1, (len(x) + len(y)) // 8 - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(like, pa.float64())], ["a", "b", "like"])


def text_key():
    return F.md5("text")


def restrict(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(uid, text) of the texts named by ``keys`` (uid, md5), each once: one row
    of docs per (doc_id, md5) stands for it."""
    rows = sifted(docs.select("doc_id", "text", text_key().alias("md5")), keys, ["doc_id", "md5"])
    keys = keys.withColumnsRenamed({"doc_id": "_d", "md5": "_m"})
    return rows.join(keys, F.expr("doc_id <=> _d AND md5 = _m")).select("uid", F.lower("text").alias("text"))


def measure(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, like) of pairs; a pivot's set goes to as many tasks as its pairs
    are split into."""
    x = sets.select(F.col("uid").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("uid").alias("b"), F.col("set").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(_likeness, "a long, b long, like double")


def verified(buckets: DataFrame, sets_of, least: float = SIMILARITY, measure=measure, stretches_of=None) -> DataFrame | None:
    """Links (a, b, like, ...) between the members of ``buckets`` (bucket, uid, and
    ``at``, the member's place, if ``stretches_of`` gives the places that links
    cover); ``sets_of`` gives what ``measure`` compares. None if no bucket has two
    members.

    A pair of one bucket's members stays untested only if its texts are in one
    class by other links and both places are covered (without places: both texts
    have a link), so classes and covered places are those of all pairs."""
    places = stretches_of is not None
    at = F.col("at").cast("int") if places else F.lit(0)
    buckets = buckets.select("bucket", "uid", at.alias("at"))
    # buckets with the same members at the same places (told by their number and two sums
    # of hashes) ask for the same pairs: one of them stands for all
    per = (buckets.groupBy("bucket").agg(F.min("uid").alias("pivot"), F.max("uid").alias("_last"), F.count(F.lit(1)).alias("n"),
                                         F.bit_xor(F.xxhash64("uid", "at")).alias("x"), F.bit_xor(F.xxhash64("uid", "at", F.lit(1))).alias("y"))
           .where("pivot != _last"))
    first = stored(per.groupBy("pivot", "n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "pivot"), "pivots")
    members = stored(buckets.join(small(first.select("bucket")), "bucket").select("bucket", "uid", "at"), "members")
    if not members.limit(1).count():
        return None
    sets = sets_of(members.select("uid").distinct())
    tested, used, most = None, None, 1
    pivots, open_ = first, members  # open: neither a pivot of its bucket nor covered
    while True:
        pairs = members.join(small(pivots), "bucket").where("uid != pivot").select(*_pair("uid", "pivot")).distinct()
        new = new_tests(tested, pairs, sets, measure)
        tested = new if tested is None else tested.unionByName(new)
        used = pivots if used is None else used.unionByName(pivots)
        near = new.where(F.col("like") >= least)
        covered = merged(stretches_of(near) if places else _whole(near))
        open_ = open_.join(pivots.select(F.col("bucket").alias("_b"), "pivot"), F.expr("bucket = _b AND uid = pivot"), "left_anti")
        open_ = stored(open_.join(covered, F.expr("uid = _u AND at BETWEEN first AND last"), "left_anti"), "uncovered")
        order = F.row_number().over(Window.partitionBy("bucket").orderBy("uid"))
        pivots = open_.select("bucket", "uid").distinct().withColumn("k", order).where(F.col("k") <= most)
        pivots = stored(pivots.select("bucket", F.col("uid").alias("pivot")), "pivots")
        if not pivots.limit(1).count():
            break
        most *= 4  # one, four, sixteen: texts that are like none of the pivots are taken faster and faster
    # a pivot has met all of its bucket; the others, all covered, have to meet those of other classes
    rest = members.select("bucket", "uid").distinct().join(used.select(F.col("bucket").alias("_b"), "pivot"),
                                                           F.expr("bucket = _b AND uid = pivot"), "left_anti")
    rest, label, most = stored(rest, "no-pivots"), None, PIVOTS
    while True:
        if label is None:
            label = components(tested.where(F.col("like") >= least))
        pairs, whole = crossing(tested, rest, most, label)
        if pairs is not None:
            new = new_tests(None, pairs, sets, measure)
            tested = tested.unionByName(new)
            label = None if new.where(F.col("like") >= least).limit(1).count() else label
        if whole and label is not None:
            return tested.where(F.col("like") >= least)
        most *= 4


def _pair(one: str, other: str) -> list:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _whole(near: DataFrame) -> DataFrame:
    """The one place of texts without places, of those with a link."""
    return near.select("a").union(near.select("b")).select(F.col("a").alias("uid"), F.lit(0).alias("first"), F.lit(0).alias("last"))


def merged(stretches: DataFrame) -> DataFrame:
    """(_u, first, last): the places in any of the ``stretches`` (uid, first,
    last), as stretches that don't meet."""
    own = stretches.groupBy(F.col("uid").alias("_u"), "first").agg(F.max("last").alias("last"))  # at most one a place
    line = Window.partitionBy("_u").orderBy("first")
    before = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_new", F.when(before >= F.col("first") - 1, 0).otherwise(1))
    own = own.withColumn("_part", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return own.groupBy("_u", "_part").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("_u", "first", "last")


def new_tests(tested: DataFrame | None, pairs: DataFrame, sets: DataFrame, measure) -> DataFrame:
    """The pairs that are not in ``tested`` yet, measured."""
    if tested is not None:
        pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    return stored(measure(pairs, sets), "tested")


def crossing(tested: DataFrame, members: DataFrame, most: int, label: DataFrame) -> tuple[DataFrame | None, bool]:
    """Untested pairs of a bucket's members (bucket, uid) in different classes, of
    each class ``most`` texts. A text outside the bucket's largest class meets
    all the others. (None if there are none, whether no class had more texts.)"""
    classed = members.join(small(label), F.col("uid") == F.col("node")).select("bucket", "uid", "label")
    sizes = classed.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy(F.col("bucket").alias("_b")).agg(F.max(F.struct("n", "label")).alias("_top"), F.count(F.lit(1)).alias("_classes"))
             .where("_classes > 1").select("_b", F.col("_top.label").alias("_largest"), F.col("_top.n").alias("_n")))
    mixed = stored(mixed, "mixed-buckets")
    if not mixed.limit(1).count():
        return None, True
    order = F.row_number().over(Window.partitionBy("bucket", "label").orderBy("uid"))
    few = classed.join(small(mixed), F.col("bucket") == F.col("_b")).withColumn("k", order).where(F.col("k") <= most)
    few = stored(few.select("bucket", "uid", "label", "_largest"), "classed")
    others = few.select(F.col("bucket").alias("_b"), F.col("uid").alias("_u"), F.col("label").alias("_l"))
    pairs = (few.where("label != _largest").join(others, F.expr("bucket = _b AND label != _l"))
             .select(*_pair("uid", "_u")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    pairs = stored(pairs, "crossing-pairs")
    return (pairs if pairs.limit(1).count() else None), mixed.agg(F.max("_n")).first()[0] <= most


def shared(sets: list[np.ndarray], rows: int | None = None) -> np.ndarray:
    """[rows, sets] numbers of elements that the first ``rows`` sets (all, if
    not given) and every set have in common; the elements of a set are distinct."""
    rows = len(sets) if rows is None else rows
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, element, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1  # elements of one set only are in no two
    keep = times[element] > 1
    own, element = own[keep], column[element[keep]]
    order = np.argsort(element, kind="stable")
    own, element = own[order], element[order]
    out = np.zeros((rows, len(sets)))
    wide = max(1, CELLS // len(sets))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(element, [first, first + wide])
        matrix = np.zeros((len(sets), wide), np.float32)
        matrix[own[a:b], element[a:b] - first] = 1
        out += matrix[:rows] @ matrix.T
    return out


def alike(sets: list[np.ndarray], rows: int | None = None) -> np.ndarray:
    """Jaccard similarities, as ``shared``."""
    both, n = shared(sets, rows), np.array([len(x) for x in sets], float)
    return both / np.maximum(1, n[:len(both), None] + n[None, :] - both)


def forest(like: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Links (i, j, similarity) of a spanning forest of those of ``least`` or more."""
    out, new = [], np.ones(len(like), bool)
    for start in range(len(like)):
        if not new[start]:
            continue
        new[start], ahead = False, [start]
        while ahead:
            i = ahead.pop()
            for j in np.flatnonzero((like[i] >= least) & new).tolist():
                new[j] = False
                out.append((i, j, float(like[i, j])))
                ahead.append(j)
    return out


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The rows of one combination of keys after the other (sorted input)."""
    held: dict[str, list] = {}
    key = None
    for b in batches:
        columns = {c: b.column(c).to_pylist() for c in b.schema.names}
        own = list(zip(*(columns[c] for c in keys)))
        at = 0
        while at < len(own):
            end = at
            while end < len(own) and own[end] == own[at]:
                end += 1
            if own[at] != key:
                if held:
                    yield held
                held, key = {c: [] for c in columns}, own[at]
            for c, v in columns.items():
                held[c] += v[at:end]
            at = end
    if held:
        yield held


LINKS = "a long, b long, like double"


def _links(found: list[tuple[int, int, float]]) -> pa.RecordBatch:
    a, b, like = zip(*((max(x, y), min(x, y), v) for x, y, v in found))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], ["a", "b", "like"])


def _block_links(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _stretches(batches, ["bucket", "part"]):
            uid = block["uid"]
            if len(uid) > 1:
                found = forest(alike([np.frombuffer(x, U64) for x in block["set"]]), least)
                if found:
                    yield _links([(uid[i], uid[j], v) for i, j, v in found])

    return run


def _class_links(least: float):
    """Links that join two classes: rows with ``side`` 0 (outside the largest
    class) against all of the other block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _stretches(batches, ["bucket", "i", "j"]):
            side, uid, label = np.array(block["side"]), block["uid"], np.array(block["label"])
            few = int((side == 0).sum())
            if not few or few == len(uid):
                continue
            like = alike([np.frombuffer(x, U64) for x in block["set"]], few)[:, few:]
            like[label[:few, None] == label[None, few:]] = 0
            # of the links between two classes one is enough
            at = np.argwhere(like >= least)
            seen, found = set(), []
            for x, y in at.tolist():
                pair = (min(label[x], label[few + y]), max(label[x], label[few + y]))
                if pair not in seen:
                    seen.add(pair)
                    found.append((uid[x], uid[few + y], float(like[x, y])))
            if found:
                yield _links(found)

    return run


def bucket_links(members: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame | None:
    """Links (a, b, like) that connect, in every bucket, all that is connected
    by pairs of ``least`` or more. ``members``: bucket, uid, size (elements of
    the set); ``sets``: uid, set. None if there are no links."""
    spark = members.sparkSession
    per = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    per = stored(per.select(F.col("bucket").alias("_b"), parts.alias("parts")), "bucket-parts")
    dealt = (members.select("bucket", "uid").join(per, F.col("bucket") == F.col("_b"))
             .select("bucket", "uid", "parts", F.pmod(F.xxhash64("uid"), "parts").alias("part")))
    rows = dealt.join(sets, "uid").select("bucket", "part", "uid", "set")
    rows = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "uid")
    links = stored(rows.mapInArrow(_block_links(least), LINKS).distinct(), "links")
    wide = per.where("parts > 1")
    if not wide.limit(1).count():
        return links if links.limit(1).count() else None
    label = components(links).withColumnRenamed("node", "_u") if links.limit(1).count() else None
    inside = dealt.join(wide.select("_b"), F.col("bucket") == F.col("_b"), "left_semi")
    if label is None:
        inside = inside.withColumn("label", F.col("uid"))
    else:
        inside = inside.join(label, F.col("uid") == F.col("_u"), "left").withColumn("label", F.coalesce("label", "uid")).drop("_u")
    inside = stored(inside, "wide-buckets")
    largest = (inside.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("bucket").alias("_b"))
               .agg(F.max(F.struct("n", "label"))["label"].alias("_largest"), F.sum("n").alias("_n")))
    sized = inside.join(largest, F.col("bucket") == F.col("_b"))
    few = (sized.where("label != _largest").select("bucket", "uid", "label", "parts")
           .join(sized.where("label != _largest").groupBy(F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_few")),
                 F.col("bucket") == F.col("_b")))
    blocks = F.ceil(F.col("_few") / BLOCK_ROWS).cast("int")
    asked = few.select("bucket", "uid", "label", F.lit(0).alias("side"), F.pmod(F.xxhash64("uid", F.lit(1)), blocks).cast("int").alias("i"),
                       F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    others = (inside.join(few.select(F.col("bucket").alias("_b"), blocks.alias("_blocks")).distinct(), F.col("bucket") == F.col("_b"))
              .select("bucket", "uid", "label", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("i"),
                      F.col("part").cast("int").alias("j")))
    rows = asked.unionByName(others).join(sets, "uid").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side", "uid")
    more = stored(rows.select("bucket", "i", "j", "side", "uid", "label", "set").mapInArrow(_class_links(least), LINKS).distinct(), "class-links")
    links = links.unionByName(more)
    return links if links.limit(1).count() else None


def bucket_members(buckets: DataFrame) -> DataFrame | None:
    """Rows of ``buckets`` (bucket, uid, ...) in buckets of two members or more;
    of buckets with the same members (told by their number and two sums of
    hashes) one. None if there are none."""
    per = buckets.groupBy("bucket").agg(F.min("uid").alias("pivot"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("uid")).alias("x"),
                                        F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("y")).where("n > 1")
    first = stored(per.groupBy("pivot", "n", "x", "y").agg(F.min("bucket").alias("_b")).select("_b"), "shared-buckets")
    members = stored(buckets.join(first, F.col("bucket") == F.col("_b"), "left_semi"), "members")
    return members if members.limit(1).count() else None


def copies_and_classes(docs: DataFrame) -> DataFrame:
    """(md5, class_id, kept_md5) of every text that has a copy or near copy."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("md5"), F.lower("text").alias("text")).where("md5 IS NOT NULL")
    rows = rows.mapInArrow(_signatures, "doc_id long, md5 string, bands binary, size long")
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "signatures")
    texts = stored(rows.groupBy("md5").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "texts")
    nodes = rows.join(texts.select("uid"), "uid")
    buckets = stored(nodes.select("uid", "size", "bands").mapInArrow(_band_list, "uid long, size long, bucket long"), "buckets")
    near = None
    members = bucket_members(buckets)
    if members is not None:
        keys = stored(rows.select("uid", "doc_id", "md5").join(members.select("uid").distinct(), "uid"), "set-keys")
        found = restrict(docs.withColumn("doc_id", F.col("doc_id").cast("long")), keys).mapInArrow(_sets, "uid long, set binary")
        sets = stored(found, "sets")
        near = bucket_links(members, sets.dropDuplicates(["uid"]) if has_repeats(rows) else sets)
    grouped = texts.select("md5", "uid", "least", "n")
    if near is None:
        return grouped.where("n > 1").select("md5", F.col("least").alias("class_id"), F.col("md5").alias("kept_md5"))
    labels = components(near)
    grouped = (grouped.join(small(labels), F.col("uid") == F.col("node"), "left")
               .where("n > 1 OR label IS NOT NULL").withColumn("label", F.coalesce("label", "uid")))
    grouped = stored(grouped.select("md5", "label", "least"), "grouped")
    kept = grouped.groupBy("label").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "md5")).alias("k"))
    kept = stored(kept.select("label", F.col("k.least").alias("class_id"), F.col("k.md5").alias("kept_md5")), "kept")
    return grouped.join(small(kept), "label").select("md5", "class_id", "kept_md5")


def has_repeats(rows: DataFrame) -> bool:
    """Whether any (doc_id, text) occurs in more than one row."""
    return rows.groupBy("doc_id", "md5").count().where("count > 1").limit(1).count() > 0


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and whether the row's text
    is the one kept, for every row."""
    found = stored(copies_and_classes(docs), "near-classes").withColumnRenamed("md5", "_m")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("md5"))
    return (rows.join(small(found), F.col("md5") == F.col("_m"), "left")
            .select("doc_id", F.when(F.col("_m").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.when(F.col("_m").isNull(), F.lit(True)).otherwise(F.expr("md5 = kept_md5 AND doc_id <=> class_id")).alias("kept")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all columns; rows without copies pass as they are.

    What goes is decided on ids and text keys; of the rows themselves only those
    that may go, or that are repeated, are shuffled."""
    found = stored(copies_and_classes(docs), "near-classes").withColumnsRenamed({"md5": "_m", "class_id": "_c", "kept_md5": "_k"})
    narrow = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_md5")).where("_md5 IS NOT NULL")
    narrow = narrow.groupBy("_id", "_md5").agg(F.count(F.lit(1)).alias("_n")).join(small(found), F.col("_md5") == F.col("_m"))
    special = narrow.select("_id", "_md5", F.expr("_md5 = _k AND _id <=> _c").alias("_stays"), "_n").where("NOT _stays OR _n > 1")
    special = stored(special.select(F.col("_id").alias("_d"), F.col("_md5").alias("_t"), "_stays"), "near-special")
    rows = docs.select(*aside(docs), text_key().alias("_md5"), F.col("doc_id").cast("long").alias("_id"))
    marked = sieve(rows, special.select(F.col("_d").alias("_id"), F.col("_t").alias("_md5")), ["_id", "_md5"])
    hit = marked.where("_hit").join(special, F.expr("_id <=> _d AND _md5 = _t"), "left")
    passing = marked.where("NOT _hit").select(*back(docs)).unionByName(hit.where("_t IS NULL").select(*back(docs)))
    return passing.unionByName(hit.where("_stays").dropDuplicates(["_id", "_md5"]).select(*back(docs)))


def op7_neardup(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return classes(table(spark, sf_dir, "documents"))
