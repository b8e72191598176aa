"""Spelling variants grouped by a variable-length gram index.

Words are runs of letters of whole texts, counted. Two words are near if one
inserted, deleted or replaced code point tells them apart. Near words come from
an index of variable grams:

- Dictionary: grams of ``SHORTEST`` code points on that are in more places of
  the vocabulary than ``_bound`` allows are split, that is replaced by their
  extensions; a rare gram stays short. Only the split grams are kept: of each
  length at most ``DICTIONARY``, whatever the vocabulary's size.
- Decomposition: at every place of a word begins one gram, the shortest one that
  is not split, of at most half the word (``_most``), so no gram is a prefix of
  another one and a gram depends on its own code points only.
- Affected grams: an edit touches the grams whose stretch holds its place. A set
  of grams of which one edit can touch all but one at most has a shared gram with
  every near word. As stretches that meet pairwise have a place in common, the
  least such sets are two grams that don't overlap, and every word has such two;
  it looks up the two with the shortest lists.
- Merging: lists are kept by gram, place and word length, so that a word of n
  code points reads those of length n at the gram's own place and those of
  n + 1 at its place and the next. The join of lists tells which words are near
  before it makes a row: hashes of the words' halves, one of which an edit leaves
  as it is, then the exact distance. No table that grows with the vocabulary is
  broadcast, whatever Spark takes its size for.

List lengths are estimated in ``COUNTERS`` hashed counters; they only decide
which of the complete pairs of grams is taken. A word's form is its near word
with the greatest count, if that is ``LEAD`` times its own; counts double along
a chain of forms at least, so roots are found by pointer doubling in a few joins.

Defined cases: null and empty texts have no words; a null doc_id is written as
nothing before the colon; repeated rows count each time; ties between near words
go to the smaller one in code-point order; words of any length take part; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, table

MIN_LENGTH, MIN_COUNT, LEAD = 5, 3, 2
DAMAGE = 97  # one run in so many loses a code point, as the query's contract asks
SHORTEST, LONGEST = 2, 6
LIST, DICTIONARY = 256, 1 << 16
COUNTERS = 1 << 20
HELD_WORDS = 200_000  # distinct words a task counts before it passes them on

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_PLAIN = re.compile(rb"[a-z]{%d,}" % MIN_LENGTH)
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LENGTH)  # U+00C0 to U+00FF are C3 80 to C3 BF


def damaged(word: bytes, doc: int, every: int) -> bytes:
    """The run without the code point that its hash names, if it names one;
    ``doc`` is the CRC of the id and a colon."""
    h = zlib.crc32(word, doc)
    if h % every:
        return word
    letters = word.decode()
    k = h % len(letters)
    letters = letters[:k] + letters[k + 1:]
    return letters.encode() if len(letters) >= MIN_LENGTH else b""


def _counts(every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                own = Counter((_PLAIN if t.isascii() else _LATIN).findall(t.translate(_LOWER)))
                doc = zlib.crc32(b":" if i is None else b"%d:" % i)
                for w, n in own.items():
                    if every:
                        w = damaged(w, doc, every)
                    total[w] = total.get(w, 0) + n
            if len(total) > HELD_WORDS:
                yield _count_rows(total)
                total = {}
        if total:
            yield _count_rows(total)

    return run


def _count_rows(total: dict[bytes, int]) -> pa.RecordBatch:
    total.pop(b"", None)
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())],
                                      ["word", "n"])


def word_counts(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """(word, n) of the words with ``MIN_LENGTH`` code points and ``MIN_COUNT``
    occurrences or more. Tasks count first, so a common word is a few rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = rows.mapInArrow(_counts(damage), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = Counter(w[p:p + k] for w in b.column("word").to_pylist() for k in range(SHORTEST, LONGEST) for p in range(len(w) - k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["gram", "n"])


def split_grams(words: DataFrame) -> frozenset[str]:
    """The grams to be extended: those in more than ``LIST`` places and in more
    than one in ``DICTIONARY`` of all places, so at most ``DICTIONARY`` of each
    length go to the driver."""
    counts = stored(words.select("word").mapInArrow(_gram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
                    .where(F.col("n") > 1).withColumn("size", F.char_length("gram")), "grams")
    places = words.select(F.sum(F.char_length("word"))).first()[0] or 0
    return frozenset(counts.where(F.col("n") > max(LIST, places // DICTIONARY)).select("gram").toArrow().column("gram").to_pylist())


def _most(length: int) -> int:
    """Code points of the longest gram of the lists for words of ``length``: two
    fit into a word of one less."""
    return min(LONGEST, (length - 1) // 2)


def grams(word: str, most: int, split: frozenset[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of the gram that begins at each place, where one ends in time."""
    n = len(word)
    for p in range(n - SHORTEST + 1):
        e = p + SHORTEST
        while e - p < most and e < n and word[p:e] in split:
            e += 1
        if e - p == most or word[p:e] not in split:
            yield p, e


def _key(gram: str, place: int, length: int) -> int:
    return zlib.crc32(gram.encode()) << 24 | (length & 0xFFF) << 12 | place & 0xFFF


def _half(text: str) -> int:
    return zlib.crc32(text.encode()) & 0x7FFFFFFF


def halves(word: str, length: int) -> tuple[int, int]:
    """Hashes of the parts of ``word`` that a near word of ``length`` code points,
    the shorter of the two, has as its left and its right half; an edit leaves
    one of them as it is."""
    middle = length // 2
    return _half(word[:middle]), _half(word[len(word) - (length - middle):])


LISTS = "key long, word string, n long, same_left int, same_right int, more_left int, more_right int"
LOOKUPS = "key long, word string, n long, longer int, own_left int, own_right int"


def _lists(split: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, w in enumerate(b.column("word").to_pylist()):
                parts = halves(w, len(w)) + halves(w, len(w) - 1)
                rows += [(_key(w[p:e], p, len(w)), i, *parts) for p, e in grams(w, _most(len(w)), split)]
            yield _spread(b, rows, LISTS)

    return run


def _spread(b: pa.RecordBatch, rows: list[tuple], schema: str) -> pa.RecordBatch:
    """``rows`` (key, row of b, ints) with that row's word and count."""
    names = [c.split()[0] for c in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * (len(names) - 1)
    place = pa.array(columns[1], pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), b.column("word").take(place), b.column("n").take(place),
                                       *(pa.array(c, pa.int32()) for c in columns[2:])], names)


def two_grams(found: list[tuple[int, int]], cost: list[int]) -> tuple[int, int]:
    """The two grams without a common place that cost least."""
    order = sorted(range(len(found)), key=lambda i: found[i][1])
    best, pair, done, left = None, (0, 0), 0, None
    for i, (p, _) in enumerate(found):  # by beginning; grams that end by then are to the left
        while done < len(order) and found[order[done]][1] <= p:
            if left is None or cost[order[done]] < cost[left]:
                left = order[done]
            done += 1
        if left is not None and (best is None or cost[left] + cost[i] < best):
            best, pair = cost[left] + cost[i], (left, i)
    return pair


def lookups(word: str, split: frozenset[str], size: np.ndarray) -> list[tuple[int, int]]:
    """(key, longer) of the lists that hold every near word of the same length
    (longer 0) or one code point more (1)."""
    out = []
    for longer in (0, 1):
        length = len(word) + longer
        found = list(grams(word, _most(length), split))
        keys = [[_key(word[p:e], p + s, length) for s in range(longer + 1)] for p, e in found]
        cost = [sum(int(size[k % COUNTERS]) for k in own) for own in keys]
        out += [(k, longer) for i in two_grams(found, cost) for k in keys[i]]
    return out


def _lookups(split: frozenset[str], size: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, w in enumerate(b.column("word").to_pylist()):
                parts = halves(w, len(w))
                rows += [(k, i, longer, *parts) for k, longer in lookups(w, split, size)]
            yield _spread(b, rows, LOOKUPS)

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each pair of near words once, from (word, n)
    rows with distinct words of ``MIN_LENGTH`` code points or more."""
    split = split_grams(words)
    lists = stored(words.mapInArrow(_lists(split), LISTS), "gram-lists")
    size = np.zeros(COUNTERS, np.int32)
    counts = lists.groupBy(F.pmod("key", F.lit(COUNTERS)).alias("at")).count().toArrow()  # COUNTERS rows at most, as columns
    size[counts.column("at").to_numpy()] = np.minimum(counts.column("count").to_numpy(), 1 << 30)
    asked = words.mapInArrow(_lookups(split, size), LOOKUPS)
    lists = lists.withColumnsRenamed({"word": "near", "n": "near_n"})
    same = (F.col("longer") == 0) & ((F.col("own_left") == F.col("same_left")) | (F.col("own_right") == F.col("same_right")))
    more = (F.col("longer") == 1) & ((F.col("own_left") == F.col("more_left")) | (F.col("own_right") == F.col("more_right")))
    near = (same & (F.col("word") < F.col("near")) | more) & (F.levenshtein("word", "near", 1) == 1)
    # sized by the words they come from, the lookups would seem small enough to be broadcast
    return asked.hint("merge").join(lists.hint("merge"), "key").where(near).select("word", "n", "near", "near_n").distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of ``words`` (word, n)."""
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("near", "near_n", "word", "n"))
    best = (both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
            .withColumn("ok", -F.col("b.m") >= LEAD * F.col("n"))
            .select(F.col("word").alias("_w"), "n_near", F.when(F.col("ok"), F.col("b.near")).alias("form"),
                    F.when(F.col("ok"), -F.col("b.m")).alias("form_n")))
    best = stored(best, "near-words")
    out = words.join(best.hint("merge"), F.col("word") == F.col("_w"), "left").drop("_w")
    last = roots(best.where("form IS NOT NULL").select(F.col("_w").alias("_r"), F.col("form").alias("root")))
    return (out.join(last.hint("merge"), F.col("word") == F.col("_r"), "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(_r, root): each word's form, its form's form and so on to the last one."""
    now = stored(forms, "forms")
    while True:
        ahead = now.select(F.col("_r").alias("_a"), F.col("root").alias("_far"))
        new = now.join(ahead.hint("merge"), F.col("root") == F.col("_a"), "left")
        new = stored(new.select("_r", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")), "forms")
        now = new.select("_r", "root")
        if not new.where("moved").limit(1).count():
            return now


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return variants(stored(word_counts(table(spark, sf_dir, "documents"), DAMAGE), "words"))


# Near words by the texts that are left when one code point is taken out: a word of one code point more leaves the word itself,
# a replaced code point leaves the same text at the same place.
OP13_SQL = """
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents WHERE text IS NOT NULL)
  WHERE length(run) >= 5),
own AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM own),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda j: ('0x' || x[j:j + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 97 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
         CASE WHEN near_n >= 2 * w.n THEN near_n END::BIGINT AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
chain AS (
  WITH RECURSIVE c AS (
    SELECT word, word AS reached, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM c JOIN forms f ON c.next = f.word)
  SELECT word, reached AS root FROM c WHERE next IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)
"""
