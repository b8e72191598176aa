"""Secret scans: patterns, and password guess cost in credential contexts.

Base spans (kind ``assign``, ``access``, ``hex``) are pattern matches with a
least length, leftmost and non-overlapping per kind; matches that are too short
use up their text. Added spans (kind ``guess``) are the values of credential
contexts that the patterns leave out (other key words, ``is`` or a verb instead
of a sign, characters outside the pattern's set); a key word may follow ``_``,
``-`` or the small letter of a joined name (``DB_PASSWORD``, ``dbPassword``).
Their cost is the least number of guesses, in bits, over all segmentations into
dictionary words, dates, repeats, keyboard walks and brute-force spans, found by
dynamic programming over the whole value; values of at least ``min_bits`` are
reported. After a sign the cost alone decides; after a verb, plain words (letters
of one case, but for the first) are left out; with neither, a value has a digit
and a second kind of character.

Defined cases: null and empty texts have no spans; texts of any length are
scanned whole; offsets are code points, end exclusive; repeated rows are
scanned each for itself; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import prepare, table, text_col

MIN_BITS = 36.0
MIN_GUESS_CHARS = 8

# The patterns of the base spans and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12

# What stands before a credential's value, dictionary words by
# rank of use, and keyboard rows.
HINTS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api key",
         "api-key", "credential", "bearer", "private key", "private_key", "private-key", "access key", "access_key", "access-key")
CONTEXT = re.compile(
    r"""(?:(?<![^\W_])|(?<=(?-i:[a-z]))(?=(?-i:[A-Z])))"""
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_\x20-]?key|credentials?|bearer|(?:private|access)[_\x20-]key)\b"""
    r"""["']?(?:(?P<sign>\x20*(?:[:=]|=>)\x20*)|(?P<verb>\x20+(?:is|was|set\x20to)\x20+)|\x20+(?=[^\s"']*[0-9][^\s"']*))"""
    r"""["']?(?P<value>[^\s"'<>,;()]+)""", re.I | re.A)
WORDS = ("password", "123456", "qwerty", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "secret",
         "token", "test", "user", "root", "guest", "default", "changeme", "love", "hello", "sunshine", "princess",
         "football", "baseball", "shadow", "superman", "batman", "trustno", "iloveyou", "summer", "winter", "spring",
         "autumn", "monday", "friday", "january", "february", "march", "april", "june", "july", "august", "september",
         "october", "november", "december", "the", "and", "for", "with", "you", "this", "that", "from", "have", "your",
         "house", "world", "money", "happy", "power", "secure", "system", "server", "data", "key", "pass", "word",
         "blue", "green", "black", "white", "star", "king", "queen", "correct", "horse", "battery", "staple", "example")
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
LONGEST_UNIT, LATEST = 8, 16
PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")


def brute_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    if c.isascii() and c.isalpha():
        return math.log2(26)
    return math.log2(33) if c.isascii() else 8.0


def next_key(a: str, b: str) -> bool:
    """Whether two keys lie side by side, in a row or one row apart."""
    p, q = PLACE.get(a), PLACE.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def spans_from(value: str, most: float = math.inf) -> Iterator[list[tuple[int, float, str]]]:
    """For each start: (end, bits, kind) of the cheap spans that begin there and
    cost less than ``most``. A repeat begins in the first ``LATEST`` places of its
    run: further on, it saves less than what it takes to get there."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters become two in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    plain = low.translate(LEET)
    run_of = [0] * (LONGEST_UNIT + 1)  # by unit: where the run that i is in began
    for i in range(n):
        out = []
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            rank = RANK.get(low[i:j]) or RANK.get(plain[i:j])
            if rank:
                own = value[i:j]
                bits = math.log2(rank) + (own != low[i:j]) * 1.0 + (low[i:j] not in RANK) * 2.0
                out.append((j, bits + 1.0, "word"))
        m = DATE.match(value, i)
        if m:
            out.append((m.end(), math.log2(365.25 * 130) if len(m[0]) > 4 else math.log2(130), "date"))
        j, bits = i + 1, math.log2(len(PLACE))  # keyboard walk
        while j < n and bits < most and next_key(low[j - 1], low[j]):
            j, bits = j + 1, bits + 1.6
            if j - i >= 3:
                out.append((j, bits, "walk"))
        for unit in range(1, LONGEST_UNIT + 1):  # a unit again and again
            if i and (i - 1 + unit >= n or value[i - 1] != value[i - 1 + unit]):
                run_of[unit] = i
            if i - run_of[unit] > LATEST or i + 2 * unit > n:
                continue
            bits, times = sum(map(brute_bits, value[i:i + unit])), 1
            while bits < most and value[i:i + unit] == value[i + times * unit:i + (times + 1) * unit]:
                times += 1
                if unit * times >= 3:
                    out.append((i + times * unit, bits + math.log2(times), "repeat"))
        yield out


def spans_at(value: str) -> list[list[tuple[int, float, str]]]:
    """For each end: (start, bits, kind) of the cheap spans that end there."""
    out: list[list[tuple[int, float, str]]] = [[] for _ in range(len(value) + 1)]
    for i, own in enumerate(spans_from(value)):
        for j, bits, kind in own:
            out[j].append((i, bits, kind))
    return out


@lru_cache(1 << 14)
def guess_bits(value: str, enough: float = math.inf) -> float:
    """log2 of the guesses of the cheapest segmentation. Brute-force spans cost
    their characters; each further segment costs a bit for its order. Ends, with a
    lower bound, once no continuation can fall below ``enough``."""
    n = len(value)
    cost = [0.0] + [math.inf] * n
    reach = 0  # the furthest end below ``enough``
    for i, own in enumerate(spans_from(value, enough)):
        if cost[i] >= enough:
            if reach <= i:  # every segmentation goes through i or a later end that costs enough
                return enough
            continue
        for j, bits in [(i + 1, brute_bits(value[i])), *((j, bits + (1.0 if i else 0.0)) for j, bits, _ in own)]:
            if cost[i] + bits < cost[j]:
                cost[j] = cost[i] + bits
                if cost[j] < enough:
                    reach = max(reach, j)
    return min(cost[n], enough)


def base_spans(text: str, low: str) -> list[tuple[int, int, str]]:
    """(start, order of kind, end) by kind; ``low`` is the lower-case text."""
    out = []
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, low: str, base: list, min_bits: float = MIN_BITS) -> list:
    """Values in credential contexts that no base span covers and that cost enough."""
    if not any(k in low for k in HINTS):
        return []
    out = []
    starts, reach = [s[0] for s in base], list(accumulate((s[2] for s in base), max))
    for m in CONTEXT.finditer(text):
        a, b = m.span("value")
        value = m["value"].rstrip(".?:")
        b = a + len(value)
        before = bisect_left(starts, b)
        if len(value) < MIN_GUESS_CHARS or before and reach[before - 1] > a:
            continue
        if m["sign"] is None and not (telling(value) if m["verb"] else mixed(value)):
            continue
        if guess_bits(value, min_bits) >= min_bits:
            out.append((a, 3, b, "guess"))
    return out


def telling(value: str) -> bool:
    """Whether a value is other than a plain word."""
    return not (value.isalpha() and (value[1:].islower() or value.isupper()))


def mixed(value: str) -> bool:
    kinds = (any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value)
             + any(not c.isalnum() for c in value))
    return kinds >= 2 and any(c.isdigit() or not c.isalnum() for c in value)


def scan(text: str, min_bits: float = MIN_BITS) -> tuple[list, list]:
    low = text.lower()
    base = base_spans(text, low)
    return base, sorted(base + guess_spans(text, low, base, min_bits))


def written(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, n_guess long, base string, spans string, redacted string"


def redact(text: str, spans: list) -> str:
    """The text with each covered stretch replaced by a mark of its first kind."""
    out, at = [], 0
    for a, _, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, min_bits: float = MIN_BITS, with_redacted: bool = True) -> DataFrame:
    """Per row: doc_id, counts by kind, base and all spans as kind:start:end,
    and the text without them (``redacted``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = scan(text, min_bits)
                n = [sum(s[1] == k for s in every) for k in range(4)]
                rows.append((*n, written(base), written(every), redact(text, every) if with_redacted else None))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]],
                ["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    return docs.select(docs["doc_id"].cast("long"), text_col().alias("text")).mapInArrow(run, "doc_id long, " + SCHEMA)


def redacted_docs(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced (and n_chars counted anew
    where it is a column); null texts stay null. All columns pass through the task."""
    names, place = docs.columns, docs.columns.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            texts = cols[place].to_pylist()
            n = cols[count].to_pylist() if count is not None else [None] * len(texts)
            for i, t in enumerate(texts):
                spans = scan(t, min_bits)[1] if t else None
                if spans:
                    texts[i] = redact(t, spans)
                    n[i] = len(texts[i])
            cols[place] = pa.array(texts, cols[place].type)
            if count is not None:
                cols[count] = pa.array(n, cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    prepare(spark)
    found = find_secrets(table(spark, sf_dir, "documents"), with_redacted=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_guess")
