"""Cost-balanced packing of tokenised documents into sequences of fixed length.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n`` (feed-
forward work and attention within the piece); a sequence costs the sum of its
pieces. Whole stretches of ``length`` tokens are sequences of their own. The
rest of each document is dealt out longest first: to the cheapest sequence
that still has room for it. What fits nowhere whole is cut over the room left.
The sequences' capacities add up to the tokens exactly: as many of ``length``
as go into them, then descending powers of two (a sequence whose length is a
power of two needs no padding), so no padding is left.

A task packs its rows in blocks of about ``block_tokens``, so memory is bounded
and nothing is shuffled; sequence ids are the partition's number and a count.
The input must be the same when a lost task is run again (a stored table is).

Defined cases: null and empty texts are the single id that ends a document;
repeated rows are packed each for itself; a text of any length is cut into as
many pieces as it needs; an empty table gives no pieces; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import chunks, raw, span_hashes, text_col

LENGTH = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 0
BLOCK_TOKENS = 1 << 20
CACHED_UNITS = 1_000_000
CHUNK = 2 << 20
VOCABULARY = "byte_bpe_50k.json"
_BLANK = (0x20, *range(0x09, 0x0E))
_WHITE = np.isin(np.arange(256), _BLANK)
_MARK = np.isin(np.arange(256), list(b",."))
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
# White space beyond ASCII, as bytes.
_OTHER_WHITE = tuple(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, sequence_cost double")


class Encoder:
    """Token ids of whole texts, each distinct unit encoded once.

    A byte-level BPE tokenizer splits text before its merges, always before a
    run of white space and between a letter and a comma or full stop. Units
    between such places are hashed in bulk (64 bits); those not met before are
    encoded by the tokenizer, and the ids of all texts are gathered from theirs.
    Beyond ``CACHED_UNITS`` the units met only once are dropped, so memory is
    bounded. A text where an ASCII space follows another kind of white space
    (the run then begins earlier) goes to the tokenizer whole."""

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special  # their strings in a text are then ordinary text
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token[0] == "\u0120"  # how byte-level vocabularies write a space
        self.slot: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.begin = np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units' ids in a row, their lengths, and the order they are in.
        Units that are a space and solid text are encoded as one text, in which
        each begins with a token that begins with a space."""
        joined = [i for i, t in enumerate(texts) if t[0] == 0x20 and len(t) > 1 and t[1] not in _BLANK]
        ids = self.plain([b"".join([texts[i] for i in joined]).decode()])[0] if joined else np.zeros(0, np.uint32)
        at = np.flatnonzero(self.spaced[ids])
        if len(at) != len(joined):
            joined, ids, at = [], ids[:0], at[:0]
        done = set(joined)
        rest = [i for i in range(len(texts)) if i not in done]
        parts = self.plain([texts[i].decode() for i in rest])
        lengths = np.concatenate([np.diff(np.append(at, len(ids))), [len(x) for x in parts]]).astype(np.int64)
        return np.concatenate([ids, *parts]), lengths, np.array(joined + rest, np.int64)

    def shrink(self) -> None:
        keep = self.met > 1
        if keep.sum() > CACHED_UNITS // 2:
            keep[:] = False
        lengths = np.diff(self.begin)
        self.flat = self.flat[np.repeat(keep, lengths)]
        self.begin = np.concatenate([[0], np.cumsum(lengths[keep])])
        place = np.cumsum(keep) - 1
        self.slot = {h: int(place[i]) for h, i in self.slot.items() if keep[i]}
        self.met = np.ones(len(self.begin) - 1, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more for the end)."""
        data, at = raw(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        white = _WHITE[data]
        cut = white.copy()
        cut[1:] &= ~white[:-1]
        odd_at = np.flatnonzero(cut[3:] & (data[2:-1] >= 0x80)) + 3
        odd_at = odd_at[[bytes(data[i - 3:i]).endswith(_OTHER_WHITE) for i in odd_at]] if len(odd_at) else odd_at
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        begins = at[:-1][at[:-1] < at[1:]]
        cut[begins] = True
        lo = np.flatnonzero(cut)
        hi = np.append(lo[1:], n)
        unit, first, inverse, count = np.unique(span_hashes(data, lo, hi), return_index=True, return_inverse=True,
                                                return_counts=True)
        if len(self.slot) + len(unit) > CACHED_UNITS and len(self.slot):
            self.shrink()
        keys = unit.tolist()
        get = self.slot.get
        slots = np.array([get(k, -1) for k in keys])
        new = np.flatnonzero(slots < 0)
        if len(new):
            flat, lengths, order = self.units([data[a:b].tobytes() for a, b in
                                               zip(lo[first[new]].tolist(), hi[first[new]].tolist())])
            new = new[order]
            slots[new] = len(self.begin) - 1 + np.arange(len(new))
            self.slot.update(zip((keys[i] for i in new.tolist()), slots[new].tolist()))
            self.flat = np.concatenate([self.flat, flat])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(lengths)])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[slots] += count
        slots = slots[inverse]
        length = (self.begin[1:] - self.begin[:-1])[slots]
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(self.begin[slots] - ends + length, length) + np.arange(ends[-1])]
        starts = np.concatenate([[0], ends])[np.searchsorted(lo, at)]
        if len(odd_at):
            odd = np.unique(np.searchsorted(at, odd_at, "right") - 1)
            parts = np.split(ids, starts[1:-1])
            for d, x in zip(odd, self.plain([data[at[d]:at[d + 1]].tobytes().decode() for d in odd])):
                parts[d] = x
            ids, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, starts


def capacities(total: int, length: int = LENGTH) -> list[int]:
    rest = total % length
    return [length] * (total // length) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, tokens). Items are at most ``length`` long."""
    room = np.array(capacities(sum(sizes), length), np.int64)
    cost = np.zeros(len(room))
    out: list[list[tuple[int, int, int]]] = [[] for _ in room]
    late = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        open_ = np.where(room >= n, cost, np.inf)
        k = int(open_.argmin())
        if np.isinf(open_[k]):
            late.append(i)
            continue
        out[k].append((i, 0, n))
        room[k] -= n
        cost[k] += linear * n + quadratic * n * n
    free = [(float(cost[k]), int(k)) for k in np.flatnonzero(room)]
    heapq.heapify(free)
    for i in late:
        at = 0
        while at < sizes[i]:
            _, k = heapq.heappop(free)
            n = min(int(room[k]), sizes[i] - at)
            out[k].append((i, at, n))
            room[k] -= n
            cost[k] += linear * n + quadratic * n * n
            at += n
            if room[k]:
                heapq.heappush(free, (float(cost[k]), k))
    return out


def packer(path: str, length: int, block_tokens: int, linear: float, quadratic: float,
           with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(docs: list[tuple[int | None, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        rows: list[tuple] = []
        rest, who = [], []
        sid = first
        for d, (_, ids) in enumerate(docs):
            n = len(ids) // 4
            for at in range(0, n - n % length, length):
                rows.append((d, at, length, sid, 0, length, linear * length + quadratic * length * length))
                sid += 1
            if n % length:
                rest.append(n % length)
                who.append(d)
        for seq in assign(rest, length, linear, quadratic):
            at, used = 0, sum(n for _, _, n in seq)
            cost = sum(linear * n + quadratic * n * n for _, _, n in seq)
            for i, start, n in seq:
                base = len(docs[who[i]][1]) // 4 // length * length
                rows.append((who[i], base + start, n, sid, at, used, cost))
                at += n
            sid += 1
        piece = [docs[d][1][4 * s:4 * (s + n)] for d, s, n, *_ in rows]
        cols = [pa.array([docs[r[0]][0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([zlib.crc32(p) for p in piece], pa.int64()),
                pa.array([len(docs[r[0]][1]) // 4 for r in rows], pa.int64())]
        cols += [pa.array([r[k] for r in rows], pa.int64()) for k in (3, 4, 5)] + [pa.array([r[6] for r in rows], pa.float64())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if with_ids:
            cols.append(pa.array([np.frombuffer(p, "<i4") for p in piece], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names), sid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        end = np.asarray([END_ID], "<u4").tobytes()
        sid = TaskContext.get().partitionId() << 33
        held: list[tuple[int | None, bytes]] = []
        tokens = 0
        for batch in batches:
            for part in chunks(batch, "text", CHUNK):
                ids, at = encode(part.column(1))
                ids = ids.astype("<u4").tobytes()
                at = at.tolist()
                held += [(d, ids[4 * a:4 * b] + end) for d, a, b in zip(part.column(0).to_pylist(), at, at[1:])]
                tokens += at[-1] + part.num_rows
                if tokens >= block_tokens:
                    out, sid = block(held, sid)
                    yield out
                    held, tokens = [], 0
        if held:
            out, sid = block(held, sid)
            yield out

    return run


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS,
         linear: float = LINEAR, quadratic: float = QUADRATIC, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence and offset; ``ids`` are the
    piece's token ids. ``vocabulary`` is a tokenizer file that every executor has."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    run = packer(vocabulary, length, block_tokens, linear, quadratic, with_ids)
    return docs.select(docs["doc_id"].cast("long"), text_col().alias("text")).mapInArrow(run, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    from .common import prepare, table

    prepare(spark)
    return pack(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
