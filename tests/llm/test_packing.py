import random
import zlib

import numpy as np
import pyarrow as pa

from snapfeed.llm import packing

from llm_helpers import prose

HARD = ["", " ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "a\n\n b\n", "it's 'sx a's", "x  y", "x  y", "x \n\ny z",
        "é\x85 b", "\x1c b \x1c", "tab\t x", "<|endoftext|> a <|endoftext|>", "漢字 かな 1234 a1b2", "a　b 　", "﻿a b​ c",
        "a.b,c. d", "x \n\n y", "don't. I'll, we've.", "word. word, word.. Word,.x"]


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    t.encode_special_tokens = True
    return t


def test_encoder_equals_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_UNITS", 300)  # shrinks again and again
    rng = random.Random(1)
    encode, plain = packing.Encoder(packing.vocabulary_path()), tokenizer()
    for round_ in range(6):
        texts = HARD + ["".join(rng.choice("ab .,\n\té'1  ") for _ in range(rng.randint(0, 40))) for _ in range(60)]
        rng.shuffle(texts)
        ids, at = encode(pa.array(texts))
        for t, a, b in zip(texts, at, at[1:]):
            assert ids[a:b].tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_assign_fills_capacities():
    rng = random.Random(2)
    for n in (0, 1, 5, 200):
        sizes = [rng.randint(1, 1023) for _ in range(n)]
        out = packing.assign(sizes)
        assert sorted((i, a + k) for seq in out for i, a, m in seq for k in range(m)) == [(i, k) for i, m in enumerate(sizes) for k in range(m)]
        used = [sum(m for *_, m in seq) for seq in out]
        assert sum(u != 1024 for u in used) <= 10 and all(u & (u - 1) == 0 for u in used)
    costs = [sum(m + m * m / 1024 for *_, m in seq) for seq in packing.assign([rng.randint(50, 400) for _ in range(2000)])]
    assert np.percentile(costs, 95) < 2 * np.percentile(costs, 5)


def test_pieces(docs_of):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.choice([0, 3, 40, 300, 900]))) for i in range(120)] + [(200, None), (201, ""), (3, "again"), (None, "no id")]
    rows += [(300, prose(rng, 30000)), (301, "x" * 50000)] + [(400 + i, t) for i, t in enumerate(HARD)]
    out = packing.pack(docs_of(rows, extra=True), packing.vocabulary_path(), block_tokens=20000).collect()
    plain = tokenizer()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [0])
    seqs, docs = {}, {}
    for r in out:
        assert r["length"] == len(r["ids"]) >= 1
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for own in seqs.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    for i, lists in want.items():
        for ids in lists:
            pieces = sorted(docs[i, len(ids)])
            assert [x for _, p in pieces for x in p] == ids
            at = 0
            for start, p in pieces:
                assert start == at
                at += len(p)
    assert packing.pack(docs_of([]), packing.vocabulary_path()).count() == 0
