import hashlib
import random

import pytest

from snapfeed.llm import fingerprints as f

from llm_helpers import prose


def brute_counts(data):
    counts = [0] * f.BUCKETS
    for i in range(len(data)):
        for places, mult in f.TRIPLETS:
            if i + places[-1] < len(data):
                h = sum(data[i + p] * m for p, m in zip(places, mult)) % 2 ** 32
                h = (h ^ h >> 15) * 0x2C1B3C6D % 2 ** 32
                counts[h >> 24] += 1
    return counts


def test_counts_and_bounds():
    import numpy as np

    rng = random.Random(1)
    for text in ("", "a", "ab", "abc", "abcd", "é漢字", prose(rng, 200)):
        data = text.encode()
        assert f.bucket_counts(np.frombuffer(data, np.uint8)).tolist() == brute_counts(data)
    made = [f.digest(t.encode()) for t in ("", "a", "\0" * 1000, prose(rng, 30), prose(rng, 3000), "x" * 200000)]
    for a in made:
        assert len(a) == 132 and f.likeness(a, a) == 1.0
        for b in made:
            assert 0.0 <= f.likeness(a, b) == f.likeness(b, a) <= 1.0
    text = prose(rng, 500)
    near, far = text.replace("w1", "v1"), prose(rng, 500, ["quite", "other", "words", "here"])
    d = [f.digest(x.encode()) for x in (text, near, far)]
    assert f.likeness(d[0], d[1]) > f.likeness(d[0], d[2])


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_pairs_against_brute_force(docs_of, parts):
    rng = random.Random(parts)
    rows = [(i * 3, prose(rng, rng.randint(0, 60)) + rng.choice(["", "é", "漢字"])) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1003, "x" * 30000), (9, rows[3][1]), (12, "same id, other text"), (None, "no id"), (None, None)]
    got = f.edit_pairs(docs_of(rows, extra=True), parts).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()), reverse=True)
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        new = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        a, b, c = (f.digest(x.encode()) for x in (t, new, n))
        want.append((str(i), len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, f.likeness(a, b), f.likeness(a, c)))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)


def test_one_row_and_none(docs_of):
    r = f.edit_pairs(docs_of([(5, "abcdef")])).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()
    assert f.edit_pairs(docs_of([])).count() == 0
    assert [x["fingerprint"] for x in f.fingerprints(docs_of([(1, None), (2, "")])).collect()] == ["00" * 66] * 2
