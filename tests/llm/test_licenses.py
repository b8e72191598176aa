import random

import numpy as np
import pyarrow as pa
import pytest

from snapfeed.llm import licenses as x
from snapfeed.llm.common import shingles, words

from llm_helpers import prose

T = x.TEMPLATES


def brute(text):
    """Templates of which some stretch of the text holds 0.8 of the shingles, and the
    best share, over all stretches as long as the template allows."""
    w, doc, _, _ = words(pa.array([text]), x._SPELLED)
    s = shingles(w, doc)[0]
    out = {}
    for k, own in enumerate(x.Templates(T).sets):
        inside = np.isin(s, own)
        best = 0.0
        for i in np.flatnonzero(inside):
            best = max(best, len(np.unique(s[i:i + len(own) + len(own) // 2][inside[i:i + len(own) + len(own) // 2]])) / len(own))
        if best >= 0.8:
            out[k] = best
    return out


def test_every_template_is_found(docs_of):
    rng = random.Random(1)
    rows = []
    for k, (_, t) in enumerate(T):
        rows += [(3 * k, t), (3 * k + 1, prose(rng, 40) + " " + t.upper().replace(" ", "\n") + " " + prose(rng, 700)),
                 (3 * k + 2, prose(rng, 900) + " é漢 " + t + " " + t)]
    rows += [(900, None), (901, ""), (902, "MIT"), (903, prose(rng, 40000) + " " + T[0][1]), (0, T[0][1])]
    out = x.find_licenses(docs_of(rows, extra=True)).collect()
    texts = dict(rows)
    for k, (name, t) in enumerate(T):
        full = [r for r in out if r["template"] == k and r["containment"] == 1.0]
        for i, n in ((3 * k, 1), (3 * k + 1, 1), (3 * k + 2, 2)):
            own = [r for r in full if r["doc_id"] == i]
            assert len(own) == n + (i == 0) and all(r["license"] == name for r in own)
            for r in own:
                got = texts[i][r["span_start"]:r["span_end"]].lower().split()
                assert [w.strip('.,:;"()') for w in got] == [w.strip('.,:;"()') for w in t.lower().split()]
    assert not [r for r in out if r["doc_id"] in (900, 901, 902)] and [r for r in out if r["doc_id"] == 903]


def test_partial_matches_against_brute_force():
    rng = random.Random(2)
    known = x.Templates(T)
    for _ in range(150):
        name, t = rng.choice(T)
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 12))):
            w[rng.randrange(len(w))] = "changed"
        text = prose(rng, rng.randint(0, 80)) + " " + " ".join(w) + " " + prose(rng, rng.randint(0, 80))
        ws, doc, _, _ = words(pa.array([text]), x._SPELLED)
        got = {m[0] for m in known.matches(shingles(ws, doc)[0])}
        want = brute(text)
        assert got <= set(want)
        best = max(want.values(), default=0)
        assert {k for k, v in want.items() if v == best} <= got


def test_refused_and_empty(docs_of):
    with pytest.raises(ValueError):
        x.Templates([("short", "four words are few")])
    assert x.find_licenses(docs_of([])).count() == 0
    assert 1 - (1 - x.LEAST_LIKENESS) ** x.BANDS >= x.RETRIEVED
