import random
import re
import zlib
from collections import Counter

from snapfeed.llm import spelling


def apart_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if apart_by_one(w, v))
        form = near[0][1] if near and -near[0][0] >= 2 * n else None
        out[w] = [form, None, n, len(near), counts[form] if form else None]
    for w in out:
        last = w
        while out[last][0]:
            last = out[last][0]
        out[w][1] = last
    return {(w, *v) for w, v in out.items()}


def found(words):
    return {tuple(r) for r in spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def edited(rng, w, letters):
    i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
    if kind == 0:
        return w[:i] + rng.choice(letters) + w[i:]
    i = min(i, len(w) - 1)
    return w[:i] + (rng.choice(letters) if kind == 1 else "") + w[i + 1:]


def test_variants_equal_brute_force_whatever_is_split(llm, monkeypatch):
    monkeypatch.setattr(spelling, "LIST", 3)
    rng = random.Random(4)
    letters = "abé×"
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([5, 5, 6, 7, 8, 12, 17]))) for _ in range(150)}
    words |= {v for w in list(words) for v in (edited(rng, w, letters), edited(rng, w, letters)) if len(v) >= 5}
    words |= {"a" * k for k in range(5, 20)} | {"ab" * k for k in range(3, 9)}
    counts = {w: rng.choice([3, 3, 4, 7, 7, 20, 1000]) for w in words}
    assert found(llm.createDataFrame(sorted(counts.items()), "word string, n long")) == brute(counts)


def test_grams_are_prefix_free_and_local():
    split = frozenset({"ab", "bc", "abc"})
    assert list(spelling.grams("abcdx", 4, split)) == [(0, 4), (1, 4), (2, 4), (3, 5)]
    assert list(spelling.grams("xabc", 3, split)) == [(0, 2), (1, 4)]  # "bc" is split and the word ends before its gram does
    assert list(spelling.grams("ababa", 2, split)) == [(0, 2), (1, 3), (2, 4), (3, 5)]


def test_two_grams_never_overlap_and_cost_least():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(5, 14)
        most = (n - 1) // 2
        spans = [(p, p + rng.randrange(2, most + 1)) for p in range(n - most + 1)]
        cost = [rng.randrange(50) for _ in spans]
        i, j = spelling.two_grams(spans, cost)
        assert spans[i][1] <= spans[j][0]
        assert cost[i] + cost[j] == min(cost[a] + cost[b] for a, (_, e) in enumerate(spans) for b, (p, _) in enumerate(spans) if e <= p)


def naive_counts(rows, damage):
    total = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def test_word_counts(llm, docs_of, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    rng = random.Random(2)
    pool = ["".join(rng.choice("abcdeÉéÀÿŁ日-XYZ") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(None, "Straße straße STRASSE straßen " * 3), (3, rows[3][1]), (7, None), (8, ""), (9, "long" * 30000 + " longer longer longer")]
    for damage in (None, 2, 97):
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs_of(rows, extra=True), damage).collect()}
        assert got == naive_counts(rows, damage)


def test_forms_chains_and_ties(llm):
    counts = {"later": 100, "latex": 100, "lates": 50, "latess": 25, "latesss": 12, "gates": 13, "alone": 9}
    got = {r["word"]: r for r in spelling.variants(llm.createDataFrame(sorted(counts.items()), "word string, n long")).collect()}
    assert got["lates"]["form"] == "later"  # the smaller of two with the same count
    assert [got[w]["root"] for w in ("latess", "latesss", "gates")] == ["later"] * 3
    assert got["later"]["form"] is None and got["later"]["root"] == "later" and got["later"]["n_near"] == 2
    assert (got["alone"]["n_near"], got["alone"]["form_n"], got["alone"]["root"]) == (0, None, "alone")


def test_nothing_of_the_vocabulary_is_broadcast(llm, monkeypatch):
    """Spark takes the lookups for as small as the words they come from."""
    from pyspark.sql import functions as F

    plans, whole = [], spelling.stored

    def plan(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(spelling, "stored", lambda df, name: whole(plan(df), name))
    words = llm.range(300).select(F.concat(F.lit("wordsof"), "id").alias("word"), (F.col("id") + 3).alias("n"))
    assert plan(spelling.variants(words)).count() == 300
    assert sum(p.count("SortMergeJoin") for p in plans) >= 3 and not any("Broadcast" in p for p in plans)


def test_empty_table(llm, docs_of):
    assert spelling.variants(spelling.word_counts(docs_of([(1, None), (2, "")]))).collect() == []
    assert spelling.variants(spelling.word_counts(docs_of([]))).collect() == []
