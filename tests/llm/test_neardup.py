import random
import re
from collections import defaultdict

import numpy as np

from snapfeed.llm import links, neardup
from snapfeed.llm.common import U64, mix

from llm_helpers import prose


def shingle_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """Classes of row numbers: equal texts, and all pairs at 0.8 or more."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [shingle_set(t) if t is not None else frozenset() for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1] is not None and rows[i][1] == rows[j][1] or both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                up[root(i)] = root(j)
    out = defaultdict(list)
    for i in range(len(rows)):
        out[root(i)].append(i)
    return list(out.values())


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.random()}"
    return " ".join(w)


def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([0, 1, 4, 5, 30, 120]))) for i in range(60)]
    base = prose(rng, 300)
    rows += [(100 + i, edited(rng, base, rng.randint(0, 6))) for i in range(60)]  # near copies of near copies
    rows += [(200 + i, rows[10][1]) for i in range(30)]
    long_ = prose(rng, 20000)
    rows += [(300, long_), (301, edited(rng, long_, 100)), (302, "one two"), (303, "one  TWO"), (304, "one two three"), (305, None), (306, None),
             (307, ""), (308, ""), (309, " \n"), (310, "a b c d e " * 400), (311, "a b c d e " * 390 + "f"), (10, rows[10][1]), (10, rows[11][1] + " other"), (None, rows[10][1])]
    return rows


def test_classes_against_brute_force(docs_of):
    rows = corpus()
    out = neardup.classes(docs_of(rows, extra=True)).collect()
    assert len(out) == len(rows)
    got, want = defaultdict(list), defaultdict(list)
    for own in brute(rows):
        ids = [rows[i][0] for i in own]
        least = min((i for i in ids if i is not None), default=None)
        want[least] += [str(i) for i in ids]
    for r in out:
        got[r["class_id"]].append(str(r["doc_id"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_keep_one(docs_of):
    rows = corpus()
    docs = docs_of(rows, extra=True)
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    classes = [[rows[i] for i in own] for own in brute(rows)]
    assert len(kept) == len(classes)
    for own in classes:
        assert sum(own.count(k) > 0 for k in set(kept)) >= 1
    assert neardup.keep_one(docs_of([])).count() == 0 and neardup.classes(docs_of([])).count() == 0


def test_chains_in_one_bucket(llm):
    """All texts in one bucket; likeness by place on a line: neighbours only are alike."""
    from pyspark.sql import functions as F

    place = {1: 0.0, 2: 0.35, 3: 0.2, 4: 0.5, 5: 3.0, 6: 3.1, 7: 9.0}
    table = llm.createDataFrame(list(place.items()), "uid long, x double")

    def measure(pairs, sets):
        x, y = (sets.select(F.col("uid").alias(c), F.col("x").alias(f"{c}x")) for c in "ab")
        return pairs.join(x, "a").join(y, "b").select("a", "b", F.greatest(F.lit(0.0), 1 - F.abs(F.col("ax") - F.col("bx"))).alias("like"))

    buckets = llm.createDataFrame([(1, u) for u in place], "bucket long, uid long")
    near = neardup.verified(buckets, lambda uids: table, 0.8, measure)
    label = {r["node"]: r["label"] for r in links.components(near).collect()}
    assert {1, 3} <= set(label) and label[1] == label[3] == label[2] == label[4] and label[5] == label[6] and 7 not in label


def test_buckets_lose_no_class_and_no_place(llm):
    """Texts with places in buckets; passages of random pairs, at random places, cover some of them."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    spans = {}
    for _ in range(75):
        a, b = sorted(rng.sample(range(1, 41), 2), reverse=True)
        spans[a, b] = tuple(x for _ in "ab" for f in [rng.randrange(90)] for x in (f, f + rng.randrange(5, 40)))
    # 1 is the first pivot: 3 hangs on 2 only, and 2 and 4 share what 1 hasn't got
    spans = {k: v for k, v in spans.items() if not set(k) & {1, 2, 3, 4}} | {(2, 1): (0, 9, 0, 9), (3, 2): (20, 29, 20, 29), (4, 1): (0, 9, 0, 9), (4, 2): (50, 59, 50, 59)}
    members = {(bucket, u, rng.randrange(120)) for bucket in range(10, 22) for u in rng.sample(range(5, 41), 30) for _ in range(rng.choice((1, 1, 2)))}
    members |= {(1, u, 25) for u in (1, 2, 3)} | {(2, u, 55) for u in (1, 2, 4)} | {(3, 5, 7), (3, 5, 8)}
    asked = []

    def measure(pairs, sets):
        own = [(r["a"], r["b"]) for r in pairs.collect()]
        asked.extend(own)
        return llm.createDataFrame([(a, b, 1.0 if (a, b) in spans else 0.0, list(spans.get((a, b), ()))) for a, b in own],
                                   "a long, b long, like double, spans array<long>")

    def stretches(near):
        of_a, of_b = (near.select(F.col(c).alias("uid"), F.col("spans")[i].alias("first"), F.col("spans")[i + 1].alias("last")) for c, i in (("a", 0), ("b", 2)))
        return of_a.union(of_b)

    near = neardup.verified(llm.createDataFrame(sorted(members), "bucket long, uid long, at int"), lambda uids: uids, 0.8, measure, stretches)
    rows = [(r["a"], r["b"]) for r in near.collect()]
    assert len(rows) == len(set(rows)) and set(rows) <= set(spans) and len(asked) == len(set(asked))

    def outcome(own):
        up = {u: u for u in range(1, 41)}
        for _ in up:
            for a, b in own:
                up[a] = up[b] = min(up[a], up[b])
        lie = {(u, p) for a, b in own for u, (f, t) in ((a, spans[a, b][:2]), (b, spans[a, b][2:])) for p in range(f, t + 1)}
        return up, {(b, u, p) for b, u, p in members if (u, p) in lie}

    whole = {(max(u, v), min(u, v)) for b, u, _ in members for c, v, _ in members if b == c and u != v} & set(spans)
    assert outcome(rows) == outcome(whole)
    assert {(3, 2), (4, 2)} <= set(rows)


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(5):
        ids = mix(np.arange(1, 61, dtype=U64) + U64(int(rng.integers(1 << 40))))
        a = {int(i): float(w) for i, w in zip(ids[:45], rng.exponential(1, 45) + 0.05)}
        b = {int(i): float(w) for i, w in zip(ids[15:], rng.exponential(1, 45) + 0.05)}
        exact = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in set(a) | set(b)) for d in set(a) & set(b))
        s = neardup.prob_minhash(np.array(list(a) + list(b), U64), np.array(list(a.values()) + list(b.values())), np.array([0, len(a), len(a) + len(b)]), 4096)
        assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_components(llm):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 40)] + [(1000, 100 + i) for i in range(30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["label"] for r in links.components(llm.createDataFrame(edges, "a long, b long")).collect()}
    least = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_repeated_lines_share_a_band():
    """Near copies that differ by lines repeated hundreds of times."""
    import pyarrow as pa

    texts = []
    for i in range(12):
        own = " ".join(f"w{i}x{k}" for k in range(204))
        texts += [own, own + " " + " ".join([" ".join(f"r{i}x{k}" for k in range(45))] * 300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(24)), pa.array([str(i) for i in range(24)])], ["text", "doc_id", "md5"])
    bands = [np.frombuffer(b, "<i8") for out in neardup._signatures(iter([batch])) for b in out.column("bands").to_pylist()]
    assert len(bands) == 24
    assert all((bands[i] == bands[i + 1]).any() for i in range(0, 24, 2))


def pair_likeness(a, b):
    return len(a & b) / len(a | b)


def test_shared_counts_and_forest():
    rng = random.Random(2)
    sets = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(25)]
    arrays = [np.array(sorted(x), U64) for x in sets]
    assert (neardup.shared(arrays) == [[len(a & b) for b in sets] for a in sets]).all()
    assert (neardup.shared(arrays, 7) == [[len(a & b) for b in sets] for a in sets[:7]]).all()
    like = neardup.alike(arrays)
    assert np.allclose(like, [[pair_likeness(a, b) for b in sets] for a in sets])
    found = neardup.forest(like, 0.4)
    assert all(like[i, j] >= 0.4 for i, j, _ in found)
    up = list(range(25))
    for i, j, _ in found:
        up = [up[i] if x == up[j] else x for x in up]
    want = list(range(25))
    for i in range(25):
        for j in range(25):
            if like[i, j] >= 0.4:
                want = [want[i] if x == want[j] else x for x in want]
    assert len(found) == 25 - len(set(want)) and len(set(up)) == len(set(want))


def test_many_cells_at_a_time_are_the_same(monkeypatch):
    rng = random.Random(3)
    arrays = [np.array(sorted(rng.sample(range(500), 200)), U64) for _ in range(10)]
    whole = neardup.shared(arrays)
    monkeypatch.setattr(neardup, "CELLS", 70)
    assert (neardup.shared(arrays) == whole).all()


def test_wide_buckets_lose_no_link(llm, monkeypatch):
    """Buckets of many blocks, with a large class, chains across blocks and texts unlike all others."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 4)
    rng = random.Random(6)
    base = list(range(100))
    sets = {u: set(base) - set(rng.sample(base, rng.randrange(0, 8))) for u in range(40)}
    step = set(range(1000, 1100))
    for k in range(30):  # a chain: each is like the next one only
        sets[100 + k] = set(step)
        step = step - {min(step), sorted(step)[1], sorted(step)[2], sorted(step)[3]} | {2000 + 4 * k + i for i in range(4)}
    sets |= {200 + k: {3000 + 50 * k + i for i in range(50)} for k in range(15)}
    buckets = [(1, u) for u in sets] + [(2, u) for u in sets if u % 2] + [(3, 200), (3, 201)]
    members = llm.createDataFrame([(b, u, len(sets[u])) for b, u in buckets], "bucket long, uid long, size long")
    table = llm.createDataFrame([(u, bytearray(np.array(sorted(x), U64).tobytes())) for u, x in sets.items()], "uid long, set binary")
    near = neardup.bucket_links(members, table, 0.8)
    rows = near.collect()
    assert rows and all(abs(r["like"] - pair_likeness(sets[r["a"]], sets[r["b"]])) < 1e-9 and r["like"] >= 0.8 for r in rows)
    got = {r["node"]: r["label"] for r in links.components(near).collect()}
    want = {u: u for u in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                if pair_likeness(sets[a], sets[b]) >= 0.8:
                    want[a] = want[b] = min(want[a], want[b])
    assert {u: got.get(u, u) for u in sets} == want
    lonely = members.where("uid >= 200")
    assert neardup.bucket_links(lonely, table, 0.8) is None


def test_buckets_with_equal_members_count_once(llm):
    members = neardup.bucket_members(llm.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 5), (3, 7), (4, 5), (4, 6), (4, 7)], "bucket long, uid long"))
    assert sorted(r["n"] for r in members.groupBy("bucket").count().withColumnRenamed("count", "n").collect()) == [2, 3]
    assert neardup.bucket_members(llm.createDataFrame([(1, 5), (2, 6)], "bucket long, uid long")) is None


def test_weights_are_bounded():
    w = neardup.weights(np.array([1, 2, 5, 1000000]))
    assert w[0] == 1 and (np.diff(w) > 0).all() and w[-1] < neardup.HEAVIEST
