import os
import re
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(llm):
    import corpus_pipeline as p
    from snapfeed.llm.common import stored, table

    docs = table(llm, SF, "documents")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(stored(stage(llm, out[-1], SF), f"test-{name}"))
    return out


def test_stages(llm, steps):
    import corpus_pipeline as p
    from snapfeed.llm import mixing, neardup, secrets, toxicity
    from snapfeed.llm.common import table

    docs, clean, single, safe, mixed, packed = steps
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    for s in steps[:-1]:
        assert s.columns == docs.columns
    rows = lambda df: Counter(map(tuple, df.collect()))
    model = toxicity.train(docs, table(llm, SF, "labels"))
    bad = {r["doc_id"] for r in toxicity.score(docs, model).where("score >= 0.7").collect()}
    assert rows(clean) == Counter(r for r in rows(docs).elements() if r[0] not in bad)
    kept = {r["doc_id"] for r in neardup.classes(clean).where("kept").collect()}
    assert rows(single) == Counter(r for r in rows(clean).elements() if r[0] in kept)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in safe.collect():
        assert r["text"] == secrets.redact(texts[r["doc_id"]], secrets.scan(texts[r["doc_id"]])[1])
        assert not secrets.base_spans(r["text"], r["text"].lower())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(safe).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(re.findall(mixing.WORD, r["text"]))
    assert words == Counter({k: v for k, v in taken.items() if v})
    assert packed.agg({"length": "sum"}).first()[0] == sum(
        r["doc_tokens"] for r in packed.where("start = 0").collect())


def test_run_equals_its_stages(llm, steps):
    import corpus_pipeline as p

    pieces = lambda df: sorted(map(tuple, df.select("doc_id", "doc_tokens").where("start = 0").collect()))
    assert pieces(p.run(llm, SF)) == pieces(steps[-1])


def test_stages_on_odd_rows(llm, docs_of, scratch):
    """Nulls, empty and very long texts, repeated rows, clashing columns; then nothing at all."""
    import random

    import corpus_pipeline as p

    rng = random.Random(8)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    long_, other = prose(120_000), prose(80)
    rows = [(1, None), (2, ""), (3, ""), (4, long_, None), (5, other), (5, other), (None, prose(60)), (7, other + " end"), (8, " \n"),
            (9, prose(50) + " password: Xq9!LmWz#Rt7pQ"), (None, None, None)]
    docs = docs_of(rows, extra=True)
    llm.createDataFrame([(5, 1, 0), (9, 0, 1), (None, 1, 1), (77, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    texts = {}
    now = docs
    for name, stage in p.STAGES[:-1]:
        now = stage(llm, now, scratch)
        assert now.columns == docs.columns, name
        texts[name] = sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=repr)
    assert texts["toxicity"] == sorted(((r[0], r[1]) for r in rows), key=repr)
    kept = texts["near_duplicates"]
    assert sum(t == "" for _, t in kept) == 1 and sum(t is None for _, t in kept) == 2 and (4, long_) in kept
    assert [i for i, t in kept if t and t.startswith(other)] == [5]
    assert "Xq9!LmWz#Rt7pQ" not in dict(texts["secrets"])[9]
    assert all(t for _, t in texts["mixing"]) and len({t for _, t in texts["mixing"]}) <= 4
    packed = p.STAGES[-1][1](llm, now, scratch)
    assert packed.count() > 0
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(llm, empty, scratch).count() == 0, name
