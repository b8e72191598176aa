"""Property checks against plain Python (hypothesis generates whole batches so
each example is one Spark job)."""

import hashlib
import json
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from snapfeed import functions as SF

KEYS = st.sampled_from(["id", "title", "url", "link", "href", "body", "summary", "content", "Zed", "émoji", "a b"])
TEXT = st.text(alphabet=st.characters(blacklist_categories=("Cs",), max_codepoint=0x2FFFF), max_size=12)
ITEM = st.dictionaries(KEYS, st.one_of(st.none(), TEXT), max_size=6)


def py_hash(item):
    norm = {k: unicodedata.normalize("NFC", v.strip()) if isinstance(v, str) else v for k, v in item.items()}
    return hashlib.sha256(json.dumps(norm, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
                          .encode("utf-8")).hexdigest()


def py_text(item, excl):
    parts = [item[k] for k in ("title", "content", "body", "summary") if isinstance(item.get(k), str) and item[k]]
    if not parts:
        parts = [item[k] for k in sorted(item) if k not in excl and isinstance(item[k], str) and item[k]]
    return "\n".join(parts)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(ITEM, min_size=30, max_size=60))
def test_hash_and_text_match_python(spark, items):
    df = spark.createDataFrame([(i, it) for i, it in enumerate(items)], "i int, m map<string,string>")
    rows = df.select("i", SF.item_hash("m").alias("h"), SF.content_text("m").alias("t"),
                     SF.content_hash(SF.content_text("m")).alias("th")).collect()
    for r in rows:
        it = items[r.i]
        assert r.h == py_hash(it)
        assert r.t == py_text(it, ("id", "url", "html_snapshot_url"))
        assert r.th == hashlib.sha256(unicodedata.normalize("NFC", r.t).encode()).hexdigest()


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), TEXT), min_size=30, max_size=60))
def test_strip_and_nfc_match_python(spark, vals):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    for r in df.select("i", SF.pystrip("v").alias("s"), SF.nfc("v").alias("n")).collect():
        v = vals[r.i]
        assert r.s == (None if v is None else v.strip())
        assert r.n == (None if v is None else unicodedata.normalize("NFC", v))
