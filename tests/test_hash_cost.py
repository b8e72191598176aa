import hashlib
import json
import unicodedata

from pyspark.sql import functions as F

from snapfeed.functions import item_hash, json_escape, pystrip
from snapfeed.functions.text import PY_WHITESPACE

ODD = ["plain", "two\nlines", 'q"uote', "back\\slash", "tab\there\r", "\x00\x01\x0b\x1f mid \x08\x0c", "é", "é", "é\n\"\\\x07", "Ω", "가",
       "한", "\U0001f600", "[]!#", "", " ", None, "  wide 　", "à̖\x85", "\x7f\x80˿̀", "\x1c\x1dx\x1e\x1f"]


def test_item_hash_of_odd_values(spark):
    rows = [({"k": v, 'k"\n': w, "é\x01": "x"},) for v in ODD for w in ODD]
    got = [r[0] for r in spark.createDataFrame(rows, "data map<string,string>").select(item_hash(F.col("data"))).collect()]
    norm = lambda v: None if v is None else unicodedata.normalize("NFC", v.strip())
    want = [hashlib.sha256(json.dumps({k: norm(v) for k, v in d.items()}, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
            for d, in rows]
    assert got == want


def test_strip_and_escape_of_odd_values(spark):
    values = [a + b + a for a in [*PY_WHITESPACE, "", "​"] for b in ("x", "", "x y", "​")]
    out = spark.createDataFrame([(v,) for v in values + ODD], "v string").select(pystrip("v"), json_escape("v")).collect()
    assert [r[0] for r in out] == [None if v is None else v.strip() for v in values + ODD]
    assert [r[1] for r in out] == [None if v is None else json.dumps(v, ensure_ascii=False)[1:-1] for v in values + ODD]


def test_hashing_does_not_search_values_by_pattern_for_blanks(spark):
    """A pattern that looks for blanks at the end tries every blank of a text."""
    df = spark.createDataFrame([({"k": "x"},)], "data map<string,string>").select(item_hash(F.col("data")).alias("h"))
    assert "regexp_replace" not in df._jdf.queryExecution().analyzed().toString().lower()
