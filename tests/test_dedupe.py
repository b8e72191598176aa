import pytest
from pyspark.sql import functions as F

from snapfeed.operators import dedupe
from tests.helpers import items_df


def test_first_wins_keeps_first_in_document_order(spark):
    df = items_df(spark, [("s", "r", 0, {"id": "a", "v": "1"}), ("s", "r", 1, {"id": "a", "v": "2"}),
                          ("s", "r", 2, {"id": "b", "v": "3"})])
    out = dedupe.first_wins(df, "id").orderBy("item_idx").collect()
    assert [(r.dedupe_key, r.data["v"]) for r in out] == [("a", "1"), ("b", "3")]


def test_null_missing_blank_keys_dropped_and_strip_compare(spark):
    df = items_df(spark, [("s", "r", 0, {"v": "no key"}), ("s", "r", 1, {"id": None}), ("s", "r", 2, {"id": ""}),
                          ("s", "r", 3, {"id": "   "}), ("s", "r", 4, {"id": " a "}), ("s", "r", 5, {"id": "a"})])
    out = dedupe.first_wins(df, "id").collect()
    assert [(r.item_idx, r.dedupe_key) for r in out] == [(4, " a ")]  # stored unstripped


def test_runs_and_sources_are_separate(spark):
    df = items_df(spark, [("a", "r1", 0, {"id": "1"}), ("b", "r1", 0, {"id": "1"}), ("a", "r2", 0, {"id": "1"})])
    assert dedupe.first_wins(df, "id").count() == 3


def test_cap_before_dedupe(spark):
    rows = [("s", "r", i, {"id": k}) for i, k in enumerate(["a", "a", "b", "c", "d"])]
    df = items_df(spark, rows)
    kept = dedupe.first_wins(dedupe.cap(df, 3), "id").collect()
    assert sorted(r.dedupe_key for r in kept) == ["a", "b"]


def test_cap_across_pages(spark):
    df = spark.createDataFrame([("s", "r", p, i, {"id": f"{p}-{i}"}) for p in (1, 2) for i in range(4)],
                               "source_id string, run_id string, page_no int, item_idx int, data map<string,string>")
    got = [r.data["id"] for r in dedupe.cap(df, 6).orderBy("page_no", "item_idx").collect()]
    assert got == ["1-0", "1-1", "1-2", "1-3", "2-0", "2-1"]


def test_reports_and_strict(spark):
    df = items_df(spark, [("s", "r", 0, {"id": "1"}), ("s", "r", 1, {"id": "1"}), ("s", "r", 2, {"x": "y"})])
    d = dedupe.duplicate_keys(df, "id").collect()
    assert [(r.dedupe_key, r.n) for r in d] == [("1", 2)]
    assert dedupe.missing_keys(df, "id").count() == 1
    with pytest.raises(ValueError, match="missing"):
        dedupe.strict(df, "id")
    with pytest.raises(ValueError, match="repeated"):
        dedupe.strict(df.where(F.col("item_idx") < 2), "id")
