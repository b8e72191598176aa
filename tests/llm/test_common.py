from pyspark.sql import functions as F

from snapfeed.llm.common import sifted


def test_sifted_keeps_every_key_and_little_else(llm):
    rows = llm.range(5000).select(F.when(F.col("id") % 100 != 7, F.col("id")).alias("a"), F.col("id").cast("string").alias("b"), F.lit(1).alias("_x"))
    keys = rows.where("b % 50 = 7").select("b", "a")
    kept = sifted(rows, keys, ["a", "b"])
    assert kept.columns == rows.columns
    got = {r["b"] for r in kept.collect()}
    assert {str(i) for i in range(7, 5000, 50)} <= got and len(got) < 110
    assert sifted(rows, keys.limit(0), ["a", "b"]).count() == 0
