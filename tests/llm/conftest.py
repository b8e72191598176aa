import pytest

from snapfeed.llm.common import prepare

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHING = ("size", "taken", "key", "md5", "uid", "tid", "bucket", "label", "score", "value", "node", "a", "b", "_row", "_m")


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture()
def docs_of(llm):
    """documents from (doc_id, text[, source]) rows; ``extra`` adds columns with clashing names."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = llm.createDataFrame(full, COLUMNS)
        if extra:
            from pyspark.sql import functions as F

            for name in CLASHING:
                df = df.withColumn(name, F.lit("x"))
        return df

    return make

