"""Corpus pipeline: documents in, packed training sequences out.

Five stages, each calling one operator of ``snapfeed.llm``; every stage's result
is written as Parquet in the shared folder and reread as the next one's
``docs``. All but the last return the columns of ``documents``.

Defined cases: a row with a null text passes the first three stages as it is
(nothing to score, no copy of it, nothing to redact), has no words for the mix to
take, and so ends there; an empty text likewise, but equal ones are copies;
repeated rows are copies of each other; null ids, sources and languages are
values like others; very long texts are read whole; further columns, whatever
their names, are carried up to the packing; an empty table gives an empty table
at every stage, and without labels nothing is called toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapfeed.llm import mixing, neardup, packing, secrets, toxicity
from snapfeed.llm.common import prepare, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier doesn't call toxic."""
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    prepare(spark)
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with the secrets in them replaced."""
    prepare(spark)
    return secrets.redacted_docs(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them."""
    prepare(spark)
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents in sequences of balanced cost."""
    prepare(spark)
    return packing.pack(docs, packing.vocabulary_path(), with_ids=False)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("secrets", redact_secrets),
          ("mixing", mix_sources), ("packing", pack_sequences)]

# Compression lengths and token ids cannot be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
