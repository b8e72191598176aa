"""Shared plan helpers: timestamp normalisation, default columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once however
    often it is used, and a lost executor costs a reread."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_ts(c) -> Column:
    """Cast to session-zone TIMESTAMP (driver parquet holds TIMESTAMP_NTZ)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp")


def as_ntz(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp_ntz")


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    for name, col in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, col)
    return df
