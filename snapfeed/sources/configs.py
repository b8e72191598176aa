"""SRC3: YAML config files -> configs table (one row per document).

Files are read with ``wholetext`` (one row per file); YAML is parsed inside an
Arrow-batched task into JSON text, after which every check is a column
(operators.config_checks.violations)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:  # PyYAML is optional; without it only JSON documents load
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

from ..operators.config_checks import violations

_OUT = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("config_yaml", T.StringType()),
    T.StructField("raw_json", T.StringType()),
    T.StructField("parse_error", T.StringType()),
])


def _to_json(text: str):
    try:
        data = yaml.safe_load(text) if yaml is not None else json.loads(text)
    except Exception as exc:
        return None, f"YAML error: {exc}".splitlines()[0]
    if not isinstance(data, dict):
        return None, "YAML must parse to a mapping, got: " + type(data).__name__
    return json.dumps(data, default=str), None


def _parse_batches(batches):
    for pdf in batches:
        raws, errs = [], []
        for text in pdf["value"]:
            j, e = _to_json(text)
            raws.append(j)
            errs.append(e)
        yield pd.DataFrame({"file": pdf["file"], "config_yaml": pdf["value"], "raw_json": raws, "parse_error": errs})


def parse_texts(texts: DataFrame, text_col: str = "config_yaml", file_col: str | None = None) -> DataFrame:
    """YAML text column -> file, config_yaml, raw_json, parse_error."""
    src = texts.select((F.col(file_col) if file_col else F.lit(None).cast("string")).alias("file"),
                       F.col(text_col).alias("value"))
    return src.mapInPandas(_parse_batches, _OUT)


def load_configs(spark: SparkSession, path: str) -> DataFrame:
    """Configs from a folder of ``*.yaml`` files, sorted by file name, with
    ``config`` (defaults applied), ``name`` and ``violations``."""
    files = spark.read.text(f"{path.rstrip('/')}/*.yaml", wholetext=True) \
        .withColumn("file", F.input_file_name())
    parsed = parse_texts(files, "value", "file")
    checked = violations(parsed, "raw_json")
    return checked.withColumn("name", F.col("config.name")).orderBy("file")
