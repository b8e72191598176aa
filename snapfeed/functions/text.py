"""String normalisation: Python-compatible strip and Unicode NFC."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes (str.isspace()).
# Spark's trim() without them removes only U+0020.
PY_WHITESPACE = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                  0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Characters below U+0300 never change under NFC and never compose with a
# preceding character, so only values holding a code point >= U+0300 need the
# Python round trip; everything else stays in the JVM.
_NEEDS_NFC_RE = "[^\\x{00}-\\x{2FF}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """``str.strip()`` semantics for a string column (null stays null)."""
    return F.btrim(_col(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """True when null or made only of Python whitespace."""
    c = _col(c)
    return c.isNull() | (pystrip(c) == F.lit(""))


def needs_nfc(c) -> Column:
    return _col(c).rlike(_NEEDS_NFC_RE)


@F.pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfc_array_udf(s: pd.Series) -> pd.Series:
    def norm(vals):
        if vals is None:
            return None
        return [v if v is None else unicodedata.normalize("NFC", v) for v in vals]

    return s.map(norm)


@functools.lru_cache(maxsize=1)
def icu_available() -> bool:
    """Spark 4 ships ICU4J (used for collations); its static NFC composition
    can then run in the JVM through ``reflect`` instead of a Python UDF."""
    spark = SparkSession.getActiveSession()
    jvm = getattr(spark, "_jvm", None) if spark is not None else None
    if jvm is None:
        return False
    try:
        jvm.java.lang.Class.forName("com.ibm.icu.text.Normalizer")
        return True
    except Exception:
        return False


def _icu_nfc(c: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))


def nfc(c) -> Column:
    """Unicode NFC. Values that cannot change (no code point >= U+0300) are
    never touched; the rest go through ICU in the JVM, or through the Arrow
    UDF (fed null for unchanged rows) when ICU is not on the classpath."""
    c = _col(c)
    if icu_available():
        return F.when(needs_nfc(c), _icu_nfc(c)).otherwise(c)
    return F.coalesce(_nfc_udf(F.when(needs_nfc(c), c)), c)


def nfc_values(arr) -> Column:
    """NFC of every element of an array<string>; arrays needing no change skip it."""
    arr = _col(arr)
    if icu_available():
        return F.transform(arr, lambda v: F.when(v.rlike(_NEEDS_NFC_RE), _icu_nfc(v)).otherwise(v))
    needs = F.exists(arr, lambda v: v.rlike(_NEEDS_NFC_RE))
    return F.coalesce(_nfc_array_udf(F.when(needs, arr)), arr)
