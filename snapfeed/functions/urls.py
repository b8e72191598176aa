"""URL helpers: host extraction and RFC 3986 joins.

Absolute links and plain root-relative paths are resolved in the JVM; only
the remaining shapes (``../x``, ``?q``, ``//host``, bare names) go through an
Arrow UDF around ``urllib.parse.urljoin``.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import _col

# Prefixes kept as they are when resolving item links.
ABSOLUTE_PREFIXES = ("http://", "https://", "mailto:", "data:")
_ORIGIN_RE = "^(https?://[^/?#]*)"
_DOT_SEGMENT_RE = "(^|/)\\.\\.?(/|[?#]|$)"


@F.pandas_udf(T.StringType())
def _urljoin_udf(base: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if (b is None or r is None) else urljoin(b, r) for b, r in zip(base, ref)],
                     dtype=object)


def urljoin_col(base, ref) -> Column:
    """``urljoin(base, ref)`` with a JVM fast path for root-relative refs."""
    base, ref = _col(base), _col(ref)
    fast = (
        base.rlike("^https?://")
        & ref.rlike("^/[^/]")
        & ~ref.rlike(_DOT_SEGMENT_RE)
        & ~ref.rlike("[\\t\\n\\r]")
        & ~base.rlike("[\\t\\n\\r]")
    )
    origin = F.regexp_extract(base, _ORIGIN_RE, 1)
    slow = _urljoin_udf(F.when(~fast, base), F.when(~fast, ref))
    return F.when(base.isNull() | ref.isNull(), F.lit(None)) \
        .when(fast, F.concat(origin, ref)).otherwise(slow)


def resolve_url(ref, base) -> Column:
    """Item link resolution: keep empty, keep absolute/mailto/data, no base -> raw."""
    ref, base = _col(ref), _col(base)
    keep = (ref.isNull() | (ref == "") | base.isNull() | (base == "")
            | F.startswith(ref, F.lit("http://")) | F.startswith(ref, F.lit("https://"))
            | F.startswith(ref, F.lit("mailto:")) | F.startswith(ref, F.lit("data:")))
    return F.when(keep, ref).otherwise(urljoin_col(base, ref))


def resolve_next_url(ref, page_url) -> Column:
    """Pagination link resolution: links starting with ``http`` are followed as is,
    everything else is joined with the current page's URL."""
    ref, page_url = _col(ref), _col(page_url)
    return F.when(ref.isNull() | (ref == ""), F.lit(None)) \
        .when(F.startswith(ref, F.lit("http")), ref) \
        .otherwise(urljoin_col(page_url, ref))


def url_host(url) -> Column:
    """Lower-cased host of a URL (brackets of IPv6 literals removed)."""
    h = F.regexp_extract(_col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?(\\[[^\\]]*\\]|[^:/?#]*)", 1)
    return F.lower(F.regexp_replace(h, "^\\[|\\]$", ""))


def url_origin(url) -> Column:
    return F.regexp_extract(_col(url), _ORIGIN_RE, 1)
