"""Projections of item maps: content text, URL pick, stable id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import content_hash
from .text import _col

# Keys that supply content text first, in this order.
CONTENT_KEYS = ("title", "content", "body", "summary")
# Keys left out of the fallback content text.
STRICT_EXCLUDE = ("id", "url", "html_snapshot_url")
VIEW_EXCLUDE = ("id", "url", "link", "href", "html_snapshot_url")
# Keys searched for an item's link, first non-empty wins.
URL_KEYS = ("url", "link", "href")


def content_text(m, exclude=STRICT_EXCLUDE) -> Column:
    """Non-empty title/content/body/summary joined by newlines; else every other
    non-empty value in key order, minus the excluded keys."""
    m = _col(m)
    preferred = F.filter(F.array(*[m[k] for k in CONTENT_KEYS]), lambda v: v.isNotNull() & (v != ""))
    excluded = F.array(*[F.lit(k) for k in exclude])
    rest = F.filter(
        F.array_sort(F.arrays_zip(F.map_keys(m).alias("k"), F.map_values(m).alias("v"))),
        lambda e: ~F.array_contains(excluded, e["k"]) & e["v"].isNotNull() & (e["v"] != ""),
    )
    fallback = F.array_join(F.transform(rest, lambda e: e["v"]), "\n")
    return F.when(F.size(preferred) > 0, F.array_join(preferred, "\n")).otherwise(fallback)


def pick_url(m) -> Column:
    """First non-empty of url, link, href; empty string when none."""
    m = _col(m)
    return F.coalesce(*[F.nullif(m[k], F.lit("")) for k in URL_KEYS], F.lit(""))


def scrape_item_columns(m, key_col) -> list[Column]:
    """The flat scrape-result row: stable_id, url, title, content_text, content_hash."""
    m = _col(m)
    text = content_text(m, STRICT_EXCLUDE)
    chash = content_hash(text)
    key = _col(key_col)
    return [
        F.coalesce(F.nullif(key, F.lit("")), chash).alias("stable_id"),
        F.coalesce(F.nullif(m["url"], F.lit("")), F.lit("")).alias("url"),
        F.coalesce(F.nullif(m["title"], F.lit("")), F.lit("")).alias("title"),
        text.alias("content_text"),
        chash.alias("content_hash"),
        m["html_snapshot_url"].alias("html_snapshot_url"),
    ]
