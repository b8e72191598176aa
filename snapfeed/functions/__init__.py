"""Column functions; everything returns a ``pyspark.sql.Column``."""

from .hashing import config_sha, content_hash, item_hash, json_escape, sorted_map_json
from .hosts import host_is_public
from .items import content_text, pick_url, scrape_item_columns, STRICT_EXCLUDE, VIEW_EXCLUDE
from .misc import duration_ms, percent_text, slug_ok, staleness_interval
from .text import is_blank, nfc, nfc_values, pystrip
from .urls import resolve_next_url, resolve_url, url_host, url_origin, urljoin_col

__all__ = [
    "config_sha", "content_hash", "item_hash", "json_escape", "sorted_map_json", "host_is_public",
    "content_text", "pick_url", "scrape_item_columns", "STRICT_EXCLUDE", "VIEW_EXCLUDE",
    "duration_ms", "percent_text", "slug_ok", "staleness_interval",
    "is_blank", "nfc", "nfc_values", "pystrip", "resolve_next_url", "resolve_url", "url_host",
    "url_origin", "urljoin_col",
]
