"""Item hash, content hash and config hash as JVM expressions.

The item hash is SHA-256 over the compact JSON of the item with keys sorted,
string values stripped and NFC-normalised, nulls written as ``null`` and
non-ASCII kept (Python ``json.dumps(sort_keys=True, ensure_ascii=False,
separators=(",", ":"))``). The JSON text is assembled with column functions
so that escapes match Python byte for byte (Jackson writes ``\\u001F``, Python
``\\u001f``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, icu_available, nfc, nfc_values, pystrip

# Python json short escapes for control characters.
_SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
_USUAL = (9, 10, 13)
_LINES_RE = "\\A[\\]-\\x{2FF}#-\\[ !\\n]*\\z"  # the same without quotes, backslashes, tabs and returns
_PLAIN_RE = "\\A[\\x{20}-\\x{2FF}\\t\\n\\r]*\\z"  # nothing that NFC changes, no control character but the usual
_RARE_RE = "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}]"


def json_escape(c) -> Column:
    """Escape a string for a JSON string literal the way Python's json does."""
    c = _col(c)
    usual = _usual_escapes(c)
    out = usual
    for code in set(range(32)).difference(_USUAL):
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT_ESCAPES.get(code, "\\u%04x" % code)))
    # every replacement reads the whole value: the rare ones only where one is needed
    return F.when(c.rlike(_RARE_RE), out).otherwise(usual)


def _usual_escapes(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in _USUAL:
        out = F.replace(out, F.lit(chr(code)), F.lit(_SHORT_ESCAPES[code]))
    return out


def json_text(c) -> Column:
    """A string column as a JSON value: quoted and escaped, or ``null``."""
    c = _col(c)
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), json_escape(c), F.lit('"')))


def sorted_map_json(m) -> Column:
    """Compact JSON object of a map<string,string>, keys in code-point order."""
    m = _col(m)
    entries = F.array_sort(F.arrays_zip(F.map_keys(m).alias("k"), F.map_values(m).alias("v")))
    return _entries_json(entries)


def _entries_json(entries: Column, value=json_text) -> Column:
    parts = F.transform(entries, lambda e: F.concat(json_text(e["k"]), F.lit(":"), value(e["v"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def _normal_text(v: Column) -> Column:
    """A stripped value as a JSON value of its NFC form. One look tells whether a
    value is its own NFC form and has nothing to escape but line feeds, a second
    one whether the usual escapes do; the others are composed once (the array
    binds the result)."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    composed = F.element_at(F.transform(F.array(nfc(v)), json_text), 1)
    return (F.when(v.rlike(_LINES_RE), quoted(F.replace(v, F.lit("\n"), F.lit("\\n"))))
            .when(v.rlike(_PLAIN_RE), quoted(_usual_escapes(v))).otherwise(composed))


def normalized_entries(m) -> Column:
    """Sorted (key, value) pairs with values stripped then NFC-normalised."""
    m = _col(m)
    keys = F.map_keys(m)
    vals = nfc_values(F.transform(F.map_values(m), lambda v: pystrip(v)))
    return F.array_sort(F.arrays_zip(keys.alias("k"), vals.alias("v")))


def item_hash(m) -> Column:
    """Content hash of an item map (drives new / updated / unchanged)."""
    if icu_available():
        m = _col(m)
        stripped = F.transform(F.map_values(m), lambda v: pystrip(v))
        entries = F.array_sort(F.arrays_zip(F.map_keys(m).alias("k"), stripped.alias("v")))
        return F.sha2(_entries_json(entries, _normal_text), 256)
    return F.sha2(_entries_json(normalized_entries(m)), 256)


def content_hash(text) -> Column:
    """SHA-256 of NFC(text), no strip (the per-item content hash of a scrape result)."""
    return F.sha2(nfc(text), 256)


def config_sha(text) -> Column:
    """First 12 hex characters of SHA-256 of a config text."""
    return F.substring(F.sha2(_col(text), 256), 1, 12)
