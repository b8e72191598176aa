"""Bulk config validation (CFG1-CFG8, FLT6, FLT8, EXT9).

Every rule is a column over a table of configs, so thousands of submitted or
file configs are checked in one job; the result is an array of violation
messages per row (valid = empty array). Selector syntax is the only rule that
needs Python (the selector compiler), via one Arrow UDF per row.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hosts import host_is_public
from ..functions.misc import slug_ok
from ..functions.urls import url_host
from . import dom
from .schemas import ACTION_TYPES, ALLOWED_KEYS, CONFIG, SELECTOR_TYPES


@F.pandas_udf(T.ArrayType(T.StringType()))
def _selector_errors(specs: pd.Series) -> pd.Series:
    def check(js):
        if js is None:
            return []
        errs = []
        for spec in json.loads(js):
            sel = spec.get("s")
            if sel is None:
                continue
            err = dom.check_selector(sel, spec.get("t") or "css")
            if err:
                errs.append(err)
        return errs
    return specs.map(check)


def with_defaults(p: Column) -> Column:
    """A parsed config with defaults filled in, built as one struct over the
    parsed column (each field of ``p`` is read once; no chained rewrites)."""
    item, pag, health = p["item"], p["pagination"], p["health"]
    fields = F.transform(item["fields"], lambda f: F.struct(
        f["name"].alias("name"), f["selector"].alias("selector"),
        F.coalesce(f["selector_type"], F.lit("css")).alias("selector_type"), f["attr"].alias("attr")))
    return F.struct(
        p["name"].alias("name"),
        F.coalesce(p["description"], F.lit("")).alias("description"),
        p["url"].alias("url"),
        F.coalesce(p["render"], F.lit(False)).alias("render"),
        p["schedule"].alias("schedule"),
        F.struct(F.coalesce(p["rate_limit"]["rps"], F.lit(1)).alias("rps")).alias("rate_limit"),
        F.when(item.isNotNull(), F.struct(
            item["container"].alias("container"),
            F.coalesce(item["container_type"], F.lit("css")).alias("container_type"),
            fields.alias("fields"), item["dedupe_key"].alias("dedupe_key"))).alias("item"),
        F.struct(pag["next"].alias("next"), F.coalesce(pag["next_type"], F.lit("css")).alias("next_type"),
                 F.coalesce(pag["max_pages"], F.lit(1)).alias("max_pages")).alias("pagination"),
        p["wait_for"].alias("wait_for"),
        F.coalesce(p["actions"], F.array().cast(CONFIG["actions"].dataType)).alias("actions"),
        F.struct(F.coalesce(health["min_items"], F.lit(1)).alias("min_items"),
                 F.coalesce(health["max_staleness"], F.lit("24h")).alias("max_staleness")).alias("health"))


# Members by level: (name, kinds they may have, whether they must be there).
# Kinds are those of schema_of_variant; null counts as absent only where VOID is listed.
_TEXT, _MAYBE = ("STRING",), ("STRING", "VOID")
MEMBERS = {
    "": [("name", _TEXT, True), ("url", _TEXT, True), ("schedule", _TEXT, True), ("description", _TEXT, False),
         ("wait_for", _MAYBE, False), ("item", ("OBJECT",), True), ("pagination", ("OBJECT",), False),
         ("health", ("OBJECT",), False), ("rate_limit", ("OBJECT",), False), ("actions", ("ARRAY",), False)],
    "item.": [("container", _TEXT, True), ("container_type", _TEXT, False), ("dedupe_key", _TEXT, True), ("fields", ("ARRAY",), True)],
    "pagination.": [("next", _MAYBE, False), ("next_type", _TEXT, False)],
    "health.": [("max_staleness", _TEXT, False)],
}
WHOLE_NUMBERS = ("pagination.max_pages", "health.min_items", "rate_limit.rps")
FIELD_MEMBERS = [("name", _TEXT, True), ("selector", _TEXT, True), ("selector_type", _TEXT, False), ("attr", _MAYBE, False)]
ACTION_MEMBERS = [("type", _TEXT, True), ("selector", _MAYBE, False), ("ms", ("BIGINT", "VOID"), False), ("text", _MAYBE, False)]
# Texts that count as true or false.
TRUTH = ("true", "false", "yes", "no", "on", "off", "1", "0", "t", "f", "y", "n")


def _kind(doc: Column, path: str) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, OBJECT, ARRAY, VOID; null where there is no such member."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(doc, f"$.{path}", "variant")), "^[A-Z]+", 0)


def _member_faults(doc: Column, where: str, members: list) -> list[Column]:
    """Messages for members of the wrong kind and for required ones that are absent."""
    out = []
    for name, kinds, needed in members:
        kind = _kind(doc, name)
        absent = F.when(kind.isNull(), F.lit(f"{where}{name}: field required")) if needed else F.lit(None).cast("string")
        out.append(F.when(kind.isNotNull() & ~kind.isin(*kinds), F.lit(f"{where}{name}: wrong type")).otherwise(absent))
    return out


def kind_faults(doc: Column) -> list[Column]:
    """Strict kinds of the top levels of a config document (a variant)."""
    out = []
    for level, members in MEMBERS.items():
        there = _kind(doc, level[:-1]) == "OBJECT" if level else F.lit(True)
        paths = [(level + name, kinds, needed) for name, kinds, needed in members]
        out += [F.when(there, m) for m in _member_faults(doc, "", paths)]
    for path in WHOLE_NUMBERS:
        kind = _kind(doc, path)
        text = F.try_variant_get(doc, f"$.{path}", "string")
        whole = ((kind == "BIGINT") | (kind.isin("DECIMAL", "DOUBLE") & (text.try_cast("double") == F.floor(text.try_cast("double"))))
                 | ((kind == "STRING") & text.rlike("^\\s*[+-]?[0-9]+\\s*$")))
        out.append(F.when(kind.isNotNull() & ~whole, F.lit(f"{path}: not a whole number")))
    kind, text = _kind(doc, "render"), F.lower(F.try_variant_get(doc, "$.render", "string"))
    out.append(F.when(kind.isNotNull() & ~((kind == "BOOLEAN") | (kind.isin("STRING", "BIGINT") & text.isin(*TRUTH))),
                      F.lit("render: not true or false")))
    return out


def _each(items: Column, where: str, members: list) -> Column:
    """The faults of every object of an array of JSON texts, as one array."""
    def faults(x):
        doc = F.try_parse_json(x)
        return F.filter(F.array(F.when(~F.startswith(F.ltrim(x), F.lit("{")), F.lit(f"{where}: not a mapping")),
                                *_member_faults(doc, f"{where}.", members)), lambda m: m.isNotNull())

    return F.coalesce(F.flatten(F.transform(items, faults)), F.array().cast("array<string>"))


def parse_config_json(raw_json) -> Column:
    raw = F.col(raw_json) if isinstance(raw_json, str) else raw_json
    return with_defaults(F.from_json(raw, CONFIG))


def _unknown(level: str, raw_obj: Column) -> Column:
    keys = F.map_keys(F.from_json(raw_obj, "map<string,string>"))
    bad = F.array_except(keys, F.array(*[F.lit(k) for k in ALLOWED_KEYS[level]]))
    return F.when(F.size(bad) > 0, F.concat(F.lit(f"{level}: extra keys not permitted: "), F.array_join(bad, ", ")))


def violations(df: DataFrame, raw_col: str = "raw_json", check_hosts: bool = False) -> DataFrame:
    """CFG1: adds ``config`` (parsed, defaults applied) and ``violations``
    array<string>. ``raw_col`` holds the config document as JSON text; a
    ``parse_error`` column, when present, is reported as a violation.

    Each JSON level is parsed once into its own column before the rules read
    it, so the parse is not repeated per rule."""
    raw = F.col(raw_col)
    d = df.withColumn("_p", F.from_json(raw, CONFIG)).withColumn("_top", F.from_json(raw, "map<string,string>")) \
        .withColumn("_doc", F.try_parse_json(raw))
    # numbers and truth values that are written as texts count as what they say
    number = lambda path: F.floor(F.try_variant_get(F.col("_doc"), f"$.{path}", "string").try_cast("double")).cast("int")
    said = F.lower(F.try_variant_get(F.col("_doc"), "$.render", "string"))
    d = d.withColumn("_p", F.col("_p").withField("render", F.coalesce(F.col("_p.render"), F.when(said.isin(*TRUTH), said.isin(
        "true", "yes", "on", "1", "t", "y")))))
    for path in WHOLE_NUMBERS:
        top, leaf = path.split(".")
        d = d.withColumn("_p", F.col("_p").withField(top, F.when(F.col(f"_p.{top}").isNotNull(), F.col(f"_p.{top}").withField(
            leaf, F.coalesce(F.col(f"_p.{top}.{leaf}"), number(path))))))
    d = d.withColumn("config", with_defaults(F.col("_p"))) \
        .withColumn("_item_raw", F.from_json(F.col("_top")["item"], "map<string,string>")) \
        .withColumn("_actions_raw", F.from_json(F.col("_top")["actions"], "array<string>"))
    d = d.withColumn("_fields_raw", F.from_json(F.col("_item_raw")["fields"], "array<string>"))
    c = F.col("config")
    top_raw = F.col("_top")
    names = F.transform(c["item"]["fields"], lambda f: f["name"])
    empty = F.array().cast("array<string>")
    field_unknown = F.coalesce(F.filter(F.transform(F.col("_fields_raw"), lambda f: _unknown("field", f)),
                                        lambda x: x.isNotNull()), empty)
    action_unknown = F.coalesce(F.filter(F.transform(F.col("_actions_raw"), lambda a: _unknown("action", a)),
                                         lambda x: x.isNotNull()), empty)
    bad_actions = F.filter(c["actions"], lambda a: a["type"].isNotNull() & (
        ~a["type"].isin(*ACTION_TYPES)
        | (a["type"].isin("click", "type") & a["selector"].isNull())
        | ((a["type"] == "wait") & a["ms"].isNull())))
    sel_specs = F.to_json(F.concat(
        F.array(F.struct(c["item"]["container"].alias("s"), c["item"]["container_type"].alias("t"))),
        F.transform(c["item"]["fields"], lambda f: F.struct(f["selector"].alias("s"), f["selector_type"].alias("t"))),
        F.array(F.struct(c["pagination"]["next"].alias("s"), c["pagination"]["next_type"].alias("t")))))
    bad_types = F.filter(F.concat(F.array(c["item"]["container_type"], c["pagination"]["next_type"]),
                                  F.coalesce(F.transform(c["item"]["fields"], lambda f: f["selector_type"]), empty)),
                         lambda t: ~t.isin(*SELECTOR_TYPES))
    rules = [
        F.when(top_raw.isNull(), F.lit("config: not a JSON/YAML mapping")),
        F.when(c["name"].isNotNull() & ~c["name"].rlike("^[a-z0-9-]+\\z"),
               F.lit("name: must match ^[a-z0-9-]+$")),
        F.when(c["url"].isNotNull() & ~c["url"].rlike("^(?i)https?://[^/?#\\s@]*[^/?#\\s@:][^\\s]*$"),
               F.lit("url: invalid URL")),
        F.when(c["item"].isNotNull() & (F.size(c["item"]["fields"]) < 1),
               F.lit("item.fields: at least 1 field required")),
        F.when(c["item"].isNotNull() & (F.size(c["item"]["fields"]) >= 1)
               & ~F.array_contains(names, c["item"]["dedupe_key"]),
               F.concat(F.lit("item.dedupe_key: no field has the name "), F.coalesce(c["item"]["dedupe_key"], F.lit("(none)")))),
        F.when(F.size(F.array_distinct(names)) != F.size(names), F.lit("item.fields: duplicate field names")),
        F.when(F.size(bad_types) > 0, F.lit("selector_type: must be css or xpath")),
        F.when(c["pagination"]["max_pages"] < 1, F.lit("pagination.max_pages: must be >= 1")),
        F.when(c["health"]["min_items"] < 0, F.lit("health.min_items: must be >= 0")),
        F.when(c["rate_limit"]["rps"] < 1, F.lit("rate_limit.rps: must be >= 1")),
        F.when(~c["render"] & (F.size(c["actions"]) > 0), F.lit("render: actions need render=true")),
        F.when(~c["render"] & c["wait_for"].isNotNull(),
               F.lit("render: wait_for needs render=true")),
        F.when(F.size(bad_actions) > 0, F.lit("actions: click/type need selector, wait needs ms, type in click/wait/scroll/type")),
        *kind_faults(F.col("_doc")),
        _unknown("top", raw),
        _unknown("item", top_raw["item"]),
        _unknown("pagination", top_raw["pagination"]),
        _unknown("health", top_raw["health"]),
        _unknown("rate_limit", top_raw["rate_limit"]),
    ]
    if "parse_error" in df.columns:
        rules.insert(0, F.col("parse_error"))
    if check_hosts:
        rules.append(F.when(~host_is_public(url_host(c["url"])), F.lit("url: host is not public")))
    msgs = F.concat(F.filter(F.array(*rules), lambda x: x.isNotNull()), field_unknown, action_unknown,
                    _each(F.col("_fields_raw"), "item.fields", FIELD_MEMBERS), _each(F.col("_actions_raw"), "actions", ACTION_MEMBERS),
                    F.coalesce(_selector_errors(F.when(c["item"].isNotNull(), sel_specs)), empty))
    return d.withColumn("violations", msgs).drop("_p", "_top", "_doc", "_item_raw", "_actions_raw", "_fields_raw")


def public_hosts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """FLT6 over a table of URLs: adds ``host`` and ``is_public``."""
    return urls.withColumn("host", url_host(F.col(url_col))) \
        .withColumn("is_public", host_is_public(F.col("host")))


# Request bounds (items per source and sources per batch request).
MAX_ITEMS_RANGE = (1, 100)
SOURCES_PER_REQUEST = (1, 10)


NAME_LENGTH = 64  # of a request's name


def request_violations(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """CFG8: batch requests as rows (request_id, source, max_items) checked with
    aggregates: 1..10 sources, no repeated source, max_items within 1..100, and
    FLT8, where requests have a ``name``: lower-case letters, digits and hyphens,
    64 at most."""
    lo, hi = MAX_ITEMS_RANGE
    slo, shi = SOURCES_PER_REQUEST
    named = "name" in requests.columns
    agg = requests.groupBy(key).agg(
        *([F.bool_and(F.coalesce(slug_ok("name", NAME_LENGTH), F.lit(False))).alias("name_ok")] if named else []),
        F.count(F.lit(1)).alias("n_sources"), F.count_distinct("source").alias("n_distinct"),
        F.min("max_items").alias("_min_items"), F.max("max_items").alias("_max_items"))
    return agg.select(
        key, "n_sources",
        F.col("n_sources").between(slo, shi).alias("count_ok"),
        (F.col("n_sources") == F.col("n_distinct")).alias("unique_ok"),
        ((F.col("_min_items") >= lo) & (F.col("_max_items") <= hi)).alias("max_items_ok"), *(["name_ok"] if named else []))
