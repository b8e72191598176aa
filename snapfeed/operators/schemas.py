"""Spark schemas of the tables the operators exchange."""

from pyspark.sql import types as T

FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("selector_type", T.StringType()),
    T.StructField("attr", T.StringType()),
])
ACTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("selector", T.StringType()),
    T.StructField("ms", T.IntegerType()),
    T.StructField("text", T.StringType()),
])
CONFIG = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("render", T.BooleanType()),
    T.StructField("schedule", T.StringType()),
    T.StructField("rate_limit", T.StructType([T.StructField("rps", T.IntegerType())])),
    T.StructField("item", T.StructType([
        T.StructField("container", T.StringType()),
        T.StructField("container_type", T.StringType()),
        T.StructField("fields", T.ArrayType(FIELD)),
        T.StructField("dedupe_key", T.StringType()),
    ])),
    T.StructField("pagination", T.StructType([
        T.StructField("next", T.StringType()),
        T.StructField("next_type", T.StringType()),
        T.StructField("max_pages", T.IntegerType()),
    ])),
    T.StructField("wait_for", T.StringType()),
    T.StructField("actions", T.ArrayType(ACTION)),
    T.StructField("health", T.StructType([
        T.StructField("min_items", T.IntegerType()),
        T.StructField("max_staleness", T.StringType()),
    ])),
])

# The keys each config level accepts (anything else is rejected).
ALLOWED_KEYS = {
    "top": ("name", "description", "url", "render", "schedule", "rate_limit", "item", "pagination",
            "wait_for", "actions", "health"),
    "item": ("container", "container_type", "fields", "dedupe_key"),
    "field": ("name", "selector", "selector_type", "attr"),
    "pagination": ("next", "next_type", "max_pages"),
    "action": ("type", "selector", "ms", "text"),
    "health": ("min_items", "max_staleness"),
    "rate_limit": ("rps",),
}
SELECTOR_TYPES = ("css", "xpath")
ACTION_TYPES = ("click", "wait", "scroll", "type")

PROPOSAL = T.StructType([
    T.StructField("selector", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("sample_values", T.ArrayType(T.StringType())),
])
