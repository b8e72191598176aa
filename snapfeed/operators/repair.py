"""Health checks and selector repair (HLT1-HLT3, RPR1-RPR5, SNK5, FN13, FN14).

Proposals are an input table (the reference asks a remote model; here any
producer — people, a model, or ``mine_candidates`` — writes proposal rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import config_sha
from ..functions.misc import percent_text, staleness_interval
from .extract import test_selectors
from .schemas import PROPOSAL

CONTAINER = "container"


def unhealthy(runs: DataFrame, sources: DataFrame) -> DataFrame:
    """HLT1 + FLT7 + JOIN5: ok runs whose (capped, deduped) item count is below
    the source's ``health.min_items`` (only when min_items > 0)."""
    cfg = sources.select(F.col("id").alias("source_id"),
                                           F.col("config.health.min_items").alias("min_items"))
    return runs.where(F.col("status") == "ok").join(cfg, "source_id") \
        .where((F.col("min_items") > 0) & (F.col("item_count") < F.col("min_items")))


def broken_fields(raw_items: DataFrame, sources: DataFrame) -> DataFrame:
    """AGG7: configured fields that are null in every extracted item of a
    source; a source with no items has no broken fields.

    Items contribute only the names of their non-null fields (partial
    aggregation map-side), which are anti-joined with the config's field list."""
    fields = sources.select(F.col("id").alias("source_id"),
                            F.explode("config.item.fields").alias("f")) \
        .select("source_id", F.col("f.name").alias("field_name"), F.col("f.selector").alias("old_selector"),
                F.col("f.selector_type").alias("selector_type"))
    it = raw_items.where(F.col("data").isNotNull())
    seen = it.select("source_id", F.explode(F.map_filter("data", lambda k, v: v.isNotNull())).alias("field_name", "_v")) \
        .select("source_id", "field_name").distinct()
    has_items = it.select("source_id").distinct()
    return fields.join(has_items, "source_id", "left_semi").join(seen, ["source_id", "field_name"], "left_anti")


def targets(raw_items: DataFrame, sources: DataFrame) -> DataFrame:
    """HLT2: zero items -> repair the container; else each broken field.
    Output: source_id, target, old_selector, selector_type."""
    has_items = raw_items.where(F.col("data").isNotNull()).select("source_id").distinct()
    containers = sources.select(F.col("id").alias("source_id"), F.lit(CONTAINER).alias("target"),
                                F.col("config.item.container").alias("old_selector"),
                                F.col("config.item.container_type").alias("selector_type")) \
        .join(has_items, "source_id", "left_anti")
    fields = broken_fields(raw_items, sources).select("source_id", F.col("field_name").alias("target"),
                                                      "old_selector", "selector_type")
    return containers.unionByName(fields)


def stale_sources(sources: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """HLT3: sources whose newest ok run is older than ``health.max_staleness``
    (or that never had one)."""
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, F.Column) else as_of
    last_ok = runs.where(F.col("status") == "ok").groupBy("source_id").agg(F.max("started_at").alias("last_ok_at"))
    s = sources.select(F.col("id").alias("source_id"), "name",
                       staleness_interval(F.col("config.health.max_staleness")).alias("_max_age"))
    return s.join(last_ok, "source_id", "left").where(
        F.col("last_ok_at").isNull() | (F.col("last_ok_at") < as_of - F.col("_max_age"))).drop("_max_age")


def parse_proposals(proposals: DataFrame, raw_col: str = "raw_json") -> DataFrame:
    """FN13: JSON text -> selector, confidence, reasoning, sample_values plus
    ``proposal_error`` (bad JSON, missing keys, confidence outside [0, 1]);
    extra keys are ignored, sample_values defaults to []."""
    raw = F.col(raw_col)
    keys = F.map_keys(F.from_json(raw, "map<string,string>"))
    p = F.from_json(raw, PROPOSAL)
    missing = F.filter(F.array(*[F.when(~F.array_contains(keys, F.lit(k)), F.lit(k))
                                 for k in ("selector", "confidence", "reasoning")]), lambda x: x.isNotNull())
    err = (F.when(keys.isNull(), F.lit("invalid JSON"))
           .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), F.array_join(missing, ", ")))
           .when(p["confidence"].isNull() | (p["confidence"] < 0) | (p["confidence"] > 1),
                 F.lit("confidence must be within [0, 1]"))
           .when(p["reasoning"].isNull(), F.lit("reasoning must be a string")))
    return proposals.select(
        "*", p["selector"].alias("selector"), p["confidence"].alias("confidence"), p["reasoning"].alias("reasoning"),
        F.coalesce(p["sample_values"], F.array().cast("array<string>")).alias("sample_values"),
        err.alias("proposal_error"))


def score(proposals: DataFrame, pages: DataFrame) -> DataFrame:
    """RPR1: a proposal is valid iff its selector matches at least one node of
    the source's current page (whole document). Proposals that did not parse
    (``proposal_error``) are not tested and never valid; they stay in the
    result, so that their heal rows say so. ``proposals``: source_id, target,
    selector, selector_type, ...; ``pages``: source_id, html."""
    usable = proposals.where(F.col("selector").isNotNull() & (F.col("selector") != ""))
    bad = F.col("proposal_error").isNotNull() if "proposal_error" in proposals.columns else F.lit(False)
    tested = test_selectors(usable.where(~bad), pages)
    failed = usable.where(bad).select("*", F.lit(None).cast("array<string>").alias("matches"), F.lit(0).alias("n_matches"),
                                      F.lit(None).cast("string").alias("selector_error"))
    return (tested.withColumn("valid", (F.col("n_matches") > 0) & F.col("selector_error").isNull())
            .unionByName(failed.withColumn("valid", F.lit(False))))


def apply(scored: DataFrame, sources: DataFrame, proposer_errors: DataFrame | None = None,
          as_of=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RPR2 + RPR3 + SNK5: returns (next_sources, heals, patches).

    api origin + valid -> config patched (container or the named field),
    mode db_patch, applied; file origin + valid -> mode pr, not applied, a
    patch record; invalid -> heal row, not applied; errored proposal -> heal
    row with empty selector and confidence 0; null selector -> no row. Of
    several valid proposals for one target the one with the highest confidence
    (then the least selector) is applied or becomes the patch record; the
    others are heal rows, not applied."""
    as_of = F.lit(as_of).cast("timestamp") if as_of is not None and not isinstance(as_of, F.Column) else as_of
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"),
                                           "origin")
    best = (scored.where("valid").groupBy("source_id", "target")
            .agg(F.min(F.struct((-F.col("confidence").cast("double")).alias("c"), F.col("selector").alias("s"))).alias("_b"))
            .select("source_id", "target", F.col("_b.s").alias("_best")))
    s = scored.join(src, "source_id").join(best, ["source_id", "target"], "left") \
        .withColumn("valid", F.col("valid") & F.col("selector").eqNullSafe(F.col("_best"))).drop("_best")
    mode = F.when(F.col("origin") == "file", "pr").otherwise("db_patch")
    applied = F.col("valid") & (F.col("origin") != "file")
    heals = s.select(
        "source_id", "run_id", F.col("target").alias("field_name"), "old_selector",
        F.col("selector").alias("new_selector"), "selector_type",
        F.col("confidence").cast("double").alias("confidence"), "reasoning", "sample_values",
        mode.alias("mode"), applied.alias("applied"))
    if proposer_errors is not None:
        e = proposer_errors.join(src, "source_id").select(
            "source_id", "run_id", F.col("target").alias("field_name"), "old_selector",
            F.lit("").alias("new_selector"), "selector_type", F.lit(0.0).alias("confidence"),
            F.concat(F.lit("no proposal: "), F.col("error")).alias("reasoning"),
            F.array().cast("array<string>").alias("sample_values"), mode.alias("mode"), F.lit(False).alias("applied"))
        heals = heals.unionByName(e)
    if as_of is not None:
        heals = heals.withColumn("created_at", as_of)
    patches = s.where(F.col("valid") & (F.col("origin") == "file")).select(
        "source_id", "source_name", F.col("target").alias("field_name"),
        F.concat(F.lit("heal/"), F.col("source_name")).alias("branch"),
        F.concat_ws(" ", F.lit("New selector for"), "target", F.lit("of"), "source_name").alias("title"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("replaces: "), F.col("old_selector")), F.concat(F.lit("with: "), F.col("selector")),
            F.concat(F.lit("sure to: "), percent_text(F.col("confidence"))), F.concat(F.lit("because: "), F.col("reasoning")),
            F.transform("sample_values", lambda v: F.concat(F.lit("finds: "), v))).alias("body"))
    # RPR3: one patch map per source (bounded by its field count), applied as struct edits
    patch = s.where(applied).groupBy("source_id").agg(
        F.map_from_entries(F.collect_set(F.struct("target", "selector"))).alias("_patch"))
    j = sources.join(patch, sources["id"] == patch["source_id"], "left").drop(patch["source_id"])
    cfg = F.col("config")
    p = F.col("_patch")
    new_fields = F.transform(cfg["item"]["fields"], lambda f: f.withField(
        "selector", F.coalesce(p[f["name"]], f["selector"])))
    patched = cfg.withField("item.container", F.coalesce(p[CONTAINER], cfg["item"]["container"])) \
        .withField("item.fields", new_fields)
    hit = p.isNotNull()
    new_text = F.to_json(patched)
    nxt = j.select(
        "id", "name", "description", "origin",
        F.when(hit, new_text).otherwise(F.col("config_yaml")).alias("config_yaml"),
        F.when(hit, config_sha(new_text)).otherwise(F.col("config_sha")).alias("config_sha"),
        "created_at",
        (F.when(hit, as_of).otherwise(F.col("updated_at")) if as_of is not None else F.col("updated_at")).alias("updated_at"),
        F.when(hit, patched).otherwise(cfg).alias("config"), "base_url")
    return nxt, heals, patches


def mine_candidates(pages: DataFrame, sources: DataFrame, min_pages: int = 1) -> DataFrame:
    """RPR5 (re-aimed): container candidates mined from the pages themselves —
    (tag.class) signatures of repeated elements ranked by how often they occur
    per page. Output: source_id, target='container', selector, per_page."""
    sig = pages.select("source_id", "page_id", F.explode(F.regexp_extract_all(
        F.col("html"), F.lit("<([a-zA-Z][a-zA-Z0-9]*)\\s[^>]*?class=[\"']([^\"' >]+)"), F.lit(0))).alias("m"))
    sig = sig.select("source_id", "page_id",
                     F.regexp_extract("m", "<([a-zA-Z][a-zA-Z0-9]*)", 1).alias("tag"),
                     F.regexp_extract("m", "class=[\"']([^\"' >]+)", 1).alias("cls"))
    per_page = sig.groupBy("source_id", "tag", "cls", "page_id").count()
    return per_page.groupBy("source_id", "tag", "cls").agg(
        F.count(F.lit(1)).alias("pages"), F.avg("count").alias("per_page")) \
        .where(F.col("pages") >= min_pages) \
        .select("source_id", F.lit(CONTAINER).alias("target"),
                F.concat(F.lower("tag"), F.lit("."), F.col("cls")).alias("selector"), "per_page")


def rank_candidates(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """RPR5: candidates (source_id, selector, per_page, ...) in the order in which
    their counts fit what the source's earlier good runs found (runs: source_id,
    status, item_count): a repeated element that is there as often as items used
    to be is the likelier container than a menu or a footer.

    Fit is the Poisson deviance of the count per page from the mean number of
    items, 0 for an exact fit. Adds ``expected``, ``misfit`` and ``place`` (from
    1; ties by selector). Sources without a good run that found anything rank by
    count alone (``misfit`` null)."""
    expected = (runs.where((F.col("status") == "ok") & (F.col("item_count") > 0)).groupBy(F.col("source_id").alias("_s"))
                .agg(F.avg("item_count").alias("expected")))
    j = candidates.join(expected, F.col("source_id") == F.col("_s"), "left").drop("_s")
    c, e = F.col("per_page"), F.col("expected")
    j = j.withColumn("misfit", F.round(2 * (c * F.log(c / e) - (c - e)), 6))
    order = Window.partitionBy("source_id").orderBy(F.col("misfit").asc_nulls_last(), F.desc("per_page"), F.asc("selector"))
    return j.withColumn("place", F.row_number().over(order))


def repair_inputs(targets_df: DataFrame, pages: DataFrame) -> DataFrame:
    """FN12: what a proposal producer sees per target — the old selector and
    the source's whole current page."""
    return targets_df.join(pages.select("source_id", F.col("html").alias("page_html")), "source_id")
