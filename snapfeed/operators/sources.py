"""Source registry changes as joins (UPS1-UPS5, JOIN10, FN3, AGG11).

Each operation takes the current ``sources`` table and a table of requests
and returns (next_sources, outcomes); nothing is mutated in place.
sources: id, name, description, origin, config_yaml, config_sha, created_at,
updated_at, config (struct), base_url.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import config_sha
from ..functions.hosts import host_is_public
from ..functions.urls import url_host
from ..session import shared_dir

SOURCE_COLS = ("id", "name", "description", "origin", "config_yaml", "config_sha", "created_at", "updated_at",
               "config", "base_url")


def source_id_for(name) -> F.Column:
    """Deterministic id for a newly registered source."""
    n = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("s-"), F.substring(F.sha2(n, 256), 1, 16))


def _new_rows(req: DataFrame, origin, as_of) -> DataFrame:
    return req.select(
        source_id_for("name").alias("id"), "name",
        F.coalesce(F.col("config.description"), F.lit("")).alias("description"),
        (F.lit(origin) if isinstance(origin, str) else origin).alias("origin"),
        "config_yaml", config_sha(F.col("config_yaml")).alias("config_sha"),
        as_of.alias("created_at"), as_of.alias("updated_at"), "config",
        F.col("config.url").alias("base_url"))


def _ts(as_of):
    return F.lit(as_of).cast("timestamp") if not isinstance(as_of, F.Column) else as_of


def last_per_name(requests: DataFrame, name: str) -> DataFrame:
    """One request per name: the last by ``req_ix`` where that column is given,
    equal ones by the greater text. An aggregate, so repeats of a name are
    combined before the shuffle."""
    ix = F.col("req_ix") if "req_ix" in requests.columns else F.lit(0)
    cols = [c for c in requests.columns if c != name]
    last = requests.groupBy(name).agg(F.max_by(F.struct(*cols), F.struct(ix.alias("ix"), F.col("config_yaml"))).alias("_r"))
    return last.select(name, "_r.*")


def sync(sources: DataFrame, file_configs: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """UPS2 + SNK4: mirror file configs. New name -> inserted (origin file);
    changed text (config_sha differs) -> updated and origin set to file; same
    sha -> unchanged, row byte-identical. Rows with violations are skipped; of
    several valid texts for one name the last (``req_ix``) counts.
    ``file_configs``: name, config_yaml, config[, violations, req_ix]."""
    as_of = _ts(as_of)
    fc = file_configs
    if "violations" in fc.columns:
        skipped = fc.where(F.size("violations") > 0).select("name", F.lit("skipped_invalid").alias("outcome"))
        fc = fc.where(F.size("violations") == 0)
    else:
        skipped = None
    fc = last_per_name(fc, "name").select("name", "config_yaml", "config", config_sha(F.col("config_yaml")).alias("_sha"))
    j = sources.alias("s").join(fc.alias("f"), F.col("s.name") == F.col("f.name"), "full")
    exists = F.col("s.id").isNotNull()
    incoming = F.col("f.name").isNotNull()
    changed = exists & incoming & (F.col("s.config_sha") != F.col("f._sha"))
    outcome = F.when(~exists, "inserted").when(changed, "updated").when(incoming, "unchanged")
    nxt = j.select(
        F.when(exists, F.col("s.id")).otherwise(source_id_for(F.col("f.name"))).alias("id"),
        F.coalesce(F.col("s.name"), F.col("f.name")).alias("name"),
        F.when(~exists | changed, F.coalesce(F.col("f.config.description"), F.lit("")))
        .otherwise(F.col("s.description")).alias("description"),
        F.when(~exists | changed, F.lit("file")).otherwise(F.col("s.origin")).alias("origin"),
        F.when(~exists | changed, F.col("f.config_yaml")).otherwise(F.col("s.config_yaml")).alias("config_yaml"),
        F.when(~exists | changed, F.col("f._sha")).otherwise(F.col("s.config_sha")).alias("config_sha"),
        F.when(exists, F.col("s.created_at")).otherwise(as_of).alias("created_at"),
        F.when(~exists | changed, as_of).otherwise(F.col("s.updated_at")).alias("updated_at"),
        F.when(~exists | changed, F.col("f.config")).otherwise(F.col("s.config")).alias("config"),
        F.when(~exists | changed, F.col("f.config.url")).otherwise(F.col("s.base_url")).alias("base_url"),
        outcome.alias("_outcome"))
    outcomes = nxt.where(F.col("_outcome").isNotNull()).select("name", F.col("_outcome").alias("outcome"))
    if skipped is not None:
        outcomes = outcomes.unionByName(skipped)
    return nxt.drop("_outcome"), outcomes


def create(sources: DataFrame, requests: DataFrame, as_of, origin: str = "api") -> tuple[DataFrame, DataFrame]:
    """UPS1 + AGG11: insert new names; an existing name, or a repeat of a name
    earlier in the same request table, is rejected. Requests are ordered by
    ``req_ix`` (where given) and text; one of several equal ones is inserted.

    The first request per name is an aggregate (``min_by``) over narrow rows,
    so a name with very many requests is combined before the shuffle."""
    as_of = _ts(as_of)
    req = requests if "req_ix" in requests.columns else requests.withColumn("req_ix", F.lit(0).cast("long"))
    place = F.struct("req_ix", "config_yaml")
    first = (req.join(sources.select("name"), "name", "left_anti").groupBy("name")
             .agg(F.min(place).alias("_first"), F.min_by("config", place).alias("config")))
    inserted = first.select("name", "_first.req_ix", "_first.config_yaml", "config")
    repeats = (req.groupBy("name", "req_ix", "config_yaml").agg(F.count(F.lit(1)).alias("_n"))
               .join(inserted.select("name", F.col("req_ix").alias("_ix"), F.col("config_yaml").alias("_text")), "name", "left"))
    is_first = F.coalesce((F.col("req_ix") == F.col("_ix")) & F.col("config_yaml").eqNullSafe(F.col("_text")), F.lit(False))
    out = repeats.select("name", "req_ix", F.explode(F.concat(
        F.when(is_first, F.array(F.lit("inserted"))).otherwise(F.array().cast("array<string>")),
        F.array_repeat(F.lit("rejected"), (F.col("_n") - is_first.cast("long")).cast("int")))).alias("outcome"))
    outcomes = out.withColumn("error", F.when(F.col("outcome") == "rejected", F.concat(F.lit("name is taken: "), F.col("name"))))
    nxt = sources.select(*SOURCE_COLS).unionByName(_new_rows(inserted, origin, as_of).select(*SOURCE_COLS))
    return nxt, outcomes


def update(sources: DataFrame, updates: DataFrame, as_of, allow_file_origin: bool = False) -> tuple[DataFrame, DataFrame]:
    """UPS3: ``updates``: path_name, config_yaml, config[, req_ix]. Outcome per
    request: not_found / immutable (file origin) / name_mismatch / updated; of
    several valid updates of one source the last (``req_ix``) is the one stored."""
    as_of = _ts(as_of)
    ix = F.col("req_ix") if "req_ix" in updates.columns else F.lit(0).cast("long")
    u = updates.select(F.col("path_name"), F.col("config_yaml").alias("_yaml"), F.col("config").alias("_cfg"), ix.alias("req_ix"))
    j = u.join(sources.select("name", "origin"), u["path_name"] == sources["name"], "left")
    outcome = (F.when(F.col("name").isNull(), "not_found")
               .when((F.col("origin") == "file") & F.lit(not allow_file_origin), "immutable")
               .when(F.col("_cfg.name") != F.col("path_name"), "name_mismatch")
               .otherwise("updated"))
    outcomes = j.select("path_name", outcome.alias("outcome"), "_yaml", "_cfg", "req_ix")
    applied = last_per_name(outcomes.where(F.col("outcome") == "updated").select(
        F.col("path_name").alias("name"), F.col("_yaml").alias("config_yaml"), "_cfg", "req_ix"), "name") \
        .select("name", F.col("config_yaml").alias("_yaml"), "_cfg")
    s = sources.join(applied, "name", "left")
    hit = F.col("_yaml").isNotNull()
    nxt = s.select(
        "id", "name",
        F.when(hit, F.coalesce(F.col("_cfg.description"), F.lit(""))).otherwise(F.col("description")).alias("description"),
        "origin",
        F.when(hit, F.col("_yaml")).otherwise(F.col("config_yaml")).alias("config_yaml"),
        F.when(hit, config_sha(F.col("_yaml"))).otherwise(F.col("config_sha")).alias("config_sha"),
        "created_at",
        F.when(hit, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.col("_cfg")).otherwise(F.col("config")).alias("config"),
        F.when(hit, F.col("_cfg.url")).otherwise(F.col("base_url")).alias("base_url"))
    return nxt, outcomes.select("path_name", "outcome")


def delete(sources: DataFrame, names: DataFrame, allow_file_origin: bool = False) -> tuple[DataFrame, DataFrame]:
    """UPS4: ``names``: name. Outcome not_found / immutable / deleted."""
    j = names.select("name").join(sources.select("name", "origin", "id"), "name", "left")
    outcome = (F.when(F.col("id").isNull(), "not_found")
               .when((F.col("origin") == "file") & F.lit(not allow_file_origin), "immutable")
               .otherwise("deleted"))
    outcomes = j.select("name", "id", outcome.alias("outcome"))
    gone = outcomes.where(F.col("outcome") == "deleted").select("id")
    return sources.join(gone, "id", "left_anti"), outcomes


def cascade(child: DataFrame, deleted_sources: DataFrame, key: str = "source_id") -> DataFrame:
    """JOIN10: rows of a child table (runs, items, heals) whose source was deleted go too."""
    gone = deleted_sources.select(F.col("id").alias(key))
    return child.join(gone, key, "left_anti")


def null_deleted_runs(heals: DataFrame, deleted_runs: DataFrame) -> DataFrame:
    """JOIN10: heals keep their row when their run is deleted; run_id becomes null."""
    gone = deleted_runs.select(F.col("run_id").alias("_gone")).distinct()
    j = heals.join(gone, heals["run_id"] == gone["_gone"], "left")
    return j.withColumn("run_id", F.when(F.col("_gone").isNotNull(), F.lit(None)).otherwise(F.col("run_id"))) \
        .drop("_gone")


def submit(checked: DataFrame, sources: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """UPS5: submissions with ``violations`` (from config_checks.violations) plus
    the public-host guard plus the duplicate-name check -> accepted / rejected
    with reasons; accepted ones are inserted with origin api."""
    host_ok = host_is_public(url_host(F.col("config.url")))
    c = checked.select(F.col("config.name").alias("name"), "config", "config_yaml", F.concat(
        F.col("violations"), F.when(F.col("config.url").isNotNull() & ~host_ok,
                                    F.array(F.lit("url: host is not public"))).otherwise(F.array())).alias("reasons"))
    # checkpointed when it first runs (no job while the plan is built): the rule
    # expressions are large and would be copied into every pushed predicate
    shared_dir(checked.sparkSession)
    c = c.checkpoint(eager=False)
    valid = c.where(F.size("reasons") == 0)
    nxt, created = create(sources, valid, as_of, "api")
    rejected = c.where(F.size("reasons") > 0).select("name", F.lit("rejected").alias("outcome"), "reasons")
    created = created.select("name", "outcome",
                             F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array())
                             .cast("array<string>").alias("reasons"))
    return nxt, created.unionByName(rejected)
