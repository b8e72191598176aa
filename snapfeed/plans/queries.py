"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

They read the driver's whole tables (``sources.tables`` derives the engine's
own tables from them) and run the operators of ``snapfeed.operators``. Column
names and types match the SQL oracle in ``plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, item_hash
from ..functions.items import VIEW_EXCLUDE, content_text
from ..functions.misc import percent_text
from ..functions.urls import url_host
from ..operators import config_checks, dedupe, diff, extract, ordering, repair, runs as runs_op, sources as src_op, views
from ..operators.common import as_ntz, kept
from ..session import scratch_path
from ..sources import commits, deletions, logs, rollups
from ..sources import tables as T


# ---------------------------------------------------------------------------
# extraction, cap, dedupe


def nav_raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_items(T.nav_pages(spark, sf_dir), T.nav_config(spark, sf_dir)).where(F.col("error").isNull())


def extract_nav_items(spark, sf_dir):
    """SRC1 EXT1-EXT3 FLT1: `nav li` containers, href and text fields."""
    raw = nav_raw_items(spark, sf_dir)
    return raw.select("run_id", "item_idx", F.col("data")["href"].alias("href"), F.col("data")["text"].alias("text"))


def page_title_fields(spark, sf_dir):
    """EXT3: one item per page from `html`, fields `title::text` and `h1::text`."""
    cfg = T.nav_config(spark, sf_dir, container="html",
                       fields=[("title", "title::text", "css"), ("h1", "h1::text", "css")], dedupe_key="title")
    raw = extract.extract_items(T.nav_pages(spark, sf_dir), cfg)
    return raw.select("run_id", F.col("data")["title"].alias("title"), F.col("data")["h1"].alias("h1"))


def cap_then_dedupe(spark, sf_dir):
    """WIN3 FLT2 WIN2: first 5 items of every run, then first-wins on href."""
    raw = nav_raw_items(spark, sf_dir)
    kept = dedupe.first_wins(dedupe.cap(raw, 5), "href")
    return kept.select("run_id", "item_idx", "dedupe_key")


def duplicate_keys(spark, sf_dir):
    """AGG4: hrefs that occur more than once in a run."""
    raw = nav_raw_items(spark, sf_dir)
    return dedupe.duplicate_keys(raw, "href").select("run_id", "dedupe_key", "n")


def missing_keys(spark, sf_dir):
    """AGG5: items whose map lacks the dedupe key (doc_id % 17 = 0 has no `id`)."""
    d = T.read(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    data = F.when(F.col("doc_id") % 17 == 0, F.create_map(F.lit("title"), F.col("text"))) \
        .otherwise(F.create_map(F.lit("id"), key, F.lit("title"), F.col("text")))
    items = d.select(F.col("source").alias("source_id"), F.col("doc_id"), data.alias("data"))
    return dedupe.missing_keys(items, "id").select("source_id", "doc_id")


def nav_items_per_host(spark, sf_dir):
    """Flagship: extract nav links of every site, first-wins per page, hash,
    count per site (the source is the page's host)."""
    raw = nav_raw_items(spark, sf_dir)
    kept = dedupe.first_wins(raw, "href").withColumn("h", item_hash(F.col("data")))
    return kept.groupBy(F.col("source_id").alias("host")).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("h").alias("n_distinct_items"))


# ---------------------------------------------------------------------------
# hashing, content text, URLs


def item_hash_q(spark, sf_dir):
    """FN1 FN2: item hash of every view item."""
    it = T.view_items(spark, sf_dir)
    return it.select("source_id", "dedupe_key", item_hash(F.col("data")).alias("content_hash"))


def content_text_strict(spark, sf_dir):
    """FN4 FN6."""
    it = T.view_items(spark, sf_dir)
    text = content_text(F.col("data"))
    return it.select("source_id", "dedupe_key", text.alias("content_text"), content_hash(text).alias("text_hash"))


def content_text_view(spark, sf_dir):
    """FN5 FN6."""
    it = T.view_items(spark, sf_dir)
    text = content_text(F.col("data"), VIEW_EXCLUDE)
    return it.select("source_id", "dedupe_key", text.alias("content_text"), content_hash(text).alias("text_hash"))


def resolve_item_urls(spark, sf_dir):
    """FN7 FN8 FN10 JOIN3 PRJ2."""
    v = views.item_view(T.view_items(spark, sf_dir), T.sources(spark, sf_dir))
    return v.select("source_id", "stable_id", "url", "title")


# ---------------------------------------------------------------------------
# diff


def _ok_batch_runs(spark, sf_dir):
    return T.batch_runs(spark, sf_dir).where(F.col("status") == "ok")


def snapshot_diff(spark, sf_dir):
    """CHG1 JOIN1 JOIN8."""
    return diff.classify(T.state_items(spark, sf_dir), T.batch_items(spark, sf_dir), _ok_batch_runs(spark, sf_dir))


def snapshot_next_state(spark, sf_dir):
    """CHG3."""
    nxt = diff.next_state(T.state_items(spark, sf_dir), T.batch_items(spark, sf_dir), _ok_batch_runs(spark, sf_dir),
                          T.AS_OF)
    return nxt.select("source_id", "dedupe_key", "content_hash", F.col("data")["title"].alias("title"), "removed",
                      as_ntz("first_seen_at").alias("first_seen_at"), as_ntz("last_seen_at").alias("last_seen_at"))


def run_summary(spark, sf_dir):
    """AGG3."""
    runs = _ok_batch_runs(spark, sf_dir)
    ch = diff.classify(T.state_items(spark, sf_dir), T.batch_items(spark, sf_dir), runs)
    return diff.summarise(ch, runs)


def history_diff(spark, sf_dir):
    """CHG2: five runs per source diffed in one pass."""
    h = diff.history(T.history_items(spark, sf_dir), T.history_runs(spark, sf_dir))
    return h.withColumn("run_ix", F.col("run_ix").cast("long"))


# ---------------------------------------------------------------------------
# read queries


def source_stats(spark, sf_dir):
    """AGG1 WIN1 JOIN6 JOIN7 SORT4."""
    s = views.source_stats(T.sources(spark, sf_dir), T.state_items(spark, sf_dir), T.runs(spark, sf_dir))
    return s.withColumn("last_run_at", as_ntz("last_run_at"))


def latest_failed_sources(spark, sf_dir):
    """AGG8 SORT5."""
    lf = runs_op.latest_failed(T.runs(spark, sf_dir))
    return lf.select("source_id", "run_id", as_ntz("started_at").alias("started_at"), "source_name") \
        .orderBy(F.desc("started_at"), F.desc("run_id"))


def _run_out(df):
    return df.select("run_id", "source_id", "source_name", "status", as_ntz("started_at").alias("started_at"),
                     as_ntz("ended_at").alias("ended_at"), "duration_ms", "item_count", "error")


def runs_page(spark, sf_dir):
    """SORT1: runs newest first, offset 10, limit 20."""
    return _run_out(views.runs_page(T.runs(spark, sf_dir), limit=20, offset=10))


def items_page(spark, sf_dir):
    """SORT2 FLT3: live items of src3, newest first, offset 5, limit 10."""
    p = views.items_page(T.state_items(spark, sf_dir, "src3"), "src3", limit=10, offset=5)
    return p.select("source_id", "dedupe_key", "content_hash", as_ntz("last_seen_at").alias("last_seen_at"))


def heals_page(spark, sf_dir):
    """JOIN2 SORT3 PRJ3: heals with source names, newest first, limit 20."""
    h = views.heals_page(T.heals(spark, sf_dir), T.sources(spark, sf_dir), limit=20)
    return h.select("id", "source_name", "field_name", "mode", "applied", "confidence",
                    as_ntz("created_at").alias("created_at"))


def run_items_window(spark, sf_dir):
    """JOIN4: live items last seen inside each run's [started_at, ended_at or as_of]."""
    j = views.run_items(T.state_items(spark, sf_dir), T.runs(spark, sf_dir), T.AS_OF)
    return j.select("run_id", "source_id", "dedupe_key", as_ntz("last_seen_at").alias("last_seen_at"))


def run_items_page(spark, sf_dir):
    """JOIN4 SORT2: live items of the newest ended run, newest first, offset 3, limit 20."""
    runs = T.runs(spark, sf_dir)
    one = views.page(runs.where(F.col("ended_at").isNotNull()), [F.desc("started_at"), F.desc("run_id")], 1)
    p = views.items_of_runs(T.state_items(spark, sf_dir), one, T.AS_OF, limit=20, offset=3)
    return p.select("run_id", "source_id", "dedupe_key", as_ntz("last_seen_at").alias("last_seen_at"))


def run_item_counts(spark, sf_dir):
    """JOIN4 counted per run."""
    return views.run_item_counts(T.state_items(spark, sf_dir), T.runs(spark, sf_dir), T.AS_OF)


def runs_page_filtered(spark, sf_dir):
    """SORT1 FLT4: runs of one source by name."""
    return _run_out(views.runs_page(T.runs(spark, sf_dir), source_name="src4", limit=20, offset=5))


def heals_page_filtered(spark, sf_dir):
    """JOIN2 SORT3 PRJ3 FLT4: heals of one source by name, selectors as a map."""
    h = views.heal_view(views.heals_page(T.heals(spark, sf_dir), T.sources(spark, sf_dir), source_name="src4", limit=20))
    return h.select("id", "source_name", F.col("selectors")["old"].alias("old"), F.col("selectors")["new"].alias("new"),
                    as_ntz("created_at").alias("created_at"))


def source_stats_api(spark, sf_dir):
    """JOIN6 JOIN7 FLT4: the list of sources of one origin."""
    s = views.source_stats(T.sources(spark, sf_dir), T.state_items(spark, sf_dir), T.runs(spark, sf_dir), origin="api")
    return s.select("name", "item_count", "last_status", as_ntz("last_run_at").alias("last_run_at"))


def source_details(spark, sf_dir):
    """PRJ4: detail rows with the config text."""
    return views.source_detail(T.sources(spark, sf_dir)).select("id", "name", "origin", "config_yaml")


def latest_run_of_source(spark, sf_dir):
    """WIN4: newest run of one source."""
    return _run_out(views.latest_run(T.runs(spark, sf_dir), "src5"))


def rolled_up_sources(spark, sf_dir):
    """AGG1 AGG3 AGG6 kept from the change feed: the history's runs applied as
    three batches, the second one twice and folded in between."""
    base = scratch_path(spark, "rollups")
    runs = T.history_runs(spark, sf_dir)
    changes = kept(diff.history(T.history_items(spark, sf_dir), runs).select("source_id", "run_id", "change"), "changes")
    for batch_id, own in enumerate((["h0", "h1"], ["h2"], ["h2"], ["h3", "h4"])):
        batch_id -= batch_id > 1
        rollups.apply(changes.where(F.col("run_id").isin(own)), runs.where(F.col("run_id").isin(own)), base, batch_id)
        if own == ["h2"]:
            rollups.fold(spark, base)
    out = rollups.read(spark, base)
    return out.select("source_id", "live", "n_new", "n_updated", "n_removed", "runs", F.col("last.run_id").alias("last_run_id"),
                      F.col("last.status").alias("last_status"))


def run_first_pages(spark, sf_dir):
    """JOIN4 SORT2: every run's newest three items after the first, for all runs at once."""
    pages = views.run_first_pages(T.state_items(spark, sf_dir), T.runs(spark, sf_dir), T.AS_OF, limit=3, offset=1)
    return pages.withColumn("last_seen_at", as_ntz("last_seen_at"))


def items_deep_page(spark, sf_dir):
    """SORT2 far down: twenty live items from the middle of all, newest first."""
    items = T.state_items(spark, sf_dir).where(~F.col("removed")).select("source_id", "dedupe_key", "last_seen_at")
    half = items.count() // 2
    return views.deep_page(items, [F.desc("last_seen_at"), F.asc("dedupe_key"), F.asc("source_id")], 20, half) \
        .withColumn("last_seen_at", as_ntz("last_seen_at"))


def runs_deep_page(spark, sf_dir):
    """SORT1 far down: the runs a third into the list, with what is shown of them joined to the page."""
    runs = T.runs(spark, sf_dir)
    ids = runs.select("started_at", "run_id")
    at = views.deep_page(ids, [F.desc("started_at"), F.desc("run_id")], 25, ids.count() // 3).select("run_id")
    return runs.join(at, "run_id").select("run_id", "source_id", "status", "item_count")


def deletion_log_counts(spark, sf_dir):
    """JOIN10 UPS4: every fifth source and the failed runs deleted through the
    log; what readers see of the four tables."""
    path = scratch_path(spark, "deletions")
    sources, runs = T.sources(spark, sf_dir), T.runs(spark, sf_dir)
    gone = sources.where(T.source_number(F.col("id")) % 5 == 0).select("id")
    deletions.append(spark, path, gone, "source", T.ts_lit(T.AS_OF))
    deletions.append(spark, path, runs.where("status = 'error'").select(F.col("run_id").alias("id")), "run", T.ts_lit(T.AS_OF))
    log = deletions.read(spark, path)
    heals = T.heals(spark, sf_dir)
    seen = deletions.live_tables(sources.withColumn("created_at", T.ts_lit(T.T0)), runs, T.state_items(spark, sf_dir), heals, log)
    counts = None
    for name, rows in seen.items():
        linked = F.count("run_id") if name == "heals" else F.lit(None).cast("long")
        own = rows.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), linked.alias("with_run"))
        counts = own if counts is None else counts.unionByName(own)
    return counts


def _narrow_state(spark, sf_dir):
    return T.state_items(spark, sf_dir).select("source_id", "dedupe_key", "content_hash", "removed")


def state_two_writers(spark, sf_dir):
    """SNK1: two writers read one version and commit one after the other: one
    marks the items of even sources removed, one drops the removed items of odd ones."""
    base = scratch_path(spark, "two-writers")
    sources = T.sources(spark, sf_dir).select(F.col("id").alias("source_id"))
    commits.publish(_narrow_state(spark, sf_dir), sources, base, 0)
    even = T.source_number(F.col("source_id")) % 2 == 0
    now = commits.read_sources(spark, base, version=1)
    one = commits.Transaction(now.where(even).withColumn("removed", F.lit(True)), sources.where(even), base, 1)
    two = commits.Transaction(now.where(~even).where("NOT removed"), sources.where(~even), base, 1)
    two.commit()
    one.commit()
    return commits.read_sources(spark, base)


def state_of_one_source(spark, sf_dir):
    """SRC4: one source's stored rows (only its files are read), newest version."""
    base = scratch_path(spark, "one-source")
    sources = T.sources(spark, sf_dir).select(F.col("id").alias("source_id"))
    commits.publish(_narrow_state(spark, sf_dir), sources, base, 0)
    return commits.read_sources(spark, base, sources.where("source_id = 'src3'"))


def heals_of_deleted_runs(spark, sf_dir):
    """JOIN10: heals whose run was deleted (failed runs here) keep their row without a run."""
    runs = T.runs(spark, sf_dir).where(F.col("status") == "error").select("run_id")
    h = src_op.null_deleted_runs(T.heals(spark, sf_dir), runs)
    return h.select("id", "source_id", "run_id", "applied")


def logged_runs(spark, sf_dir):
    """SNK2 AGG6: run events appended to the log, read back and folded to run rows."""
    path = scratch_path(spark, "run-log")
    logs.append_run_events(T.run_events(spark, sf_dir), path)
    cur = runs_op.current(spark.read.parquet(path).drop("day"))
    return cur.select("run_id", "source_id", "status", "item_count", "error")


def logged_heals(spark, sf_dir):
    """SNK3: heal rows appended to the log and read back per source."""
    path = scratch_path(spark, "heal-log")
    logs.append_heals(T.heals(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("heals"), F.count_if("applied").alias("applied"), F.count_distinct("day").alias("days"))


# ---------------------------------------------------------------------------
# run lifecycle


def reap_stale_runs(spark, sf_dir):
    """LIF2 FN11."""
    r = runs_op.reap(T.runs(spark, sf_dir), T.AS_OF, 1800)
    return r.select("run_id", "status", as_ntz("ended_at").alias("ended_at"), "duration_ms", "error", "reaped")


def run_state(spark, sf_dir):
    """AGG6 LIF1: current run rows from the event log."""
    cur = runs_op.current(T.run_events(spark, sf_dir))
    return cur.select("run_id", "source_id", "status", as_ntz("started_at").alias("started_at"),
                      as_ntz("ended_at").alias("ended_at"), "duration_ms", "item_count", "items_new",
                      "items_updated", "items_removed", "error", as_ntz("created_at").alias("created_at"))


def unhealthy_runs(spark, sf_dir):
    """HLT1 FLT7 JOIN5."""
    u = repair.unhealthy(T.runs(spark, sf_dir), T.sources(spark, sf_dir))
    return u.select("run_id", "source_id", "item_count", "min_items")


def broken_fields(spark, sf_dir):
    """HLT2 AGG7."""
    t = repair.targets(T.field_items(spark, sf_dir), T.sources(spark, sf_dir))
    return t.select("source_id", "target", "old_selector")


def batch_outcome(spark, sf_dir):
    """JOIN9 AGG10: requested names (user_id % 25) against registered sources."""
    ev = T.read(spark, sf_dir, "events")
    req = ev.select(F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("source")).distinct()
    return runs_op.batch_outcome(req, T.sources(spark, sf_dir))


def batch_outcome_checked(spark, sf_dir):
    """JOIN9 with valid configs: requested page sources against the registered
    ones, every fourth of which has no valid config."""
    req = T.read(spark, sf_dir, "events").select(F.concat(F.lit("page-"), (F.col("event_id") % 5000).cast("string")).alias("source")).distinct()
    sources = T.page_sources(spark, sf_dir)
    return runs_op.batch_outcome(req, sources, sources.where(T.source_number(F.col("name")) % 4 != 0))


def request_names(spark, sf_dir):
    """FLT8 CFG8: one request per document, with a name that may be too long or hold capitals."""
    d = T.read(spark, sf_dir, "documents")
    name = F.concat(F.when(F.col("doc_id") % 9 == 0, "Run-").otherwise("run-"), F.repeat(F.lit("x"), (F.col("doc_id") % 70).cast("int")))
    req = d.select(F.col("doc_id").alias("request_id"), F.col("source"), F.lit(5).alias("max_items"), name.alias("name"))
    return config_checks.request_violations(req).withColumn("n_sources", F.col("n_sources").cast("int"))


# ---------------------------------------------------------------------------
# sources


def _file_configs(spark, sf_dir):
    s = T.sources(spark, sf_dir)
    n = T.source_number(F.col("name"))
    changed = s.select("name", F.when(n % 3 == 0, F.concat(F.col("config_yaml"), F.lit("# v2\n")))
                       .otherwise(F.col("config_yaml")).alias("config_yaml"), "config")
    new_names = s.where(n % 5 == 0).select(F.concat(F.lit("src"), (n + 20).cast("string")).alias("name"))
    new = new_names.select("name", F.concat(F.lit("name: "), F.col("name"), F.lit("\n")).alias("config_yaml"),
                           T.config_for(F.col("name")).alias("config"))
    return changed.unionByName(new)


def sync_sources(spark, sf_dir):
    """UPS2 SNK4 FN3."""
    nxt, outcomes = src_op.sync(T.sources(spark, sf_dir), _file_configs(spark, sf_dir), T.AS_OF)
    return nxt.join(outcomes, "name", "left").select(
        "name", "origin", "config_sha", as_ntz("updated_at").alias("updated_at"), "outcome")


def sync_page_sources(spark, sf_dir):
    """UPS2 SNK4 per page: even pages are stored; every file config mirrored,
    every third with a new text, every fifth with violations."""
    files = T.page_sources(spark, sf_dir)
    n = T.source_number(F.col("name"))
    text = F.when(n % 3 == 0, F.concat("config_yaml", F.lit("# v2\n"))).otherwise(F.col("config_yaml"))
    bad = F.when(n % 5 == 0, F.array(F.lit("item.fields: none"))).otherwise(F.array().cast("array<string>"))
    _, outcomes = src_op.sync(files.where(n % 2 == 0), files.select("name", text.alias("config_yaml"), "config", bad.alias("violations")), T.AS_OF)
    return outcomes


def update_sources(spark, sf_dir):
    """UPS3: outcome per update request and the resulting config_sha."""
    s = T.sources(spark, sf_dir)
    n = T.source_number(F.col("name"))
    body = lambda nm: F.concat(F.lit("name: "), nm, F.lit("\nurl: https://updated.example.com/\n"))
    reqs = s.where(n % 4 == 0).select(F.col("name").alias("path_name"), body(F.col("name")).alias("config_yaml"),
                                      T.config_for(F.col("name")).alias("config")) \
        .unionByName(s.where(n % 4 == 1).select(
            F.col("name").alias("path_name"), body(F.col("name")).alias("config_yaml"),
            T.config_for(F.concat(F.col("name"), F.lit("-x"))).alias("config"))) \
        .unionByName(s.where(n % 4 == 3).select(
            F.col("name").alias("path_name"), body(F.col("name")).alias("config_yaml"),
            T.config_for(F.col("name")).alias("config"))) \
        .unionByName(s.where(n % 5 == 0).select(
            F.concat(F.lit("src"), (n + 100).cast("string")).alias("path_name"),
            body(F.lit("x")).alias("config_yaml"), T.config_for(F.lit("x")).alias("config")))
    nxt, outcomes = src_op.update(s, reqs, T.AS_OF)
    return outcomes.join(nxt.select(F.col("name").alias("path_name"), "config_sha"), "path_name", "left")


def delete_sources_cascade(spark, sf_dir):
    """UPS4 JOIN10: delete every third source (file ones are immutable) and
    one unknown name; count the items each source keeps after the cascade."""
    s = T.sources(spark, sf_dir)
    n = T.source_number(F.col("name"))
    names = s.where(n % 3 == 0).select("name").unionByName(
        s.where(n == 0).select(F.lit("src99").alias("name")))
    nxt, outcomes = src_op.delete(s, names)
    deleted = outcomes.where(F.col("outcome") == "deleted").select("id")
    left = src_op.cascade(T.state_items(spark, sf_dir), deleted).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("items_left"))
    return outcomes.join(left, outcomes["name"] == left["source_id"], "left").select(
        "name", "outcome", F.coalesce("items_left", F.lit(0)).cast("long").alias("items_left"))


def _page_configs(spark, sf_dir):
    p = T.read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    name = (F.when(pid % 5 == 0, F.concat(F.lit("Page-"), pid.cast("string")))
            .when(pid % 5 == 1, F.concat(F.lit("page_"), pid.cast("string")))
            .otherwise(F.concat(F.lit("page-"), pid.cast("string"))))
    container = F.when(pid % 7 == 0, F.lit("nav[")).otherwise(F.lit("nav li"))
    key = F.when(pid % 11 == 0, F.lit("nope")).otherwise(F.lit("href"))
    fields = F.array(F.struct(F.lit("href").alias("name"), F.lit("a::attr(href)").alias("selector")),
                     F.struct(F.lit("text").alias("name"), F.lit("a::text").alias("selector")))
    doc = F.struct(
        name.alias("name"), F.col("url").alias("url"), F.lit("0 * * * *").alias("schedule"),
        F.struct(container.alias("container"), fields.alias("fields"), key.alias("dedupe_key")).alias("item"),
        F.struct((pid % 4).alias("max_pages")).alias("pagination"),
        F.when(pid % 6 == 0, F.lit("nav")).alias("wait_for"),
        F.when(pid % 13 == 0, F.lit("red")).alias("colour"))
    text = F.to_json(doc)
    # hard cases: wrong kinds, absent members, repeated names, faulty actions
    swap = lambda at, old, new: F.when(pid % 17 == at, F.replace(text, F.lit(old), F.lit(new)))
    text = F.coalesce(
        F.when(pid % 17 == 1, F.regexp_replace(text, '"max_pages":[0-9]+', '"max_pages":"two"')),
        F.when(pid % 17 == 2, F.regexp_replace(text, '"max_pages":[0-9]+', '"max_pages":1.5')),
        F.when(pid % 17 == 3, F.regexp_replace(text, '"max_pages":([0-9]+)', '"max_pages":"$1"')),
        swap(4, '"schedule":', '"description":5,"schedule":'), swap(5, '"schedule":', '"render":"maybe","schedule":'),
        F.when(pid % 17 == 6, F.regexp_replace(text, '"container":"[^"]*",', "")), swap(7, ',"selector":"a::text"', ""),
        swap(8, '"name":"text"', '"name":"href"'), swap(9, '"schedule":', '"render":true,"actions":[{"selector":"a"}],"schedule":'),
        swap(10, '"schedule":', '"health":{"min_items":-1},"schedule":'), swap(11, '"schedule":', '"health":{"min_items":null},"schedule":'),
        F.when(pid % 17 == 12, F.regexp_replace(text, '"fields":\\[.*?\\]', '"fields":[]')), text)
    return p.select("page_id", text.alias("raw_json"))


def config_violations(spark, sf_dir):
    """CFG1-CFG7 EXT9 over configs derived from every page."""
    checked = config_checks.violations(_page_configs(spark, sf_dir))
    v = F.col("violations")
    has = lambda prefix: F.exists(v, lambda m: F.startswith(m, F.lit(prefix)))
    return checked.select(
        "page_id", F.col("config.name").alias("name"), F.size(v).cast("long").alias("n_violations"),
        (F.size(v) == 0).alias("valid"),
        has("name:").alias("bad_name"), has("item.dedupe_key:").alias("bad_key"),
        has("Invalid css selector").alias("bad_selector"), has("pagination.max_pages: must").alias("bad_pages"),
        has("render: wait_for").alias("bad_static"), has("top: extra keys").alias("extra_keys"),
        (has("pagination.max_pages: not") | has("health.min_items: not")).alias("bad_number"),
        (has("description: wrong") | has("render: not")).alias("bad_kind"),
        (has("item.container: field required") | has("item.fields.selector: field required") | has("actions.type: field required")).alias("absent"),
        has("item.fields: duplicate").alias("repeated"), has("item.fields: at least").alias("no_fields"),
        has("health.min_items: must").alias("bad_least"))


def public_hosts(spark, sf_dir):
    """FLT6 over hosts derived from every page (some rewritten to IP literals)."""
    p = T.read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    m = (pid % 256).cast("string")
    host = (F.when(pid % 9 == 0, F.concat(F.lit("10."), m, F.lit(".0.1")))
            .when(pid % 9 == 1, F.concat(F.lit("8.8."), m, F.lit(".8")))
            .when(pid % 9 == 2, F.concat(F.lit("172."), (pid % 40).cast("string"), F.lit(".0.1")))
            .when(pid % 9 == 3, F.concat(F.lit("192.168."), m, F.lit(".1")))
            .when(pid % 9 == 4, F.concat(F.lit("h"), pid.cast("string"), F.lit(".internal")))
            .when(pid % 9 == 5, F.concat(F.lit("100."), (pid % 128).cast("string"), F.lit(".3.4")))
            .otherwise(url_host(F.col("url"))))
    hosts = p.select("page_id", host.alias("url_host_in"))
    out = config_checks.public_hosts(hosts.withColumn("url", F.concat(F.lit("https://"), F.col("url_host_in"), F.lit("/"))))
    return out.select("page_id", "host", "is_public")


# ---------------------------------------------------------------------------
# pagination


def _page_chains(spark, sf_dir):
    """Each host's pages chained by page_id: (links with a next-link column, first pages)."""
    p = T.read(spark, sf_dir, "pages").select("page_id", "url", url_host(F.col("url")).alias("source_id"))
    placed = ordering.numbered(p, ["source_id"], [F.col("page_id")], "_rn")
    after = placed.select("source_id", (F.col("_rn") - 1).alias("_rn"), F.col("url").alias("next_url"))
    links = placed.join(after, ["source_id", "_rn"], "left").select("source_id", "url", "next_url", "_rn")
    return links, links.where("_rn = 1")


def paginate_links(spark, sf_dir):
    """EXT8 FN9: per host, pages chained by page_id (a derived next-link
    column), followed from the first page for 1 + len(host) % 4 pages."""
    links, first = _page_chains(spark, sf_dir)
    visited = extract.paginate(first.select("source_id", "url", (F.lit(1) + F.length("source_id") % 4).alias("max_pages")), links)
    return visited.select("source_id", "url", F.col("page_no").cast("long").alias("page_no"))


def paginate_chains(spark, sf_dir):
    """EXT8: the same chains followed for up to 1000 pages, in ten doublings."""
    links, first = _page_chains(spark, sf_dir)
    visited = extract.paginate(first.select("source_id", "url", F.lit(1000).alias("max_pages")), links)
    return visited.select("source_id", "url", F.col("page_no").cast("long").alias("page_no"))


# ---------------------------------------------------------------------------
# repair


def _proposals(spark, sf_dir):
    """A proposal for every page's source: one that matches, one that doesn't, or none."""
    s = T.page_sources(spark, sf_dir)
    n = T.source_number(F.col("id"))
    selector = F.when(n % 3 == 0, F.lit("h1::text")).when(n % 3 == 1, F.lit("h9.none::text"))
    raw = F.to_json(F.struct(selector.alias("selector"), (n % 20 / 20.0).alias("confidence"),
                             F.concat(F.lit("reason "), n.cast("string")).alias("reasoning"),
                             F.array(F.lit("sample")).alias("sample_values")),
                    {"ignoreNullFields": "false"})
    props = s.select(F.col("id").alias("source_id"), F.lit(None).cast("long").alias("run_id"),
                     F.lit("summary").alias("target"), F.lit("p.summary::text").alias("old_selector"),
                     F.lit("css").alias("selector_type"), raw.alias("raw_json"))
    return repair.parse_proposals(props)


def _all_source_pages(spark, sf_dir):
    """Every page snapshot belongs to source src<page_id % 20>."""
    p = T.read(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("source_id"), "page_id", "html")


def apply_proposals(spark, sf_dir):
    """FN13 RPR1-RPR3: proposals scored on each source's page, then applied."""
    scored = repair.score(_proposals(spark, sf_dir), T.source_pages(spark, sf_dir))
    _, heals, _ = repair.apply(scored, T.page_sources(spark, sf_dir))
    return heals.select("source_id", "field_name", "new_selector", "mode", "applied", "confidence")


def patch_records(spark, sf_dir):
    """SNK5 FN14: reviewable change records for valid file-origin proposals."""
    scored = repair.score(_proposals(spark, sf_dir), T.source_pages(spark, sf_dir))
    _, _, patches = repair.apply(scored, T.page_sources(spark, sf_dir))
    return patches.select("source_name", "branch", "title", "body")


def patched_configs(spark, sf_dir):
    """RPR3: api-origin sources after valid patches (new config hash + selector)."""
    scored = repair.score(_proposals(spark, sf_dir), T.source_pages(spark, sf_dir))
    nxt, _, _ = repair.apply(scored, T.page_sources(spark, sf_dir))
    sel = F.filter(F.col("config.item.fields"), lambda f: f["name"] == "summary")[0]["selector"]
    return nxt.select("name", "origin", sel.alias("summary_selector"))


def percent_labels(spark, sf_dir):
    """FN14 over every heal confidence."""
    h = T.heals(spark, sf_dir)
    return h.select("id", percent_text(F.col("confidence")).alias("confidence_text"))


# ---------------------------------------------------------------------------
# more operators over the same derived tables


def scrape_items(spark, sf_dir):
    """PRJ1: flat scrape-result rows (stable id, url, title, content text and hash)."""
    from ..functions.items import scrape_item_columns
    it = T.view_items(spark, sf_dir)
    cols = scrape_item_columns(F.col("data"), F.col("dedupe_key"))
    return it.select("source_id", *cols[:5])


def stale_sources(spark, sf_dir):
    """HLT3: sources whose newest ok run is older than health.max_staleness."""
    s = repair.stale_sources(T.sources(spark, sf_dir), T.runs(spark, sf_dir), T.AS_OF)
    return s.select("source_id", "name", as_ntz("last_ok_at").alias("last_ok_at"))


def create_sources(spark, sf_dir):
    """UPS1 AGG11: one registration request per event (name by user) against
    existing sources and earlier requests for the same name."""
    ev = T.read(spark, sf_dir, "events")
    name = F.concat(F.lit("src"), (F.col("user_id") % 30).cast("string"))
    req = ev.select(name.alias("name"), F.col("event_id").alias("req_ix"),
                    F.concat(F.lit("name: "), name, F.lit("\n")).alias("config_yaml"),
                    T.config_for(name).alias("config"))
    _, outcomes = src_op.create(T.sources(spark, sf_dir), req, T.AS_OF)
    return outcomes.select("name", "req_ix", "outcome")


def removed_keys(spark, sf_dir):
    """JOIN8 SET2: live stored keys missing from their source's batch."""
    r = diff.removed_keys(T.state_items(spark, sf_dir), T.batch_items(spark, sf_dir), _ok_batch_runs(spark, sf_dir))
    return r.select("source_id", "dedupe_key")


def reap_counts(spark, sf_dir):
    """AGG9: runs reaped per source."""
    r = runs_op.reap(T.runs(spark, sf_dir), T.AS_OF, 1800)
    return r.where("reaped").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_reaped"))


def selector_checks(spark, sf_dir):
    """EXT9: selector syntax check over selectors derived from every page."""
    p = T.read(spark, sf_dir, "pages")
    n = (F.col("page_id") % 5 + 1).cast("string")
    sel = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("li:nth-child("), n, F.lit(" > a"))) \
        .when(F.col("page_id") % 3 == 0, F.concat(F.lit("//li["), n, F.lit("]/a/@href"))) \
        .otherwise(F.concat(F.lit("nav li:nth-child("), n, F.lit(") > a::attr(href)")))
    kind = F.when((F.col("page_id") % 3 == 0) & (F.col("page_id") % 7 != 0), "xpath").otherwise("css")
    checked = p.select("page_id", sel.alias("selector"), kind.alias("selector_type"))
    return checked.select("page_id", "selector",
                          extract.selector_error(F.col("selector"), F.col("selector_type")).isNull().alias("valid"))


def parse_configs(spark, sf_dir):
    """SRC3 CFG1: YAML texts of every source (some broken, some without an item
    block) parsed in tasks and checked."""
    from ..sources.configs import parse_texts
    s = T.sources(spark, sf_dir)
    n = T.source_number(F.col("id"))
    item = F.lit("item:\n  container: article\n  fields:\n    - {name: id, selector: '::attr(data-id)'}\n"
                 "  dedupe_key: id\n")
    text = F.when(n % 7 == 0, F.concat(F.col("config_yaml"), F.lit("oops: [\n"))) \
        .when(n % 2 == 0, F.concat(F.col("config_yaml"), item)).otherwise(F.col("config_yaml"))
    parsed = parse_texts(s.select(F.col("id").alias("file"), text.alias("config_yaml")), "config_yaml", "file")
    checked = config_checks.violations(parsed)
    return checked.select(F.col("file").alias("id"), F.col("parse_error").isNull().alias("parse_ok"),
                          (F.size("violations") == 0).alias("valid"), F.col("config.item.container").alias("container"))


def live_count(spark, sf_dir):
    """AGG2: live item count of one source."""
    return views.live_count(T.state_items(spark, sf_dir), "src3")


def unknown_run_events(spark, sf_dir):
    """LIF1 (RunNotFound): transitions for runs that were never created."""
    ev = T.run_events(spark, sf_dir)
    ghost = ev.where((F.col("kind") == "running") & (F.col("run_id") % 50 == 0)) \
        .withColumn("run_id", F.col("run_id") + 10_000_000)
    return runs_op.unknown_run_events(ev.unionByName(ghost)).select("run_id", "kind")


def mined_candidates(spark, sf_dir):
    """RPR5: container candidates mined from all pages of each source."""
    m = repair.mine_candidates(_all_source_pages(spark, sf_dir), T.sources(spark, sf_dir))
    return m.select("source_id", "selector", "per_page")


def ranked_candidates(spark, sf_dir):
    """RPR5: the mined candidates ranked against the items of each source's good runs."""
    found = repair.mine_candidates(_all_source_pages(spark, sf_dir), T.sources(spark, sf_dir))
    return repair.rank_candidates(found, T.runs(spark, sf_dir)).select(
        "source_id", "selector", "per_page", F.round("expected", 6).alias("expected"), "misfit", "place")


def submit_sources(spark, sf_dir):
    """UPS5: submitted configs (from every page) checked for rule violations and
    a public host, then registered or rejected."""
    p = T.read(spark, sf_dir, "pages")
    pid = F.col("page_id")
    host = (F.when(pid % 9 == 0, F.concat(F.lit("10."), (pid % 256).cast("string"), F.lit(".0.1")))
            .when(pid % 9 == 3, F.concat(F.lit("192.168."), (pid % 256).cast("string"), F.lit(".1")))
            .otherwise(url_host(F.col("url"))))
    name = F.concat(F.lit("page-"), pid.cast("string"))
    doc = F.struct(name.alias("name"), F.concat(F.lit("https://"), host, F.lit("/")).alias("url"),
                   F.lit("0 * * * *").alias("schedule"),
                   F.struct(F.when(pid % 7 == 0, F.lit("nav[")).otherwise(F.lit("nav li")).alias("container"),
                            F.array(F.struct(F.lit("href").alias("name"),
                                             F.lit("a::attr(href)").alias("selector"))).alias("fields"),
                            F.lit("href").alias("dedupe_key")).alias("item"))
    subs = p.select("page_id", F.to_json(doc).alias("raw_json"))
    chk = config_checks.violations(subs).withColumn("config_yaml", F.col("raw_json"))
    _, outcomes = src_op.submit(chk, T.sources(spark, sf_dir), T.AS_OF)
    return outcomes.select("name", "outcome", F.size("reasons").cast("long").alias("n_reasons"))


def request_checks(spark, sf_dir):
    """CFG8: every event is a (request, source) row; requests are runs of 8
    consecutive events, checked for bounds."""
    ev = T.read(spark, sf_dir, "events")
    req = ev.select(F.floor(F.col("event_id") / 8).cast("long").alias("request_id"),
                    F.concat(F.lit("src"), (F.col("user_id") % 7).cast("string")).alias("source"),
                    (F.floor("value").cast("long") % 120).alias("max_items"))
    return config_checks.request_violations(req)


def repair_inputs(spark, sf_dir):
    """FN12 HLT2: repair targets with the source's whole current page."""
    t = repair.targets(T.page_field_items(spark, sf_dir), T.page_sources(spark, sf_dir))
    r = repair.repair_inputs(t, T.source_pages(spark, sf_dir))
    return r.select("source_id", "target", F.length("page_html").cast("long").alias("page_chars"))


def page_repair_targets(spark, sf_dir):
    """HLT2 AGG7: what to repair on every page source; every fourth has no items
    at all, so its container."""
    items = T.page_field_items(spark, sf_dir).where("page_id % 4 != 1")
    return repair.targets(items, T.page_sources(spark, sf_dir)).select("source_id", "target", "old_selector")


def source_summaries(spark, sf_dir):
    """PRJ4 WIN4: source list rows plus each source's newest run."""
    s = views.source_summary(T.sources(spark, sf_dir))
    latest = views.latest_runs(T.runs(spark, sf_dir)).select(
        F.col("source_id").alias("id"), "last_run_id")
    return s.join(latest, "id", "left").select("id", "name", "origin", "config_sha", "last_run_id")


def scrape_run_summary(spark, sf_dir):
    """End to end (3.1): every page is a run of its site (runs ordered by page
    id); extract, first-wins, diff all runs of a site in one pass
    starting from an empty state; summary per run."""
    from .scrape import scrape_runs
    pages = T.nav_pages(spark, sf_dir)
    runs = pages.select("source_id", "run_id", T.plus_seconds(T.ts_lit(T.T0), F.col("page_id")).alias("started_at"),
                        F.lit("ok").alias("status"))
    _, _, _, summary = scrape_runs(pages, T.nav_config(spark, sf_dir), runs, None)
    return summary


def history_run_summary(spark, sf_dir):
    """AGG3 over CHG2: new / updated / removed per run of the five-run history
    (src5's h3 is an empty successful run, src9's h2 failed and is skipped)."""
    runs = T.history_runs(spark, sf_dir)
    ch = diff.history(T.history_items(spark, sf_dir), runs)
    return diff.history_summary(ch, runs)
