"""The driver's parquet tables and the change-feed tables derived from them.

The driver ships TPC-H-like tables plus ``pages``, ``documents``, ``events``,
``labels``; the engine's own tables (sources, runs, items state, batches,
histories, heals) are derived from them by plain column arithmetic so the
same rows can be produced in SQL by an independent engine. Every derivation
reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import item_hash

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values shared with the SQL oracle.
T0 = "2024-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"
N_SOURCES_FROM_USERS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; TIMESTAMP_NTZ columns become session-zone (UTC) timestamps."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def ts_lit(s: str) -> Column:
    return F.lit(s).cast("timestamp")


def plus_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + secs.cast("long") * F.lit(1_000_000))


def plus_millis(ts: Column, ms: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + ms.cast("long") * F.lit(1000))


def source_number(c: Column) -> Column:
    return F.regexp_extract(c, "([0-9]+)", 1).try_cast("int")


# ---------------------------------------------------------------------------
# sources


def config_for(source: Column) -> Column:
    """The extraction config of a derived source (documents -> articles)."""
    n = source_number(source)
    field = lambda name, sel: F.struct(F.lit(name).alias("name"), F.lit(sel).alias("selector"),
                                       F.lit("css").alias("selector_type"),
                                       F.lit(None).cast("string").alias("attr"))
    return F.struct(
        source.alias("name"), F.lit("").alias("description"),
        F.concat(F.lit("https://"), source, F.lit(".example.com/feed/")).alias("url"),
        F.lit(False).alias("render"), F.lit("0 */6 * * *").alias("schedule"),
        F.struct(F.lit(1).alias("rps")).alias("rate_limit"),
        F.struct(F.lit("article").alias("container"), F.lit("css").alias("container_type"),
                 F.array(field("id", "::attr(data-id)"), field("title", "h1::text"),
                         field("summary", "p.summary::text"), field("url", "a::attr(href)")).alias("fields"),
                 F.lit("id").alias("dedupe_key")).alias("item"),
        F.struct(F.lit(None).cast("string").alias("next"), F.lit("css").alias("next_type"),
                 F.lit(1).alias("max_pages")).alias("pagination"),
        F.lit(None).cast("string").alias("wait_for"),
        F.array().cast("array<struct<type:string,selector:string,ms:int,text:string>>").alias("actions"),
        F.struct((F.lit(10) + n * 2).alias("min_items"),
                 F.when(n % 3 == 0, "24h").when(n % 3 == 1, "1h").otherwise("7d").alias("max_staleness"))
        .alias("health"))


def sources_named(names: DataFrame) -> DataFrame:
    """Source rows for a column ``source`` of distinct names."""
    n = source_number(F.col("source"))
    cfg = config_for(F.col("source"))
    yaml_text = F.concat(F.lit("name: "), F.col("source"), F.lit("\nurl: https://"), F.col("source"),
                         F.lit(".example.com/feed/\nschedule: '0 */6 * * *'\n"))
    return names.select(
        F.col("source").alias("id"), F.col("source").alias("name"), F.lit("").alias("description"),
        F.when(n % 2 == 0, "file").otherwise("api").alias("origin"),
        yaml_text.alias("config_yaml"), F.substring(F.sha2(yaml_text, 256), 1, 12).alias("config_sha"),
        ts_lit(T0).alias("created_at"), ts_lit(T0).alias("updated_at"), cfg.alias("config"),
        cfg["url"].alias("base_url"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources_named(read(spark, sf_dir, "documents").select("source").distinct())


def _page_source() -> Column:
    return F.concat(F.lit("page-"), F.col("page_id").cast("string"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per page, so that repair grows with the pages."""
    return sources_named(read(spark, sf_dir, "pages").select(_page_source().alias("source")))


def source_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current page of each page source."""
    return read(spark, sf_dir, "pages").select(_page_source().alias("source_id"), "html")


def page_field_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extracted item per page source: summary not found where the page
    number is even, url not where it is a multiple of 3."""
    pid = F.col("page_id")
    data = F.create_map(
        F.lit("id"), pid.cast("string"), F.lit("title"), F.col("url"),
        F.lit("summary"), F.when(pid % 2 == 1, F.col("url")), F.lit("url"), F.when(pid % 3 != 0, F.col("url")))
    return read(spark, sf_dir, "pages").select(
        _page_source().alias("source_id"), F.lit("r1").alias("run_id"), F.lit(1).alias("page_no"), "page_id",
        F.lit(0).alias("item_idx"), data.alias("data"), F.lit(None).cast("string").alias("error"))


# ---------------------------------------------------------------------------
# runs


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per event: source = user_id % 20; status by event type;
    ended_at = ts + round(value * 1000) ms for finished runs."""
    ev = read(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "running")
              .when(F.col("event_type") == "signup", "queued").otherwise("ok"))
    ms = F.round(F.col("value") * 1000).cast("long")
    done = status.isin("ok", "error")
    src = F.concat(F.lit("src"), (F.col("user_id") % N_SOURCES_FROM_USERS).cast("string"))
    return ev.select(
        F.col("event_id").alias("run_id"), src.alias("source_id"), src.alias("source_name"),
        status.alias("status"), F.col("ts").alias("started_at"),
        F.when(done, plus_millis(F.col("ts"), ms)).alias("ended_at"),
        F.when(done, ms).alias("duration_ms"),
        F.when(status == "ok", F.col("event_id") % 50).when(status == "error", F.lit(0)).cast("long").alias("item_count"),
        F.when(status == "error", F.lit("fetch failed")).alias("error"),
        F.col("ts").alias("created_at"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2 log derived from runs: queued at ts, running at ts + 1 s, then the
    terminal event at ended_at for finished runs."""
    r = runs(spark, sf_dir)
    base = ["run_id", "source_id", "source_name"]
    none_l = F.lit(None).cast("long")
    queued = r.select(*base, F.lit("queued").alias("kind"), F.col("started_at").alias("ts"), F.lit(0).alias("seq"),
                      none_l.alias("item_count"), none_l.alias("items_new"), none_l.alias("items_updated"),
                      none_l.alias("items_removed"), F.lit(None).cast("string").alias("error"))
    running = r.where(F.col("status") != "queued").select(
        *base, F.lit("running").alias("kind"), plus_seconds(F.col("started_at"), F.lit(1)).alias("ts"),
        F.lit(1).alias("seq"), none_l.alias("item_count"), none_l.alias("items_new"), none_l.alias("items_updated"),
        none_l.alias("items_removed"), F.lit(None).cast("string").alias("error"))
    term = r.where(F.col("status").isin("ok", "error")).select(
        *base, F.col("status").alias("kind"), plus_millis(F.col("started_at"), F.col("duration_ms") + 1000).alias("ts"),
        F.lit(2).alias("seq"), F.col("item_count"),
        (F.col("run_id") % 7).alias("items_new"), (F.col("run_id") % 5).alias("items_updated"),
        (F.col("run_id") % 3).alias("items_removed"), F.col("error"))
    return queued.unionByName(running).unionByName(term)


# ---------------------------------------------------------------------------
# items: stored state, the next batch, a history of runs


def state_items(spark: SparkSession, sf_dir: str, source: str | None = None) -> DataFrame:
    """Stored state: every document (of one source, if given: the hash made here
    would keep a later filter from the scan); the key has an ``old-`` before it
    when doc_id % 7 = 3 (the next run doesn't know it); removed when doc_id % 11 = 0."""
    d = read(spark, sf_dir, "documents")
    if source is not None:
        d = d.where(F.col("source") == source)
    key = F.concat(F.when(F.col("doc_id") % 7 == 3, "old-").otherwise(""), F.col("doc_id").cast("string"))
    data = F.create_map(F.lit("id"), key, F.lit("title"), F.col("text"),
                        F.lit("url"), F.concat(F.lit("/d/"), key), F.lit("lang"), F.col("lang"))
    last_seen = plus_seconds(ts_lit(T0), F.lit(1000) + (F.col("doc_id") * 7919) % 2590000)
    return d.select(
        F.col("source").alias("source_id"), key.alias("dedupe_key"), item_hash(data).alias("content_hash"),
        data.alias("data"), (F.col("doc_id") % 11 == 0).alias("removed"),
        plus_seconds(ts_lit(T0), F.col("doc_id") % 1000).alias("first_seen_at"), last_seen.alias("last_seen_at"))


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next run's items: every document; the key gains ``-new`` when doc_id % 9 = 7,
    the title ``*`` when doc_id % 5 = 0; the items of src13 have moved to src12,
    so that src13's run is empty (and successful)."""
    d = read(spark, sf_dir, "documents").withColumn("source", F.when(F.col("source") == "src13", "src12").otherwise(F.col("source")))
    key = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 9 == 7, "-new").otherwise(""))
    title = F.concat(F.col("text"), F.when(F.col("doc_id") % 5 == 0, F.lit("*")).otherwise(F.lit("")))
    data = F.create_map(F.lit("id"), key, F.lit("title"), title,
                        F.lit("url"), F.concat(F.lit("/d/"), key), F.lit("lang"), F.col("lang"))
    return d.select(F.col("source").alias("source_id"), F.lit("r1").alias("run_id"), key.alias("dedupe_key"),
                    data.alias("data"))


def batch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch's run per source; src7's run failed (not diffed)."""
    s = read(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    return s.select("source_id", F.lit("r1").alias("run_id"),
                    F.when(F.col("source_id") == "src7", "error").otherwise("ok").alias("status"))


HISTORY_RUNS = 5


def history_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs h0..h4 per source a day apart; src9's h2 failed."""
    s = read(spark, sf_dir, "documents").select(F.col("source").alias("source_id")).distinct()
    r = s.select("source_id", F.explode(F.sequence(F.lit(0), F.lit(HISTORY_RUNS - 1))).alias("r"))
    return r.select("source_id", F.concat(F.lit("h"), F.col("r").cast("string")).alias("run_id"),
                    plus_seconds(ts_lit(T0), F.col("r") * 86400).alias("started_at"),
                    F.when((F.col("source_id") == "src9") & (F.col("r") == 2), "error").otherwise("ok").alias("status"))


def history_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key present in run r iff (doc_id + r*r) % 3 <> 0 (src5's h3 is empty);
    title version (doc_id * r) % 3."""
    d = read(spark, sf_dir, "documents")
    r = d.select("doc_id", "source", "text", F.explode(F.sequence(F.lit(0), F.lit(HISTORY_RUNS - 1))).alias("r"))
    r = r.where(((F.col("doc_id") + F.col("r") * F.col("r")) % 3 != 0)
                & ~((F.col("source") == "src5") & (F.col("r") == 3)))
    key = F.col("doc_id").cast("string")
    data = F.create_map(F.lit("id"), key, F.lit("title"),
                        F.concat(F.col("text"), F.lit("#"), ((F.col("doc_id") * F.col("r")) % 3).cast("string")))
    return r.select(F.col("source").alias("source_id"), F.concat(F.lit("h"), F.col("r").cast("string")).alias("run_id"),
                    key.alias("dedupe_key"), data.alias("data"))


def view_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with varied link and content keys, for the content-text and URL views."""
    d = read(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    url = (F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("https://other.example.org/x/"), key))
           .when(F.col("doc_id") % 9 == 0, F.lit(""))
           .otherwise(F.concat(F.lit("/d/"), key)))
    title = F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.col("text"))
    data = F.map_filter(F.create_map(
        F.lit("id"), key, F.lit("title"), title, F.lit("url"), url, F.lit("lang"), F.col("lang"),
        F.lit("link"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("/l/"), key)),
        F.lit("body"), F.when(F.col("doc_id") % 26 == 0, F.col("text"))),
        lambda k, v: v.isNotNull())
    return d.select(F.col("source").alias("source_id"), key.alias("dedupe_key"), data.alias("data"),
                    item_hash(data).alias("content_hash"),
                    plus_seconds(ts_lit(T0), F.col("doc_id") % 1000).alias("first_seen_at"),
                    plus_seconds(ts_lit(T0), F.lit(1000) + (F.col("doc_id") * 7919) % 2590000).alias("last_seen_at"),
                    F.lit(False).alias("removed"))


def field_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted items for the broken-field check: summary never found on
    even-numbered sources, url never found when the source number % 3 = 0."""
    d = read(spark, sf_dir, "documents")
    n = source_number(F.col("source"))
    key = F.col("doc_id").cast("string")
    data = F.create_map(
        F.lit("id"), key,
        F.lit("title"), F.when(F.col("doc_id") % 13 != 0, F.col("text")),
        F.lit("summary"), F.when(n % 2 == 1, F.col("text")),
        F.lit("url"), F.when(n % 3 != 0, F.concat(F.lit("/d/"), key)))
    return d.select(F.col("source").alias("source_id"), F.lit("r1").alias("run_id"), F.lit(1).alias("page_no"),
                    F.col("doc_id").alias("page_id"), F.lit(0).alias("item_idx"), data.alias("data"),
                    F.lit(None).cast("string").alias("error"))


def heals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heal rows from labels: run = doc, applied = quality 1, mode by source origin."""
    lab = read(spark, sf_dir, "labels")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    n = source_number(F.col("source"))
    j = lab.join(docs, "doc_id")
    return j.select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("doc_id").alias("run_id"),
        F.when(F.col("toxic") == 1, "container").otherwise("title").alias("field_name"),
        F.lit("h2.old::text").alias("old_selector"), F.lit("h1::text").alias("new_selector"),
        F.lit("css").alias("selector_type"), ((F.col("doc_id") % 100) / 100.0).alias("confidence"),
        F.lit("selector drift").alias("reasoning"),
        F.when(n % 2 == 0, "pr").otherwise("db_patch").alias("mode"),
        (F.col("quality") == 1).alias("applied"),
        plus_seconds(ts_lit(T0), F.col("doc_id") * 60).alias("created_at"))


# ---------------------------------------------------------------------------
# pages


def nav_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page snapshot is one run of the source named after its site host."""
    from ..functions.urls import url_host
    p = read(spark, sf_dir, "pages")
    return p.select(url_host(F.col("url")).alias("source_id"), F.col("page_id").cast("string").alias("run_id"),
                    F.lit(1).alias("page_no"), "page_id", "url", "html")


NAV_FIELDS = (("href", "a::attr(href)", "css"), ("text", "a::text", "css"))


def nav_config(spark: SparkSession, sf_dir: str, container: str = "nav li", fields=NAV_FIELDS,
               dedupe_key: str = "href") -> DataFrame:
    """One config per site (host) seen in ``pages``; all sites share a layout,
    so they share selectors. Reads only the url column."""
    from ..functions.urls import url_host
    hosts = read(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("source_id")).distinct()
    field_structs = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("selector"),
                                       F.lit(t).alias("selector_type"), F.lit(None).cast("string").alias("attr"))
                              for n, s, t in fields])
    cfg = F.struct(
        F.col("source_id").alias("name"), F.concat(F.lit("https://"), F.col("source_id"), F.lit("/")).alias("url"),
        F.struct(F.lit(container).alias("container"), F.lit("css").alias("container_type"),
                 field_structs.alias("fields"), F.lit(dedupe_key).alias("dedupe_key")).alias("item"),
        F.struct(F.lit(None).cast("string").alias("next"), F.lit("css").alias("next_type"),
                 F.lit(1).alias("max_pages")).alias("pagination"))
    return hosts.select("source_id", cfg.alias("config"))
