"""Extraction: pages x configs -> raw items, next links, pagination, selector tests.

Each page is parsed once inside an Arrow-batched ``mapInPandas`` task; configs
reach the task as JSON columns through a size-checked broadcast join, so one
job serves any number of sources. Document order survives as
(``page_no``, ``item_idx``) columns.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.urls import resolve_next_url, url_host
from . import dom
from ..session import shared_dir
from .common import kept, with_defaults

RAW_ITEM_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("page_no", T.IntegerType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("item_idx", T.IntegerType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("error", T.StringType()),
])

LINK_SCHEMA = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("next_href", T.StringType()),
])

MATCH_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()),
    T.StructField("matches", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])


def _with_config(pages: DataFrame, configs: DataFrame) -> DataFrame:
    cfg_fields = configs.schema["config"].dataType.fieldNames()
    pagination = F.to_json(F.col("config.pagination")) if "pagination" in cfg_fields else F.lit(None).cast("string")
    cfg = configs.select(
        F.col("source_id").alias("cfg_source"),
        F.to_json(F.col("config.item")).alias("cfg_item_json"),
        pagination.alias("cfg_pagination_json"),
    )
    return pages.join(cfg, pages["source_id"] == F.col("cfg_source")).drop("cfg_source")


def _page_columns(pages: DataFrame) -> DataFrame:
    return with_defaults(pages, {
        "run_id": F.lit(None).cast("string"),
        "page_no": F.lit(1),
        "page_id": F.lit(None).cast("long"),
    }).select(
        F.col("source_id").cast("string").alias("source_id"),
        F.col("run_id").cast("string").alias("run_id"),
        F.col("page_no").cast("int").alias("page_no"),
        F.col("page_id").cast("long").alias("page_id"),
        "url", "html")


def _extract_batches(batches):
    cache: dict = {}
    last_key, last_doc = None, None  # a page's config matches arrive consecutively: parse it once
    for pdf in batches:
        out = {k: [] for k in RAW_ITEM_SCHEMA.fieldNames()}
        for row in pdf.itertuples(index=False):
            item_cfg = cache.get(row.cfg_item_json)
            if item_cfg is None:
                item_cfg = cache[row.cfg_item_json] = json.loads(row.cfg_item_json)
            try:
                key = (row.url, len(row.html or ""), hash(row.html))
                if key != last_key:
                    last_key, last_doc = key, dom.parse_html(row.html)
                recs = dom.extract_from_doc(last_doc, item_cfg)
                err = None
            except Exception as exc:  # one bad page or selector must not fail the job
                recs, err = [], f"{type(exc).__name__}: {exc}"
            rows = [(i, r, None) for i, r in enumerate(recs)] if err is None else [(None, None, err)]
            for idx, rec, e in rows:
                out["source_id"].append(row.source_id)
                out["run_id"].append(row.run_id)
                out["page_no"].append(row.page_no)
                out["page_id"].append(row.page_id)
                out["item_idx"].append(idx)
                out["data"].append(rec)
                out["error"].append(e)
        if out["source_id"]:
            yield pd.DataFrame(out)


def extract_items(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """EXT1-EXT6, EXT11, FLT1: one row per kept container match.

    ``pages``: source_id, url, html [, run_id, page_no, page_id].
    ``configs``: source_id, config struct (item, pagination, ...).
    Output: RAW_ITEM_SCHEMA; ``error`` is set (and ``data`` null) for a page
    that could not be processed.
    """
    joined = _with_config(_page_columns(pages), configs)
    return joined.mapInPandas(_extract_batches, RAW_ITEM_SCHEMA)


def _link_batches(batches):
    cache: dict = {}
    for pdf in batches:
        out = {k: [] for k in LINK_SCHEMA.fieldNames()}
        for row in pdf.itertuples(index=False):
            pj = row.cfg_pagination_json
            pag = cache.get(pj)
            if pag is None:
                pag = cache[pj] = json.loads(pj) if pj else {}
            href = None
            if pag.get("next"):
                try:
                    href = dom.next_link(dom.parse_html(row.html), pag)
                except Exception:
                    href = None
            out["source_id"].append(row.source_id)
            out["page_id"].append(row.page_id)
            out["url"].append(row.url)
            out["next_href"].append(href)
        if out["url"]:
            yield pd.DataFrame(out)


def page_links(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """EXT7 + FN9: the first match of ``pagination.next`` on each page, resolved
    against the page URL -> (source_id, page_id, url, next_url)."""
    joined = _with_config(_page_columns(pages), configs)
    links = joined.mapInPandas(_link_batches, LINK_SCHEMA)
    return links.withColumn("next_url", resolve_next_url(F.col("next_href"), F.col("url"))).drop("next_href")


def match_pages(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """JOIN11: attach ``source_id`` to pages whose host equals the config URL host."""
    cfg = configs.select(F.col("source_id"), url_host(F.col("config.url")).alias("_host"))
    return pages.withColumn("_host", url_host(F.col("url"))) \
        .join(cfg, "_host").drop("_host")


def paginate(seeds: DataFrame, links: DataFrame, max_pages: int | None = None) -> DataFrame:
    """EXT8: follow next links from each seed until none, page missing or
    ``max_pages`` pages read.

    ``seeds``: source_id, url, max_pages.  ``links``: source_id, url, next_url
    (narrow).  Output: source_id, url, page_no.  A page with several next links
    is followed to the least one; a cycle is followed round until ``max_pages``.

    By pointer doubling: round k has every page's link 2**k pages ahead and the
    first 2**k pages of each seed, and makes twice of both, so chains of n pages
    take log2(n) rounds of two joins each. Rounds are written, so links (which
    may come from parsing every page) are derived once and a lost executor
    costs one round."""
    if max_pages is None:
        max_pages = int(seeds.agg(F.max("max_pages")).first()[0] or 1)
    ahead = links.where("next_url IS NOT NULL").groupBy("source_id", "url").agg(F.min("next_url").alias("next_url"))
    visited = seeds.select("source_id", "url", F.lit(1).alias("page_no"), F.col("max_pages").cast("int").alias("_most"))
    step = 1
    while step < max_pages:
        ahead = kept(ahead, "links-ahead")
        further = (visited.where(F.col("page_no") + step <= F.col("_most")).join(ahead, ["source_id", "url"])
                   .select("source_id", F.col("next_url").alias("url"), (F.col("page_no") + step).alias("page_no"), "_most"))
        visited = kept(visited.unionByName(further), "pages-visited")
        if not visited.where(F.col("page_no") > step).limit(1).count():
            break
        step *= 2
        if step < max_pages:
            jump = ahead.select("source_id", F.col("url").alias("next_url"), F.col("next_url").alias("_far"))
            ahead = ahead.join(jump, ["source_id", "next_url"]).select("source_id", "url", F.col("_far").alias("next_url"))
    return visited.select("source_id", "url", "page_no")


def _match_batches(batches):
    cache: dict = {}
    for pdf in batches:
        rows_out = []
        for row in pdf.itertuples(index=False):
            key = row.page_key
            doc = cache.get(key)
            if doc is None:
                if len(cache) > 64:
                    cache.clear()
                doc = cache[key] = dom.parse_html(row.html)
            err = dom.check_selector(row.selector, row.selector_type)
            if err:
                rows_out.append((row.row_id, None, err))
                continue
            try:
                vals = dom.select_values(doc, doc.root, row.selector, row.selector_type or "css")
                rows_out.append((row.row_id, vals, None))
            except Exception as exc:
                rows_out.append((row.row_id, None, str(exc)))
        if rows_out:
            yield pd.DataFrame(rows_out, columns=MATCH_SCHEMA.fieldNames())


def test_selectors(proposals: DataFrame, pages: DataFrame, on: str = "source_id") -> DataFrame:
    """EXT10: run each proposed selector over the whole current page of its
    source; adds ``matches`` array<string>, ``n_matches`` and ``selector_error``.
    ``proposals`` needs: selector, selector_type and the join key; ``pages``:
    the join key, html."""
    shared_dir(proposals.sparkSession)
    # ids fixed once by a reliable checkpoint so both uses of ``props`` agree
    props = proposals.withColumn("row_id", F.monotonically_increasing_id()).checkpoint(eager=True)
    pg = pages.select(F.col(on), F.col("html"), F.xxhash64(F.col(on), F.col("html")).alias("page_key"))
    task_in = props.select("row_id", on, "selector", "selector_type").join(pg, on)
    res = task_in.mapInPandas(_match_batches, MATCH_SCHEMA)
    return props.join(res, "row_id", "left").select(
        *[F.col(c) for c in proposals.columns],
        F.col("matches"), F.when(F.col("matches").isNull(), F.lit(0)).otherwise(F.size("matches")).alias("n_matches"),
        F.col("error").alias("selector_error"))


@F.pandas_udf(T.StringType())
def selector_error(sel: pd.Series, kind: pd.Series) -> pd.Series:
    """EXT9: null when the selector compiles, else the error text."""
    return pd.Series([None if s is None else dom.check_selector(s, k) for s, k in zip(sel, kind)], dtype=object)


def crawl(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """EXT8 + EXT1 + JOIN11 composed: attach pages to sources by host, follow
    next links from each config's seed URL for up to ``max_pages`` pages, and
    extract items from the visited pages only (``page_no`` = position in the
    crawl). Pages that are never reached are parsed once for their next link
    but contribute no items."""
    matched = match_pages(pages, configs)
    if "run_id" not in matched.columns:
        matched = matched.withColumn("run_id", F.lit(None).cast("string"))
    links = page_links(matched, configs)
    seeds = configs.select("source_id", F.col("config.url").alias("url"),
                           F.coalesce(F.col("config.pagination.max_pages"), F.lit(1)).alias("max_pages"))
    visited = paginate(seeds, links)
    reached = matched.drop("page_no").join(visited, ["source_id", "url"])
    return extract_items(reached, configs)
