"""ANSI SQL (DuckDB dialect) for every registered query, over the same parquet
tables (views region ... conversations). Written independently of the Spark
plans: window ranks instead of ``max_by``, regex extraction instead of an HTML
parser, string-built JSON instead of map functions.
"""

from __future__ import annotations

# Python's str.strip() whitespace, as an RE2 class.
_WS = ("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
       "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
_NAV_RE = '<li><a href="([^"]*)">([^<]*)</a></li>'
T0 = "TIMESTAMP '2024-01-01 00:00:00'"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def jesc(e: str) -> str:
    """JSON string escaping the way Python's json module writes it."""
    out = f"replace(replace({e}, '\\', '\\\\'), '\"', '\\\"')"
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(1, 32):
        rep = short.get(code, "\\u%04x" % code)
        out = f"replace({out}, chr({code}), '{rep}')"
    return out


def entry(key: str, val: str, optional: bool = False) -> str:
    norm = f"nfc_normalize({strip(val)})"
    quoted = f"'\"' || {jesc(norm)} || '\"'"
    if optional:
        return f"CASE WHEN {val} IS NOT NULL THEN '\"{key}\":' || {quoted} END"
    return f"'\"{key}\":' || coalesce({quoted}, 'null')"


def item_hash(entries: list[tuple]) -> str:
    """sha256 of the sorted compact JSON; ``entries`` already in key order."""
    parts = ", ".join(entry(*e) for e in entries)
    return f"sha256('{{' || concat_ws(',', {parts}) || '}}')"


def unescape(e: str) -> str:
    return f"replace(replace(replace(replace({e}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def secs(e: str) -> str:
    return f"{T0} + to_seconds(CAST({e} AS BIGINT))"


# ---------------------------------------------------------------------------
# shared CTEs

NAV_ITEMS = f"""nav AS (
  SELECT CAST(page_id AS VARCHAR) AS run_id, page_id, url,
         unnest(regexp_extract_all(html, '{_NAV_RE}', 1)) AS href,
         unnest(regexp_extract_all(html, '{_NAV_RE}', 2)) AS text,
         CAST(unnest(range(len(regexp_extract_all(html, '{_NAV_RE}', 1)))) AS INTEGER) AS item_idx
  FROM pages)"""

SOURCES = """srcn AS (SELECT DISTINCT source AS id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n
              FROM documents),
sources AS (
  SELECT id, id AS name, n, CASE WHEN n % 2 = 0 THEN 'file' ELSE 'api' END AS origin,
         'name: ' || id || chr(10) || 'url: https://' || id || '.example.com/feed/' || chr(10)
           || 'schedule: ''0 */6 * * *''' || chr(10) AS config_yaml,
         'https://' || id || '.example.com/feed/' AS base_url, 10 + n * 2 AS min_items
  FROM srcn)"""

RUNS = """runs AS (
  SELECT event_id AS run_id, 'src' || CAST(user_id % 20 AS VARCHAR) AS source_id,
         'src' || CAST(user_id % 20 AS VARCHAR) AS source_name,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'queued'
              ELSE 'ok' END AS status,
         ts AS started_at,
         CASE WHEN event_type NOT IN ('click', 'signup')
              THEN ts + to_milliseconds(CAST(round(value * 1000) AS BIGINT)) END AS ended_at,
         CASE WHEN event_type NOT IN ('click', 'signup') THEN CAST(round(value * 1000) AS BIGINT) END AS duration_ms,
         CAST(CASE WHEN event_type IN ('click', 'signup') THEN NULL WHEN event_type = 'error' THEN 0
                   ELSE event_id % 50 END AS BIGINT) AS item_count,
         CASE WHEN event_type = 'error' THEN 'fetch failed' END AS error
  FROM events)"""

_SKEY = "(CASE WHEN doc_id % 7 = 3 THEN 'old-' ELSE '' END || CAST(doc_id AS VARCHAR))"
_BKEY = "(CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 9 = 7 THEN '-new' ELSE '' END)"
STATE = f"""state AS (
  SELECT source AS source_id, {_SKEY} AS dedupe_key, text AS title,
         '/d/' || {_SKEY} AS url, lang, doc_id % 11 = 0 AS removed,
         {secs('doc_id % 1000')} AS first_seen_at,
         {secs('1000 + (doc_id * 7919) % 2590000')} AS last_seen_at,
         {item_hash([("id", _SKEY), ("lang", "lang"), ("title", "text"),
                     ("url", "'/d/' || " + _SKEY)])} AS h
  FROM documents)"""

_BTITLE = "text || CASE WHEN doc_id % 5 = 0 THEN '*' ELSE '' END"
BATCH = f"""okruns AS (SELECT DISTINCT source AS source_id, 'r1' AS run_id FROM documents WHERE source <> 'src7'),
batch AS (
  SELECT CASE WHEN source = 'src13' THEN 'src12' ELSE source END AS source_id, 'r1' AS run_id, {_BKEY} AS dedupe_key, {_BTITLE} AS title,
         {item_hash([("id", _BKEY), ("lang", "lang"), ("title", _BTITLE),
                     ("url", "'/d/' || " + _BKEY)])} AS h
  FROM documents WHERE source <> 'src7'),
s AS (SELECT * FROM state WHERE source_id IN (SELECT source_id FROM okruns)),
j AS (
  SELECT coalesce(b.source_id, s.source_id) AS source_id, coalesce(b.dedupe_key, s.dedupe_key) AS dedupe_key,
         CASE WHEN s.dedupe_key IS NULL THEN 'new'
              WHEN b.dedupe_key IS NULL THEN CASE WHEN s.removed THEN 'still_removed' ELSE 'removed' END
              WHEN s.removed THEN 'reappeared' WHEN s.h <> b.h THEN 'updated' ELSE 'unchanged' END AS change,
         s.h AS old_hash, b.h AS new_hash, s.title AS old_title, b.title AS new_title,
         s.first_seen_at, s.last_seen_at
  FROM s FULL OUTER JOIN batch b ON s.source_id = b.source_id AND s.dedupe_key = b.dedupe_key)"""

_HTITLE = "text || '#' || CAST((doc_id * r) % 3 AS VARCHAR)"
HISTORY = f"""hruns AS (
  SELECT source AS source_id, 'h' || CAST(r AS VARCHAR) AS run_id, {T0} + to_days(CAST(r AS INTEGER)) AS started_at,
         CASE WHEN source = 'src9' AND r = 2 THEN 'error' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT source FROM documents), range(5) t(r)),
ok AS (SELECT source_id, run_id,
              row_number() OVER (PARTITION BY source_id ORDER BY started_at, run_id) AS run_ix
       FROM hruns WHERE status = 'ok'),
mx AS (SELECT source_id, max(run_ix) AS max_ix FROM ok GROUP BY source_id),
hitems AS (
  SELECT source AS source_id, 'h' || CAST(r AS VARCHAR) AS run_id, CAST(doc_id AS VARCHAR) AS dedupe_key,
         {item_hash([("id", "CAST(doc_id AS VARCHAR)"), ("title", _HTITLE)])} AS h
  FROM documents, range(5) t(r)
  WHERE (doc_id + r * r) % 3 <> 0 AND NOT (source = 'src5' AND r = 3)),
pres AS (SELECT i.source_id, i.dedupe_key, o.run_ix, m.max_ix, i.h
         FROM hitems i JOIN ok o ON i.source_id = o.source_id AND i.run_id = o.run_id
         JOIN mx m ON m.source_id = i.source_id),
seq AS (SELECT *, lag(run_ix) OVER w AS prev_ix, lag(h) OVER w AS prev_h, lead(run_ix) OVER w AS next_ix
        FROM pres WINDOW w AS (PARTITION BY source_id, dedupe_key ORDER BY run_ix)),
hchg AS (
  SELECT source_id, run_ix, dedupe_key,
         CASE WHEN prev_ix IS NULL THEN 'new' WHEN prev_ix < run_ix - 1 THEN 'reappeared'
              WHEN prev_h <> h THEN 'updated' ELSE 'unchanged' END AS change, prev_h AS old_hash, h AS new_hash
  FROM seq
  UNION ALL
  SELECT source_id, run_ix + 1, dedupe_key, 'removed', h, NULL
  FROM seq WHERE (next_ix IS NULL AND run_ix < max_ix) OR next_ix > run_ix + 1)"""

HEALS = """heals AS (
  SELECT l.doc_id AS id, d.source AS source_id,
         CASE WHEN l.toxic = 1 THEN 'container' ELSE 'title' END AS field_name,
         CASE WHEN CAST(regexp_extract(d.source, '([0-9]+)', 1) AS INTEGER) % 2 = 0 THEN 'pr' ELSE 'db_patch' END AS mode,
         l.quality = 1 AS applied, (l.doc_id % 100) / 100.0 AS confidence,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(l.doc_id * 60 AS BIGINT)) AS created_at
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

_VURL = ("CASE WHEN doc_id % 6 = 0 THEN 'https://other.example.org/x/' || CAST(doc_id AS VARCHAR) "
         "WHEN doc_id % 9 = 0 THEN '' ELSE '/d/' || CAST(doc_id AS VARCHAR) END")
VIEW_ITEMS = f"""vi AS (
  SELECT source AS source_id, CAST(doc_id AS VARCHAR) AS dedupe_key, lang,
         CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS title,
         {_VURL} AS url,
         CASE WHEN doc_id % 4 = 0 THEN '/l/' || CAST(doc_id AS VARCHAR) END AS link,
         CASE WHEN doc_id % 26 = 0 THEN text END AS body
  FROM documents)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------

def _content_text(exclude_link: bool) -> str:
    preferred = "concat_ws(chr(10), nullif(title, ''), nullif(body, ''))"
    fallback = "nullif(lang, '')" if exclude_link else "concat_ws(chr(10), nullif(lang, ''), nullif(link, ''))"
    return f"CASE WHEN {preferred} <> '' THEN {preferred} ELSE coalesce({fallback}, '') END"


def _page_config_cols() -> str:
    return """page_id,
  CASE WHEN page_id % 5 = 0 THEN 'Page-' || CAST(page_id AS VARCHAR)
       WHEN page_id % 5 = 1 THEN 'page_' || CAST(page_id AS VARCHAR)
       ELSE 'page-' || CAST(page_id AS VARCHAR) END AS name,
  page_id % 5 IN (0, 1) AS bad_name, page_id % 11 = 0 AS bad_key, page_id % 7 = 0 AS bad_selector,
  page_id % 4 = 0 AS bad_pages, page_id % 6 = 0 AS bad_static, page_id % 13 = 0 AS extra_keys"""


def _host_case() -> str:
    return """CASE WHEN page_id % 9 = 0 THEN '10.' || CAST(page_id % 256 AS VARCHAR) || '.0.1'
       WHEN page_id % 9 = 1 THEN '8.8.' || CAST(page_id % 256 AS VARCHAR) || '.8'
       WHEN page_id % 9 = 2 THEN '172.' || CAST(page_id % 40 AS VARCHAR) || '.0.1'
       WHEN page_id % 9 = 3 THEN '192.168.' || CAST(page_id % 256 AS VARCHAR) || '.1'
       WHEN page_id % 9 = 4 THEN 'h' || CAST(page_id AS VARCHAR) || '.internal'
       WHEN page_id % 9 = 5 THEN '100.' || CAST(page_id % 128 AS VARCHAR) || '.3.4'
       ELSE lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) END"""


PAGE_SOURCES = """psrc AS (
  SELECT 'page-' || CAST(page_id AS VARCHAR) AS id, 'page-' || CAST(page_id AS VARCHAR) AS name, page_id AS n,
         CASE WHEN page_id % 2 = 0 THEN 'file' ELSE 'api' END AS origin, html, regexp_matches(html, '<h1[ >]') AS h1 FROM pages)"""


def _proposals() -> str:
    return """props AS (
  SELECT id AS source_id, name, n, origin,
         CASE WHEN n % 3 = 0 THEN 'h1::text' WHEN n % 3 = 1 THEN 'h9.none::text' END AS selector,
         (n % 20) / 20.0 AS confidence, 'reason ' || CAST(n AS VARCHAR) AS reasoning, h1
  FROM psrc)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["extract_nav_items"] = _with(NAV_ITEMS) + "SELECT run_id, item_idx, href, text FROM nav"

    q["page_title_fields"] = (
        "SELECT CAST(page_id AS VARCHAR) AS run_id, "
        + unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)") + " AS title, "
        + unescape("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + " AS h1 FROM pages")

    q["cap_then_dedupe"] = _with(NAV_ITEMS, f"""capped AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY item_idx) AS rn FROM nav),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, {strip('href')} ORDER BY item_idx) AS k
  FROM capped WHERE rn <= 5 AND href IS NOT NULL AND {strip('href')} <> '')""") + \
        "SELECT run_id, item_idx, href AS dedupe_key FROM firsts WHERE k = 1"

    q["duplicate_keys"] = _with(NAV_ITEMS) + \
        "SELECT run_id, href AS dedupe_key, count(*) AS n FROM nav GROUP BY run_id, href HAVING count(*) > 1"

    q["missing_keys"] = "SELECT source AS source_id, doc_id FROM documents WHERE doc_id % 17 = 0"

    q["nav_items_per_host"] = _with(NAV_ITEMS, f"""firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, {strip('href')} ORDER BY item_idx) AS k
  FROM nav WHERE {strip('href')} <> '')""") + f"""
SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) AS host, count(*) AS n_items,
       count(DISTINCT {item_hash([("href", "href"), ("text", "text")])}) AS n_distinct_items
FROM firsts WHERE k = 1 GROUP BY 1"""

    q["item_hash"] = _with(VIEW_ITEMS) + "SELECT source_id, dedupe_key, " + item_hash([
        ("body", "body", True), ("id", "dedupe_key"), ("lang", "lang", True), ("link", "link", True),
        ("title", "title"), ("url", "url")]) + " AS content_hash FROM vi"

    for name, excl in (("content_text_strict", False), ("content_text_view", True)):
        q[name] = _with(VIEW_ITEMS, f"ct AS (SELECT *, {_content_text(excl)} AS content_text FROM vi)") + \
            "SELECT source_id, dedupe_key, content_text, sha256(nfc_normalize(content_text)) AS text_hash FROM ct"

    q["resolve_item_urls"] = _with(VIEW_ITEMS, SOURCES) + """
SELECT v.source_id, v.dedupe_key AS stable_id,
       CASE WHEN coalesce(nullif(v.url, ''), nullif(v.link, ''), '') = '' THEN ''
            WHEN coalesce(nullif(v.url, ''), v.link) LIKE 'http://%' OR coalesce(nullif(v.url, ''), v.link) LIKE 'https://%'
              THEN coalesce(nullif(v.url, ''), v.link)
            ELSE regexp_extract(s.base_url, '^(https?://[^/?#]*)', 1) || coalesce(nullif(v.url, ''), v.link) END AS url,
       v.title
FROM vi v LEFT JOIN sources s ON s.id = v.source_id"""

    q["snapshot_diff"] = _with(STATE, BATCH) + \
        "SELECT source_id, 'r1' AS run_id, dedupe_key, change, old_hash, new_hash FROM j"

    q["snapshot_next_state"] = _with(STATE, BATCH) + f"""
SELECT source_id, dedupe_key,
       CASE WHEN new_hash IS NOT NULL THEN new_hash ELSE old_hash END AS content_hash,
       CASE WHEN change IN ('new', 'reappeared', 'updated') THEN new_title ELSE old_title END AS title,
       new_hash IS NULL AS removed,
       coalesce(first_seen_at, {AS_OF}) AS first_seen_at,
       CASE WHEN new_hash IS NOT NULL THEN {AS_OF} ELSE last_seen_at END AS last_seen_at
FROM j
UNION ALL
SELECT source_id, dedupe_key, h, title, removed, first_seen_at, last_seen_at
FROM state WHERE source_id NOT IN (SELECT source_id FROM okruns)"""

    q["run_summary"] = _with(STATE, BATCH) + """
SELECT o.source_id, o.run_id,
       count(*) FILTER (WHERE change IN ('new', 'reappeared', 'updated', 'unchanged')) AS item_count,
       count(*) FILTER (WHERE change IN ('new', 'reappeared')) AS items_new,
       count(*) FILTER (WHERE change = 'updated') AS items_updated,
       count(*) FILTER (WHERE change = 'removed') AS items_removed
FROM okruns o LEFT JOIN j ON j.source_id = o.source_id
GROUP BY o.source_id, o.run_id"""

    q["history_diff"] = _with(HISTORY) + """
SELECT c.source_id, o.run_id, c.run_ix, c.dedupe_key, c.change, c.old_hash, c.new_hash
FROM hchg c JOIN ok o ON o.source_id = c.source_id AND o.run_ix = c.run_ix"""

    q["source_stats"] = _with(SOURCES, RUNS, STATE, """cnt AS (
  SELECT source_id, count(*) AS item_count FROM state WHERE NOT removed GROUP BY source_id),
lr AS (SELECT source_id, started_at, status,
              row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn FROM runs)""") + """
SELECT s.id, s.name, s.origin, coalesce(c.item_count, 0) AS item_count, lr.started_at AS last_run_at,
       lr.status AS last_status
FROM sources s LEFT JOIN cnt c ON c.source_id = s.id LEFT JOIN lr ON lr.source_id = s.id AND lr.rn = 1"""

    q["latest_failed_sources"] = _with(RUNS) + """
SELECT source_id, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS started_at,
       arg_max(source_name, (started_at, run_id)) AS source_name
FROM runs WHERE status = 'error' GROUP BY source_id"""

    q["runs_page"] = _with(RUNS) + """
SELECT run_id, source_id, source_name, status, started_at, ended_at, duration_ms, item_count, error
FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20 OFFSET 10"""

    q["items_page"] = _with(STATE) + """
SELECT source_id, dedupe_key, h AS content_hash, last_seen_at FROM state
WHERE source_id = 'src3' AND NOT removed ORDER BY last_seen_at DESC, dedupe_key ASC LIMIT 10 OFFSET 5"""

    q["heals_page"] = _with(HEALS) + """
SELECT id, source_id AS source_name, field_name, mode, applied, confidence, created_at
FROM heals ORDER BY created_at DESC, id DESC LIMIT 20"""

    q["run_items_window"] = _with(RUNS, STATE) + f"""
SELECT r.run_id, r.source_id, s.dedupe_key, s.last_seen_at
FROM runs r JOIN state s ON s.source_id = r.source_id
WHERE NOT s.removed AND s.last_seen_at BETWEEN r.started_at AND coalesce(r.ended_at, {AS_OF})"""

    q["run_items_page"] = _with(RUNS, STATE) + f"""
SELECT r.run_id, r.source_id, s.dedupe_key, s.last_seen_at
FROM (SELECT * FROM runs WHERE ended_at IS NOT NULL ORDER BY started_at DESC, run_id DESC LIMIT 1) r
JOIN state s ON s.source_id = r.source_id
WHERE NOT s.removed AND s.last_seen_at BETWEEN r.started_at AND coalesce(r.ended_at, {AS_OF})
ORDER BY s.last_seen_at DESC, s.dedupe_key LIMIT 20 OFFSET 3"""

    q["run_item_counts"] = _with(RUNS, STATE) + f"""
SELECT r.run_id, r.source_id, count(s.dedupe_key) AS n_items
FROM runs r LEFT JOIN state s ON s.source_id = r.source_id AND NOT s.removed
     AND s.last_seen_at BETWEEN r.started_at AND coalesce(r.ended_at, {AS_OF})
GROUP BY r.run_id, r.source_id"""

    q["runs_page_filtered"] = _with(RUNS) + """
SELECT run_id, source_id, source_name, status, started_at, ended_at, duration_ms, item_count, error
FROM runs WHERE source_name = 'src4' ORDER BY started_at DESC, run_id DESC LIMIT 20 OFFSET 5"""

    q["heals_page_filtered"] = _with(HEALS) + """
SELECT id, source_id AS source_name, 'h2.old::text' AS old, 'h1::text' AS new, created_at
FROM heals WHERE source_id = 'src4' ORDER BY created_at DESC, id DESC LIMIT 20"""

    q["source_stats_api"] = _with(SOURCES, STATE, RUNS) + """
SELECT s.name, coalesce(c.n, 0) AS item_count, l.last_status, l.last_run_at
FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM state WHERE NOT removed GROUP BY source_id) c ON c.source_id = s.id
LEFT JOIN (SELECT source_id, max(started_at) AS last_run_at, arg_max(status, (started_at, run_id)) AS last_status
           FROM runs GROUP BY source_id) l ON l.source_id = s.id
WHERE s.origin = 'api'"""

    q["source_details"] = _with(SOURCES) + "SELECT id, name, origin, config_yaml FROM sources"

    q["latest_run_of_source"] = _with(RUNS) + """
SELECT run_id, source_id, source_name, status, started_at, ended_at, duration_ms, item_count, error
FROM runs WHERE source_id = 'src5' ORDER BY started_at DESC, run_id DESC LIMIT 1"""

    q["heals_of_deleted_runs"] = _with(RUNS, HEALS) + """
SELECT h.id, h.source_id, CASE WHEN r.run_id IS NULL THEN h.id END AS run_id, h.applied
FROM heals h LEFT JOIN runs r ON r.run_id = h.id AND r.status = 'error'"""

    q["logged_runs"] = _with(RUNS) + "SELECT run_id, source_id, status, item_count, error FROM runs"

    q["logged_heals"] = _with(HEALS) + """
SELECT source_id, count(*) AS heals, count(*) FILTER (WHERE applied) AS applied,
       count(DISTINCT CAST(created_at AS DATE)) AS days FROM heals GROUP BY source_id"""

    q["reap_stale_runs"] = _with(RUNS, f"""st AS (
  SELECT *, status = 'running' AND started_at < {AS_OF} - INTERVAL 1800 SECOND AS reaped FROM runs)""") + f"""
SELECT run_id, CASE WHEN reaped THEN 'error' ELSE status END AS status,
       CASE WHEN reaped THEN {AS_OF} ELSE ended_at END AS ended_at,
       CASE WHEN reaped THEN CAST(greatest(0, (epoch_us({AS_OF}) - epoch_us(started_at)) // 1000) AS BIGINT)
            ELSE duration_ms END AS duration_ms,
       CASE WHEN reaped THEN 'no end within 1800 s, taken as failed' ELSE error END AS error,
       reaped
FROM st"""

    q["run_state"] = _with(RUNS, """ev AS (
  SELECT run_id, source_id, 'queued' AS kind, started_at AS ts, 0 AS seq, NULL::BIGINT AS item_count,
         NULL::BIGINT AS n, NULL::BIGINT AS u, NULL::BIGINT AS r, NULL::VARCHAR AS error FROM runs
  UNION ALL
  SELECT run_id, source_id, 'running', started_at + INTERVAL 1 SECOND, 1, NULL, NULL, NULL, NULL, NULL
  FROM runs WHERE status <> 'queued'
  UNION ALL
  SELECT run_id, source_id, status, started_at + to_milliseconds(CAST(duration_ms + 1000 AS BIGINT)), 2,
         item_count, run_id % 7, run_id % 5, run_id % 3, error
  FROM runs WHERE status IN ('ok', 'error'))""") + """
SELECT run_id, arg_max(source_id, (ts, seq)) AS source_id, arg_max(kind, (ts, seq)) AS status,
       max(ts) FILTER (WHERE kind IN ('queued', 'running')) AS started_at,
       max(ts) FILTER (WHERE kind IN ('ok', 'error')) AS ended_at,
       CAST(max(CASE WHEN kind IN ('ok', 'error') THEN duration_ms END) AS BIGINT) AS duration_ms,
       CAST(max(CASE WHEN kind = 'ok' THEN item_count WHEN kind = 'error' THEN 0 END) AS BIGINT) AS item_count,
       coalesce(max(CASE WHEN kind = 'ok' THEN n END), 0) AS items_new,
       coalesce(max(CASE WHEN kind = 'ok' THEN u END), 0) AS items_updated,
       coalesce(max(CASE WHEN kind = 'ok' THEN r END), 0) AS items_removed,
       max(CASE WHEN kind = 'error' THEN error END) AS error,
       min(ts) FILTER (WHERE kind = 'queued') AS created_at
FROM ev JOIN (SELECT run_id AS rid, duration_ms FROM runs) d ON d.rid = ev.run_id
GROUP BY run_id"""

    q["unhealthy_runs"] = _with(SOURCES, RUNS) + """
SELECT r.run_id, r.source_id, r.item_count, s.min_items
FROM runs r JOIN sources s ON s.id = r.source_id
WHERE r.status = 'ok' AND s.min_items > 0 AND r.item_count < s.min_items"""

    q["broken_fields"] = _with(SOURCES, """fi AS (
  SELECT source AS source_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS n,
         bool_and(doc_id % 13 = 0) AS title_null FROM documents GROUP BY source)""") + """
SELECT source_id, 'summary' AS target, 'p.summary::text' AS old_selector FROM fi WHERE n % 2 = 0
UNION ALL SELECT source_id, 'url', 'a::attr(href)' FROM fi WHERE n % 3 = 0
UNION ALL SELECT source_id, 'title', 'h1::text' FROM fi WHERE title_null"""

    q["batch_outcome"] = _with(SOURCES, """req AS (SELECT DISTINCT 'src' || CAST(user_id % 25 AS VARCHAR) AS source FROM events)""") + """
SELECT source, CASE WHEN source IN (SELECT name FROM sources) THEN 'run' ELSE 'failed' END AS outcome,
       CASE WHEN source IN (SELECT name FROM sources) THEN NULL ELSE 'not registered: ' || source END AS error
FROM req"""

    q["batch_outcome_checked"] = _with(PAGE_SOURCES, """req AS (SELECT DISTINCT 'page-' || CAST(event_id % 5000 AS VARCHAR) AS source FROM events)""") + """
SELECT source, CASE WHEN n % 4 <> 0 THEN 'run' ELSE 'failed' END AS outcome,
       CASE WHEN id IS NULL THEN 'not registered: ' || source WHEN n % 4 = 0 THEN 'config not valid: ' || source END AS error
FROM req LEFT JOIN psrc ON name = source"""

    q["sync_page_sources"] = """
SELECT 'page-' || CAST(page_id AS VARCHAR) AS name,
       CASE WHEN page_id % 5 = 0 THEN 'skipped_invalid' WHEN page_id % 2 = 1 THEN 'inserted'
            WHEN page_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome
FROM pages"""

    q["request_names"] = """
SELECT doc_id AS request_id, 1 AS n_sources, true AS count_ok, true AS unique_ok, true AS max_items_ok,
       doc_id % 9 <> 0 AND doc_id % 70 + 4 <= 64 AS name_ok FROM documents"""

    q["page_repair_targets"] = _with(PAGE_SOURCES) + """
SELECT id AS source_id, 'container' AS target, 'article' AS old_selector FROM psrc WHERE n % 4 = 1
UNION ALL SELECT id, 'summary', 'p.summary::text' FROM psrc WHERE n % 4 <> 1 AND n % 2 = 0
UNION ALL SELECT id, 'url', 'a::attr(href)' FROM psrc WHERE n % 4 <> 1 AND n % 3 = 0"""

    q["sync_sources"] = _with(SOURCES, """fc AS (
  SELECT name, CASE WHEN n % 3 = 0 THEN config_yaml || '# v2' || chr(10) ELSE config_yaml END AS config_yaml
  FROM sources
  UNION ALL
  SELECT 'src' || CAST(n + 20 AS VARCHAR), 'name: src' || CAST(n + 20 AS VARCHAR) || chr(10) FROM sources WHERE n % 5 = 0)""") + f"""
SELECT coalesce(s.name, f.name) AS name,
       CASE WHEN s.name IS NULL OR substring(sha256(s.config_yaml), 1, 12) <> substring(sha256(f.config_yaml), 1, 12)
            THEN 'file' ELSE s.origin END AS origin,
       substring(sha256(coalesce(f.config_yaml, s.config_yaml)), 1, 12) AS config_sha,
       CASE WHEN s.name IS NULL OR substring(sha256(s.config_yaml), 1, 12) <> substring(sha256(f.config_yaml), 1, 12)
            THEN {AS_OF} ELSE {T0} END AS updated_at,
       CASE WHEN s.name IS NULL THEN 'inserted'
            WHEN f.name IS NULL THEN NULL
            WHEN substring(sha256(s.config_yaml), 1, 12) <> substring(sha256(f.config_yaml), 1, 12) THEN 'updated'
            ELSE 'unchanged' END AS outcome
FROM sources s FULL OUTER JOIN fc f ON s.name = f.name"""

    body = "'name: ' || {nm} || chr(10) || 'url: https://updated.example.com/' || chr(10)"
    q["update_sources"] = _with(SOURCES, f"""reqs AS (
  SELECT name AS path_name, name AS body_name, {body.format(nm='name')} AS yaml FROM sources WHERE n % 4 = 0
  UNION ALL SELECT name, name || '-x', {body.format(nm='name')} FROM sources WHERE n % 4 = 1
  UNION ALL SELECT name, name, {body.format(nm='name')} FROM sources WHERE n % 4 = 3
  UNION ALL SELECT 'src' || CAST(n + 100 AS VARCHAR), 'x', {body.format(nm="'x'")} FROM sources WHERE n % 5 = 0),
oc AS (
  SELECT r.path_name, r.yaml,
         CASE WHEN s.name IS NULL THEN 'not_found' WHEN s.origin = 'file' THEN 'immutable'
              WHEN r.body_name <> r.path_name THEN 'name_mismatch' ELSE 'updated' END AS outcome,
         s.config_yaml AS old_yaml
  FROM reqs r LEFT JOIN sources s ON s.name = r.path_name)""") + """
SELECT path_name, outcome,
       CASE WHEN outcome = 'not_found' THEN NULL
            WHEN outcome = 'updated' THEN substring(sha256(yaml), 1, 12)
            ELSE substring(sha256(old_yaml), 1, 12) END AS config_sha
FROM oc"""

    q["delete_sources_cascade"] = _with(SOURCES, STATE, """names AS (
  SELECT name FROM sources WHERE n % 3 = 0 UNION ALL SELECT 'src99' FROM sources WHERE n = 0),
oc AS (SELECT x.name, CASE WHEN s.name IS NULL THEN 'not_found' WHEN s.origin = 'file' THEN 'immutable'
                          ELSE 'deleted' END AS outcome
       FROM names x LEFT JOIN sources s ON s.name = x.name),
cnt AS (SELECT source_id, count(*) AS c FROM state GROUP BY source_id)""") + """
SELECT oc.name, oc.outcome, CASE WHEN oc.outcome = 'deleted' THEN 0 ELSE coalesce(cnt.c, 0) END AS items_left
FROM oc LEFT JOIN cnt ON cnt.source_id = oc.name"""

    q["config_violations"] = _with(f"pc AS (SELECT {_page_config_cols()} FROM pages)", """f AS (
  SELECT page_id, name, bad_name, (bad_key OR h = 12) AND NOT (h = 12) AS bad_key, bad_selector AND h <> 6 AS bad_selector,
         bad_pages AND h NOT IN (1, 2) AS bad_pages, bad_static AND h <> 9 AS bad_static, extra_keys,
         h IN (1, 2, 11) AS bad_number, h IN (4, 5) AS bad_kind, h IN (6, 7, 9) AS absent, h = 8 AS repeated,
         h = 12 AS no_fields, h = 10 AS bad_least
  FROM (SELECT *, page_id % 17 AS h FROM pc))""") + """
SELECT *, CAST(bad_name AS BIGINT) + CAST(bad_key AS BIGINT) + CAST(bad_selector AS BIGINT) + CAST(bad_pages AS BIGINT)
         + CAST(bad_static AS BIGINT) + CAST(extra_keys AS BIGINT) + CAST(bad_number AS BIGINT) + CAST(bad_kind AS BIGINT)
         + CAST(absent AS BIGINT) + CAST(repeated AS BIGINT) + CAST(no_fields AS BIGINT) + CAST(bad_least AS BIGINT) AS n_violations,
       NOT (bad_name OR bad_key OR bad_selector OR bad_pages OR bad_static OR extra_keys OR bad_number OR bad_kind
            OR absent OR repeated OR no_fields OR bad_least) AS valid
FROM f"""

    q["public_hosts"] = _with(f"h AS (SELECT page_id, {_host_case()} AS host FROM pages)", """p AS (
  SELECT page_id, host, regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS v4,
         TRY_CAST(split_part(host, '.', 1) AS INTEGER) AS a, TRY_CAST(split_part(host, '.', 2) AS INTEGER) AS b
  FROM h)""") + """
SELECT page_id, host,
  CASE WHEN host = '' OR host IN ('localhost', 'metadata', 'metadata.google.internal', 'instance-data',
                                  'kubernetes.default', 'kubernetes.default.svc')
         OR host LIKE '%.local' OR host LIKE '%.internal' OR host LIKE '%.localdomain' THEN false
       WHEN v4 THEN NOT (a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
                         OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a >= 240
                         OR (a = 198 AND b IN (18, 19)))
       ELSE true END AS is_public
FROM p"""

    q["paginate_links"] = """
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) AS host FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM p)
SELECT host AS source_id, url, rn AS page_no FROM r WHERE rn <= 1 + length(host) % 4"""

    q["paginate_chains"] = q["paginate_links"].replace("1 + length(host) % 4", "1000")

    q["run_first_pages"] = _with(RUNS, STATE) + f"""
SELECT run_id, source_id, rank, dedupe_key, last_seen_at FROM (
  SELECT r.run_id, r.source_id, s.dedupe_key, s.last_seen_at,
         row_number() OVER (PARTITION BY r.run_id ORDER BY s.last_seen_at DESC, s.dedupe_key) AS rank
  FROM runs r JOIN state s ON s.source_id = r.source_id AND NOT s.removed
       AND s.last_seen_at BETWEEN r.started_at AND coalesce(r.ended_at, {AS_OF}))
WHERE rank BETWEEN 2 AND 4"""

    q["rolled_up_sources"] = _with(HISTORY) + """
SELECT r.source_id, coalesce(n_new - n_removed, 0) AS live, coalesce(n_new, 0) AS n_new, coalesce(n_updated, 0) AS n_updated,
       coalesce(n_removed, 0) AS n_removed, r.runs, r.last_run_id, r.last_status
FROM (SELECT source_id, count(*) AS runs, arg_max(run_id, (started_at, run_id)) AS last_run_id,
             arg_max(status, (started_at, run_id)) AS last_status FROM hruns GROUP BY source_id) r
LEFT JOIN (SELECT source_id, count(*) FILTER (WHERE change IN ('new', 'reappeared')) AS n_new,
                  count(*) FILTER (WHERE change = 'updated') AS n_updated, count(*) FILTER (WHERE change = 'removed') AS n_removed
           FROM hchg GROUP BY source_id) c ON c.source_id = r.source_id"""

    q["items_deep_page"] = _with(STATE) + """
SELECT source_id, dedupe_key, last_seen_at FROM (
  SELECT *, row_number() OVER (ORDER BY last_seen_at DESC, dedupe_key, source_id) AS rn, count(*) OVER () AS n FROM state WHERE NOT removed)
WHERE rn > n // 2 AND rn <= n // 2 + 20"""

    q["runs_deep_page"] = _with(RUNS) + """
SELECT run_id, source_id, status, item_count FROM (
  SELECT *, row_number() OVER (ORDER BY started_at DESC, run_id DESC) AS rn, count(*) OVER () AS n FROM runs)
WHERE rn > n // 3 AND rn <= n // 3 + 25"""

    q["deletion_log_counts"] = _with(SOURCES, RUNS, STATE, HEALS, """gone AS (SELECT id FROM sources WHERE n % 5 = 0),
kept AS (SELECT * FROM runs WHERE status <> 'error' AND source_id NOT IN (SELECT id FROM gone)),
hk AS (SELECT h.id, h.id AS run_id FROM heals h WHERE source_id NOT IN (SELECT id FROM gone))""") + """
SELECT 'sources' AS table_name, count(*) AS n_rows, CAST(NULL AS BIGINT) AS with_run FROM sources WHERE n % 5 <> 0
UNION ALL SELECT 'runs', count(*), NULL FROM kept
UNION ALL SELECT 'items', count(*), NULL FROM state WHERE source_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'heals', count(*), count(*) FILTER (WHERE run_id NOT IN (SELECT run_id FROM runs WHERE run_id NOT IN (SELECT run_id FROM kept)))
FROM hk"""

    q["state_two_writers"] = _with(SOURCES, STATE) + """
SELECT source_id, dedupe_key, h AS content_hash, n % 2 = 0 OR removed AS removed
FROM state JOIN sources ON source_id = id WHERE n % 2 = 0 OR NOT removed"""

    q["state_of_one_source"] = _with(STATE) + """
SELECT source_id, dedupe_key, h AS content_hash, removed FROM state WHERE source_id = 'src3'"""

    q["apply_proposals"] = _with(PAGE_SOURCES, _proposals()) + """
SELECT source_id, 'summary' AS field_name, selector AS new_selector,
       CASE WHEN origin = 'file' THEN 'pr' ELSE 'db_patch' END AS mode,
       selector = 'h1::text' AND h1 AND origin <> 'file' AS applied, confidence
FROM props WHERE selector IS NOT NULL"""

    q["patch_records"] = _with(PAGE_SOURCES, _proposals()) + """
SELECT name AS source_name, 'heal/' || name AS branch, 'New selector for summary of ' || name AS title,
       concat_ws(chr(10), 'replaces: p.summary::text', 'with: ' || selector,
                 'sure to: ' || CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%',
                 'because: ' || reasoning, 'finds: sample') AS body
FROM props WHERE selector = 'h1::text' AND h1 AND origin = 'file'"""

    q["patched_configs"] = _with(PAGE_SOURCES, _proposals()) + """
SELECT name, origin, CASE WHEN selector = 'h1::text' AND h1 AND origin = 'api' THEN 'h1::text' ELSE 'p.summary::text' END
       AS summary_selector
FROM props"""

    q["percent_labels"] = _with(HEALS) + \
        "SELECT id, CAST(CAST(round_even(confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS confidence_text FROM heals"

    # streaming forms produce the rows of their batch forms
    q["stream_change_feed"] = q["history_diff"]
    q["stream_first_wins"] = _with(NAV_ITEMS) + "SELECT DISTINCT run_id, href AS dedupe_key FROM nav"
    q["stream_run_timeouts"] = _with(RUNS, """mxt AS (
  SELECT max(ts) AS wm FROM (
    SELECT started_at AS ts FROM runs
    UNION ALL SELECT started_at + INTERVAL 1 SECOND FROM runs WHERE status <> 'queued'
    UNION ALL SELECT started_at + to_milliseconds(CAST(duration_ms + 1000 AS BIGINT)) FROM runs
    WHERE status IN ('ok', 'error')))""") + """
SELECT run_id, status, false AS timed_out FROM runs WHERE status IN ('ok', 'error')
UNION ALL
SELECT run_id, 'error', true FROM runs, mxt
WHERE status = 'running' AND started_at + INTERVAL 1 SECOND + INTERVAL 1800 SECOND < wm"""

    late = "CASE WHEN run_id % 7 = 0 THEN 2400000 ELSE 0 END"
    q["stream_run_lifecycle"] = _with(RUNS, f"""mxt AS (
  SELECT max(ts) AS wm FROM (
    SELECT started_at + INTERVAL 1 SECOND AS ts FROM runs WHERE status <> 'queued'
    UNION ALL SELECT started_at FROM runs
    UNION ALL SELECT started_at + to_milliseconds(CAST(duration_ms + 1000 + {late} AS BIGINT)) FROM runs
    WHERE status IN ('ok', 'error')))""") + """
SELECT run_id, source_id, status, false AS timed_out FROM runs WHERE status IN ('ok', 'error')
UNION ALL
SELECT run_id, source_id, 'error', true FROM runs, mxt
WHERE status = 'running' AND started_at + INTERVAL 1 SECOND + INTERVAL 1800 SECOND < wm"""

    q["stream_first_wins_ordered"] = """
SELECT source_id, run_id, dedupe_key, page_no, item_idx, doc_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, run_id, dedupe_key ORDER BY page_no, item_idx, doc_id) AS rn FROM (
    SELECT source AS source_id, 'r' || CAST(doc_id % 3 AS VARCHAR) AS run_id, CAST((doc_id * 31) % 7 AS INTEGER) AS page_no,
           (doc_id * 17) % 1009 AS item_idx, CAST(doc_id % 50 AS VARCHAR) AS dedupe_key, doc_id FROM documents))
WHERE rn = 1"""

    q["scrape_items"] = _with(VIEW_ITEMS, f"ct AS (SELECT *, {_content_text(False)} AS content_text FROM vi)") + """
SELECT source_id, dedupe_key AS stable_id, coalesce(nullif(url, ''), '') AS url, coalesce(nullif(title, ''), '') AS title,
       content_text, sha256(nfc_normalize(content_text)) AS content_hash
FROM ct"""

    q["stale_sources"] = _with(SOURCES, RUNS, """lo AS (SELECT source_id, max(started_at) AS last_ok_at FROM runs
                                                  WHERE status = 'ok' GROUP BY source_id)""") + f"""
SELECT s.id AS source_id, s.name, lo.last_ok_at
FROM sources s LEFT JOIN lo ON lo.source_id = s.id
WHERE lo.last_ok_at IS NULL OR lo.last_ok_at < {AS_OF} - CASE WHEN s.n % 3 = 0 THEN INTERVAL 24 HOUR
                                                         WHEN s.n % 3 = 1 THEN INTERVAL 1 HOUR
                                                         ELSE INTERVAL 7 DAY END"""

    q["create_sources"] = _with(SOURCES, """req AS (SELECT 'src' || CAST(user_id % 30 AS VARCHAR) AS name, event_id AS req_ix
                                  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY req_ix) AS rk FROM req)""") + """
SELECT name, req_ix, CASE WHEN name IN (SELECT name FROM sources) OR rk > 1 THEN 'rejected' ELSE 'inserted' END AS outcome
FROM r"""

    q["removed_keys"] = _with(STATE, BATCH) + "SELECT source_id, dedupe_key FROM j WHERE change = 'removed'"

    q["reap_counts"] = _with(RUNS) + f"""
SELECT source_id, count(*) AS n_reaped FROM runs
WHERE status = 'running' AND started_at < {AS_OF} - INTERVAL 1800 SECOND GROUP BY source_id"""

    q["selector_checks"] = """
SELECT page_id,
  CASE WHEN page_id % 7 = 0 THEN 'li:nth-child(' || CAST(page_id % 5 + 1 AS VARCHAR) || ' > a'
       WHEN page_id % 3 = 0 THEN '//li[' || CAST(page_id % 5 + 1 AS VARCHAR) || ']/a/@href'
       ELSE 'nav li:nth-child(' || CAST(page_id % 5 + 1 AS VARCHAR) || ') > a::attr(href)' END AS selector,
  page_id % 7 <> 0 AS valid
FROM pages"""

    q["parse_configs"] = _with(SOURCES) + """
SELECT id, n % 7 <> 0 AS parse_ok, n % 7 <> 0 AND n % 2 = 0 AS valid,
       CASE WHEN n % 7 <> 0 AND n % 2 = 0 THEN 'article' END AS container
FROM sources"""

    q["live_count"] = _with(STATE) + \
        "SELECT count(*) AS item_count FROM state WHERE source_id = 'src3' AND NOT removed"

    q["unknown_run_events"] = _with(RUNS) + \
        "SELECT run_id + 10000000 AS run_id, 'running' AS kind FROM runs WHERE status <> 'queued' AND run_id % 50 = 0"

    q["mined_candidates"] = """
WITH p AS (SELECT 'src' || CAST(page_id % 20 AS VARCHAR) AS source_id, page_id, html FROM pages),
m AS (SELECT source_id, page_id,
             unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)\\s[^>]*?class=["'']([^"'' >]+)', 0)) AS m
      FROM p),
s AS (SELECT source_id, page_id,
             lower(regexp_extract(m, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) || '.' || regexp_extract(m, 'class=["'']([^"'' >]+)', 1)
             AS selector FROM m),
pp AS (SELECT source_id, selector, page_id, count(*) AS c FROM s GROUP BY source_id, selector, page_id)
SELECT source_id, selector, avg(c) AS per_page FROM pp GROUP BY source_id, selector"""

    q["ranked_candidates"] = _with(RUNS) + ", cand AS (" + q["mined_candidates"] + """),
e AS (SELECT source_id, avg(item_count) AS expected FROM runs WHERE status = 'ok' AND item_count > 0 GROUP BY source_id),
f AS (SELECT cand.*, expected, round(2 * (per_page * ln(per_page / expected) - (per_page - expected)), 6) AS misfit
      FROM cand LEFT JOIN e ON e.source_id = cand.source_id)
SELECT source_id, selector, per_page, round(expected, 6) AS expected, misfit,
       row_number() OVER (PARTITION BY source_id ORDER BY misfit ASC NULLS LAST, per_page DESC, selector)::INTEGER AS place FROM f"""

    q["submit_sources"] = """
SELECT 'page-' || CAST(page_id AS VARCHAR) AS name,
       CASE WHEN page_id % 7 = 0 OR page_id % 9 IN (0, 3) THEN 'rejected' ELSE 'inserted' END AS outcome,
       CAST(page_id % 7 = 0 AS BIGINT) + CAST(page_id % 9 IN (0, 3) AS BIGINT) AS n_reasons
FROM pages"""

    q["request_checks"] = """
SELECT event_id // 8 AS request_id, count(*) AS n_sources, count(*) BETWEEN 1 AND 10 AS count_ok,
       count(*) = count(DISTINCT 'src' || CAST(user_id % 7 AS VARCHAR)) AS unique_ok,
       min(CAST(floor(value) AS BIGINT) % 120) >= 1 AND max(CAST(floor(value) AS BIGINT) % 120) <= 100 AS max_items_ok
FROM events GROUP BY event_id // 8"""

    q["repair_inputs"] = _with(PAGE_SOURCES) + """
SELECT s.id AS source_id, t.target, CAST(length(s.html) AS BIGINT) AS page_chars
FROM psrc s
JOIN (SELECT 'summary' AS target, 0 AS m UNION ALL SELECT 'url', 1) t
  ON (t.m = 0 AND s.n % 2 = 0) OR (t.m = 1 AND s.n % 3 = 0)"""

    q["source_summaries"] = _with(SOURCES, RUNS, """lr AS (
  SELECT source_id, run_id, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, run_id DESC) AS rn
  FROM runs)""") + """
SELECT s.id, s.name, s.origin, substring(sha256(s.config_yaml), 1, 12) AS config_sha, lr.run_id AS last_run_id
FROM sources s LEFT JOIN lr ON lr.source_id = s.id AND lr.rn = 1"""

    q["scrape_run_summary"] = _with(NAV_ITEMS, f"""capped AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY item_idx) AS rn FROM nav),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, {strip('href')} ORDER BY item_idx) AS k
  FROM capped WHERE {strip('href')} <> ''),
ok AS (SELECT lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1)) AS source_id,
              CAST(page_id AS VARCHAR) AS run_id,
              row_number() OVER (PARTITION BY lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^:/?#]*)', 1))
                                 ORDER BY page_id) AS run_ix
       FROM pages),
mx AS (SELECT source_id, max(run_ix) AS max_ix FROM ok GROUP BY source_id),
pres AS (SELECT o.source_id, f.href AS dedupe_key, o.run_ix, m.max_ix,
                {item_hash([("href", "f.href"), ("text", "f.text")])} AS h
         FROM firsts f JOIN ok o ON o.run_id = f.run_id JOIN mx m ON m.source_id = o.source_id WHERE f.k = 1),
seq AS (SELECT *, lag(run_ix) OVER w AS prev_ix, lag(h) OVER w AS prev_h, lead(run_ix) OVER w AS next_ix
        FROM pres WINDOW w AS (PARTITION BY source_id, dedupe_key ORDER BY run_ix)),
ch AS (
  SELECT source_id, run_ix, CASE WHEN prev_ix IS NULL THEN 'new' WHEN prev_ix < run_ix - 1 THEN 'reappeared'
                                 WHEN prev_h <> h THEN 'updated' ELSE 'unchanged' END AS change FROM seq
  UNION ALL
  SELECT source_id, run_ix + 1, 'removed' FROM seq
  WHERE (next_ix IS NULL AND run_ix < max_ix) OR next_ix > run_ix + 1)""") + """
SELECT o.source_id, o.run_id,
       count(ch.change) FILTER (WHERE ch.change IN ('new', 'reappeared', 'updated', 'unchanged')) AS item_count,
       count(ch.change) FILTER (WHERE ch.change IN ('new', 'reappeared')) AS items_new,
       count(ch.change) FILTER (WHERE ch.change = 'updated') AS items_updated,
       count(ch.change) FILTER (WHERE ch.change = 'removed') AS items_removed
FROM ok o LEFT JOIN ch ON ch.source_id = o.source_id AND ch.run_ix = o.run_ix
GROUP BY o.source_id, o.run_id
"""

    q["history_run_summary"] = _with(HISTORY) + """
SELECT o.source_id, o.run_id,
       count(c.change) FILTER (WHERE c.change IN ('new', 'reappeared', 'updated', 'unchanged')) AS item_count,
       count(c.change) FILTER (WHERE c.change IN ('new', 'reappeared')) AS items_new,
       count(c.change) FILTER (WHERE c.change = 'updated') AS items_updated,
       count(c.change) FILTER (WHERE c.change = 'removed') AS items_removed
FROM ok o LEFT JOIN hchg c ON c.source_id = o.source_id AND c.run_ix = o.run_ix
GROUP BY o.source_id, o.run_id"""
    return q
