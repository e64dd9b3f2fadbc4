"""For each registered query the SQL that must give the same rows in DuckDB.

Nothing here parses pages the way the operators do: elements come from a list of tags and
texts per page, paragraph ends from a running depth, and what ``inputs`` adds to the pages is
stated directly.
"""

from __future__ import annotations

from pagemill.plans import inputs as given
from pagemill.plans.inputs import duckdb_text as dd

HTML_TYPES = "'text/html', 'application/xhtml+xml', 'application/xml', 'text/xml'"
SITE, HOST = given.SITE, given.HOST
PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"
FOLDER = f"regexp_extract({PATH}, '^(.*/)', 1)"
ABOVE = f"regexp_replace({FOLDER}, '[^/]+/$', '')"

_TEXT = (
    r"trim(regexp_replace(replace(replace(replace(t, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), "
    r"'&amp\b;?', '&', 'g'), chr(32) || chr(9) || chr(10) || chr(13))"
).replace('\\"', '"')

# title, h1, a, p, li elements of the plain pages: start token i, end token j, text.
ELEMENTS = f"""
cleaned AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
    '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs') AS h FROM pages),
listed AS (SELECT page_id, url, regexp_extract_all(h, '<[^>]*>|[^<]+') AS l FROM cleaned),
numbered AS (SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM listed),
toks AS (SELECT *, sum(CASE WHEN t = '<p>' THEN 1 WHEN t = '</p>' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS d,
    regexp_extract(t, '^<(title|h1|a|p|li)[ >]', 1) AS tag FROM numbered),
spans AS (SELECT s.page_id, s.url, s.i, s.tag, any_value(s.t) AS t, min(e.i) AS j FROM toks s JOIN toks e
    ON s.page_id = e.page_id AND e.i > s.i AND CASE WHEN s.tag = 'p' THEN e.t = '</article>' OR (e.t = '</p>' AND e.d < s.d)
       ELSE e.t = concat('</', s.tag, '>') END
    WHERE s.tag <> '' GROUP BY ALL),
els AS (SELECT s.page_id, s.url, s.i, s.j, s.tag, regexp_extract(any_value(s.t), 'href="([^"]*)"', 1) AS href,
    coalesce(string_agg(x.txt, '' ORDER BY x.i), '') AS txt
    FROM spans s LEFT JOIN (SELECT page_id, i, {_TEXT} AS txt FROM toks WHERE t NOT LIKE '<%') x
    ON s.page_id = x.page_id AND x.i > s.i AND x.i < s.j GROUP BY s.page_id, s.url, s.i, s.j, s.tag)"""

# Records of the plain pages; rk is the field's rank, k the order within it.
PLAIN = f"""{ELEMENTS},
plain AS (
  SELECT page_id, url, 0 AS rk, min(i) AS k, 'title' AS type, arg_min(txt, i) AS value, NULL AS text, NULL AS level FROM els WHERE tag = 'title' GROUP BY page_id, url
  UNION ALL SELECT page_id, url, 2, i, 'heading', txt, NULL, 'h1' FROM els WHERE tag = 'h1' AND txt <> ''
  UNION ALL SELECT page_id, url, 3, i, 'paragraph', txt, NULL, NULL FROM els WHERE tag = 'p' AND txt <> ''
  UNION ALL SELECT page_id, url, 4, i, 'link', concat({SITE}, href), txt, NULL FROM els WHERE tag = 'a')"""


def plain(*types: str) -> str:
    """CTE ``recs``: plain records of these types with their ``ord``."""
    kinds = ", ".join(f"'{t}'" for t in types)
    return f"""WITH {PLAIN},
recs AS (SELECT page_id, url AS source_url, row_number() OVER (PARTITION BY page_id ORDER BY rk, k) - 1 AS ord, type, value, text, level
  FROM plain WHERE type IN ({kinds}))"""


# Records of the enriched pages.
_ON_CDN = "page_id % 3 = 0"
_CDN = "concat('https://cdn', page_id % 7, '.example.com')"
_ORIGIN = f"CASE WHEN {_ON_CDN} THEN {_CDN} ELSE {SITE} END"
_BASE_FOLDER = f"CASE WHEN {_ON_CDN} THEN concat({_CDN}, '/d/e/') ELSE concat({SITE}, {FOLDER}) END"
_BASE_ABOVE = f"CASE WHEN {_ON_CDN} THEN concat({_CDN}, '/d/') ELSE concat({SITE}, {ABOVE}) END"


def _extra(rank: int, order: int, kind: str, value: str, text: str = "NULL", level: str = "NULL", table: str = "NULL",
           row: str = "NULL", headers: str = "NULL", when: str = "true") -> str:
    return (
        f"SELECT page_id, url, {rank} AS rk, {order} AS k, '{kind}' AS type, {value} AS value, {text} AS text, {level} AS level, "
        f"{table} AS table_index, {row} AS row_index, {headers} AS table_headers FROM pages WHERE {when}"
    )


_EXTRAS = " UNION ALL ".join(
    (
        _extra(1, 0, "meta_description", "concat('About <', page_id, '>')"),
        _extra(1, 1, "meta_keywords", "concat('k', page_id, ', page')", when="page_id % 2 <> 0"),
        _extra(2, 10_000_000, "heading", "concat('Main', page_id)", level="'h2'"),
        _extra(2, 10_000_001, "heading", "concat('Sub ', page_id)", level="'h3'"),
        _extra(5, 0, "image", f"concat({_BASE_FOLDER}, 'pic/', page_id, '.png')", "concat('Photo ', page_id)"),
        _extra(5, 1, "image", f"concat({_ORIGIN}, '/logo.png')", "''"),
        _extra(6, 0, "table_row", "concat(page_id, ' | ', length(html))", table="0", row="0", headers="'Id | Len'"),
        _extra(6, 1, "table_row", "'xy | &'", table="0", row="2", headers="'Id | Len'"),
        _extra(6, 2, "table_row", "concat('only ', page_id, 'in | in')", table="1", row="0"),
        _extra(6, 3, "table_row", "'in'", table="1", row="1"),
        _extra(6, 4, "table_row", "'in'", table="2", row="0"),
        _extra(7, 0, "open_graph", "concat('Title ', page_id)", "'og:title'"),
        _extra(7, 1, "open_graph", f"concat({_BASE_ABOVE}, 'img/', page_id, '.png')", "'og:image'"),
        _extra(7, 2, "open_graph", "concat('mailto:x', page_id)", "'og:url'"),
        _extra(8, 0, "canonical_url", f"CASE WHEN page_id % 4 <> 0 THEN concat({SITE}, '/c/', page_id) ELSE concat({SITE}, '/second') END"),
    )
)
_RICH = f"""{PLAIN},
rich_all AS (SELECT page_id, url, rk, k, type, CASE WHEN type = 'link' AND {_ON_CDN} THEN concat({_CDN}, substr(value, length({SITE}) + 1)) ELSE value END AS value,
    text, level, NULL AS table_index, NULL AS row_index, NULL AS table_headers FROM plain UNION ALL {_EXTRAS})"""


def rich(*ranks: int) -> str:
    """CTE ``recs``: records of the enriched pages of these fields."""
    return f"""WITH {_RICH},
recs AS (SELECT page_id, url AS source_url, row_number() OVER (PARTITION BY page_id ORDER BY rk, k) - 1 AS ord, type, value, text, level,
  CAST(table_index AS int) AS table_index, CAST(row_index AS int) AS row_index, table_headers FROM rich_all WHERE rk IN ({', '.join(map(str, ranks))}))"""


ALL_RANKS = tuple(range(9))


def _cell(text: str) -> str:
    guarded = f"CASE WHEN regexp_matches({text}, '^[=+@-]') THEN concat('''', {text}) ELSE {text} END"
    return f"replace(replace(replace({guarded}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# References against every page's URL.
_SCHEME = "regexp_extract(url, '^(https?)', 1)"
_CASES = (
    ("/about", f"concat({SITE}, '/about')"),
    ("img/logo.png", f"concat({SITE}, {FOLDER}, 'img/logo.png')"),
    ("../up/x", f"concat({SITE}, {ABOVE}, 'up/x')"),
    ("./a/./b/../c?d=1", f"concat({SITE}, {FOLDER}, 'a/c?d=1')"),
    ("#part", "concat(regexp_extract(url, '^([^#]*)', 1), '#part')"),
    ("?q=2", f"concat({SITE}, {PATH}, '?q=2')"),
    ("//cdn.example.com/y", f"concat({_SCHEME}, '://cdn.example.com/y')"),
    ("HTTPS://Other.example.com/A/../b", f"concat(CASE WHEN {_SCHEME} = 'https' THEN 'https' ELSE 'HTTPS' END, '://Other.example.com/A/../b')"),
    (" /trim ", f"concat({SITE}, '/trim')"),
    ("/a;p", f"concat({SITE}, '/a;p')"),
    ("x#", f"concat({SITE}, {FOLDER}, 'x')"),
)
_WHEN = " ".join(f"WHEN '{href}' THEN {value}" for href, value in _CASES)

_FIRST_PER_VALUE = "SELECT *, row_number() OVER (PARTITION BY page_id, type, value ORDER BY ord) AS copy FROM recs"

_DISPLAY = f"""{rich(0, 1, 2, 4)},
shown AS (SELECT page_id, ord, type, CASE WHEN page_id % 5 = 2 THEN concat(' ', chr(9)) ELSE value END AS value, text, level, source_url FROM recs)"""


def _mentions(word: str) -> str:
    return " OR ".join(f"coalesce(contains(lower({c}), '{word}'), false)" for c in ("type", "value", "text", "level", "source_url"))


_FILLED = "trim(value, concat(' ', chr(9))) <> ''"

_ROBOTS_RULES = f"""SELECT p.page_id, p.url, CASE WHEN r.status IS NULL THEN true ELSE CASE length(r.site) % 6
    WHEN 0 THEN {PATH.replace('url', 'p.url', 1)} LIKE '/en/%'
    WHEN 1 THEN {PATH.replace('url', 'p.url', 1)} NOT LIKE '/fr/%'
    WHEN 3 THEN {PATH.replace('url', 'p.url', 1)} NOT LIKE '/en/4%' AND {PATH.replace('url', 'p.url', 1)} NOT LIKE '/de/%'
    ELSE true END END AS allowed,
  CASE WHEN r.status IS NULL THEN 'robots.txt could not be fetched; proceeding without check.'
    WHEN r.status = 500 THEN 'robots.txt fetch returned HTTP 500; proceeding without check.' ELSE '' END AS warning
  FROM pages p LEFT JOIN ({dd(given.ROBOTS)}) r ON r.site = {SITE.replace('url', 'p.url')}"""

_HOST_VERDICTS = f"""SELECT host, bool_or(coalesce(ip LIKE '10.%' OR ip = 'fe80::1' OR ip = 'not an address'
    OR (ip LIKE '172.%' AND CAST(regexp_extract(ip, '^172[.]([0-9]+)', 1) AS int) BETWEEN 16 AND 31), false)) AS blocked
  FROM (SELECT host, ip FROM ({dd(given.ADDRESSES)}) a) b GROUP BY host"""
_HOST_VERDICTS = _HOST_VERDICTS.replace("CAST(regexp_extract", "TRY_CAST(regexp_extract")


def _chains(edges: str, blocked: str) -> str:
    """``edges``: url, hop (redirects), target."""
    refused = "regexp_extract({}, '^https?://([^/]+)', 1) IN (SELECT host FROM blocked)"
    return f"""WITH RECURSIVE edges AS ({edges}), blocked AS ({blocked}),
chain AS (
  SELECT url AS start_url, url AS here, 0 AS hops, CASE WHEN {refused.format('url')} THEN 'blocked' END AS outcome FROM edges
  UNION ALL
  SELECT c.start_url, CASE WHEN e.hop AND c.hops < 3 AND e.target <> '' THEN e.target ELSE c.here END,
    c.hops + CASE WHEN e.hop THEN 1 ELSE 0 END,
    CASE WHEN e.url IS NULL THEN 'missing' WHEN NOT e.hop THEN 'ok' WHEN c.hops >= 3 THEN 'too_many' WHEN coalesce(e.target, '') = '' THEN 'ok'
      WHEN {refused.format('e.target')} THEN 'blocked' END
  FROM chain c LEFT JOIN edges e ON e.url = c.here WHERE c.outcome IS NULL)
SELECT start_url, here AS final_url, hops, outcome FROM chain WHERE outcome IS NOT NULL"""


_REFRESH_TARGET = "CASE WHEN page_id % 6 > 1 THEN concat('https://r.example.com/p/', page_id + page_id % 4 + 1) END"

_HISTORY = f"""{rich(1)},
runs AS (SELECT * FROM (VALUES ('r1', 1, 1700000000), ('r2', 2, 1700000030)) AS v(run, step, first)),
jobs AS (SELECT run, p.page_id AS id, p.url, 'done' AS status, (SELECT count(*) FROM recs r WHERE r.page_id = p.page_id) AS record_count,
  p.page_id % 100 + 0.25::double AS duration_ms, first + p.page_id % 60 AS created_s FROM pages p JOIN runs ON p.page_id % step = 0),
job_records AS (SELECT run, page_id AS job_id, type, value FROM recs JOIN runs ON page_id % step = 0 WHERE type = 'meta_keywords')"""

_STORES = """WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events),
stores AS (SELECT user_id, min(us) AS us FROM ev GROUP BY user_id
  UNION ALL SELECT s.user_id, (SELECT min(e.us) FROM ev e WHERE e.user_id = s.user_id AND e.us > s.us + 86400000000) AS us
  FROM stores s WHERE s.us IS NOT NULL),
served AS (SELECT e.event_id, e.user_id, e.us, (SELECT max(s.us) FROM stores s WHERE s.user_id = e.user_id AND s.us <= e.us) AS stored_us FROM ev e)
SELECT event_id, user_id, NOT (us = stored_us AND event_id = min(event_id) OVER (PARTITION BY user_id, us)) AS hit, stored_us FROM served"""

_STORES_REPEATED = """WITH RECURSIVE once AS (SELECT CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, epoch_us(ts) AS us, event_id FROM events),
ev AS (SELECT *, coalesce(user_id, -1) AS k FROM (SELECT * FROM once UNION ALL SELECT * FROM once) e),
stores AS (SELECT k, min(us) AS us FROM ev GROUP BY k
  UNION ALL SELECT s.k, (SELECT min(e.us) FROM ev e WHERE e.k = s.k AND e.us > s.us + 86400000000) AS us FROM stores s WHERE s.us IS NOT NULL),
served AS (SELECT e.*, s.us AS stored_us FROM ev e ASOF JOIN (SELECT * FROM stores WHERE us IS NOT NULL) s ON s.k = e.k AND s.us <= e.us)
SELECT event_id, user_id, NOT (us = stored_us AND row_number() OVER (PARTITION BY k, us ORDER BY event_id) = 1) AS hit, stored_us FROM served"""

_RATES = """SELECT user_id, epoch_us(date_trunc('day', ts)::timestamp) AS window_us, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2"""

_SPACING_AUDIT = """SELECT * FROM (SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000.0::double AS gap_ms FROM events) g
      WHERE gap_ms < 3600000"""

_SPACING_SCHEDULE = """WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
      s AS (SELECT event_id, user_id, k, us AS slot_us FROM ev WHERE k = 1
        UNION ALL SELECT e.event_id, e.user_id, e.k, greatest(e.us, s.slot_us + 40000000000) FROM s JOIN ev e ON e.user_id = s.user_id AND e.k = s.k + 1)
      SELECT event_id, slot_us FROM s"""

_EXTRA = """CASE WHEN type = 'link' THEN json_object('text', text) WHEN type = 'heading' THEN json_object('level', level) END"""

_CRAWL = f"""{plain('title', 'link')}, allowed AS ({_ROBOTS_RULES}),
kept AS (SELECT * FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1 AND page_id IN (SELECT page_id FROM allowed WHERE allowed))"""

_HOST_OF = "regexp_extract({}, '^https?://([^/]+)', 1)"
_CRAWL_BATCH = f"""WITH RECURSIVE {PLAIN}, recs AS (SELECT page_id, count(*) AS n FROM plain WHERE type IN ('title', 'link') GROUP BY page_id),
blocked AS ({given.BLOCKED_SITES}), responses AS ({dd(given.CRAWL_RESPONSES)}),
chain AS (
  SELECT url AS start_url, url AS here, 0 AS hops, CASE WHEN {_HOST_OF.format('url')} IN (SELECT host FROM blocked) THEN 'blocked' END AS outcome FROM responses
  UNION ALL
  SELECT c.start_url, CASE WHEN e.status <> 200 AND c.hops < 3 AND e.location <> '' THEN e.location ELSE c.here END, c.hops + CASE WHEN e.status <> 200 THEN 1 ELSE 0 END,
    CASE WHEN e.url IS NULL THEN 'missing' WHEN e.status = 200 THEN 'ok' WHEN c.hops >= 3 THEN 'too_many' WHEN coalesce(e.location, '') = '' THEN 'ok'
      WHEN {_HOST_OF.format('e.location')} IN (SELECT host FROM blocked) THEN 'blocked' END
  FROM chain c LEFT JOIN responses e ON e.url = c.here WHERE c.outcome IS NULL),
known AS (SELECT page_id, url, CASE WHEN coalesce(content_type, '') NOT LIKE 'text/html%' THEN 'content_type' WHEN octet_length(encode(html)) > 6000 THEN 'too_large' ELSE 'ok' END AS state,
  nullif(regexp_extract(html, '^<meta http-equiv="refresh" content="0; url=([^"]*)', 1), '') AS target FROM responses),
fetched AS (SELECT c.start_url AS url, k.page_id AS page, CASE WHEN c.outcome = 'ok' THEN k.state ELSE c.outcome END AS state,
  CASE WHEN c.outcome = 'ok' AND k.state = 'ok' THEN k.target END AS target FROM chain c LEFT JOIN known k ON k.url = c.here WHERE c.outcome IS NOT NULL),
refreshed AS (
  SELECT url AS start_url, url AS here, 0 AS hops, CASE WHEN {_HOST_OF.format('url')} IN (SELECT host FROM blocked) THEN 'blocked' END AS outcome FROM fetched
  UNION ALL
  SELECT c.start_url, CASE WHEN f.target IS NOT NULL AND c.hops < 3 THEN f.target ELSE c.here END, c.hops + CASE WHEN f.target IS NOT NULL THEN 1 ELSE 0 END,
    CASE WHEN f.url IS NULL THEN 'missing' WHEN f.target IS NULL THEN 'ok' WHEN c.hops >= 3 THEN 'too_many'
      WHEN {_HOST_OF.format('f.target')} IN (SELECT host FROM blocked) THEN 'blocked' END
  FROM refreshed c LEFT JOIN fetched f ON f.url = c.here WHERE c.outcome IS NULL),
ended AS (SELECT q.page_id, q.url, f.page, CASE WHEN regexp_extract(q.url, '//r([0-9]+)[.]', 1) = '3' THEN 'robots_disallowed' WHEN c.outcome = 'ok' THEN f.state ELSE c.outcome END AS state
  FROM responses q JOIN refreshed c ON c.start_url = q.url AND c.outcome IS NOT NULL LEFT JOIN fetched f ON f.url = c.here)
SELECT e.page_id, e.url, state = 'ok' AS success, CAST(CASE WHEN state = 'ok' THEN coalesce(r.n, 0) ELSE 0 END AS int) AS record_count,
  CASE WHEN regexp_extract(e.url, '//r([0-9]+)[.]', 1) = '4' THEN 'robots.txt fetch returned HTTP 500; proceeding without check.' ELSE '' END AS warning, t.code, t.message AS error
FROM ended e LEFT JOIN recs r ON r.page_id = e.page LEFT JOIN (VALUES
  ('missing', 'INTERNAL_ERROR', 'Something went wrong on our end. Please try again.'),
  ('robots_disallowed', 'ROBOTS_DISALLOWED', 'The target site''s robots.txt disallows scraping this URL.'),
  ('blocked', 'SSRF_BLOCKED', 'That URL points to a private or internal address and cannot be scraped.'),
  ('too_many', 'UPSTREAM_HTTP_ERROR', 'The target site returned an error or too many redirects.'),
  ('content_type', 'CONTENT_TYPE_UNSUPPORTED', 'The URL did not return an HTML page (e.g. it returned a PDF or image).'),
  ('too_large', 'RESPONSE_TOO_LARGE', 'The page is too large to process.')) AS t(state, code, message) USING (state)"""


def _saved_rich(kept: str) -> str:
    return f"""{rich(2, 4, 6)}, firsts AS ({_FIRST_PER_VALUE}), saved AS (
      SELECT run, page_id, row_number() OVER (PARTITION BY run, page_id ORDER BY ord) - 1 AS ord, type, value, text, level, table_index, row_index, table_headers
      FROM firsts JOIN (VALUES ('r1', 1), ('r2', 2)) AS v(run, step) ON page_id % step = 0 AND (run = 'r1' OR type = 'link') WHERE copy = 1)
      SELECT run, page_id AS job_id, ord, type, value, text, level, table_index, row_index, table_headers FROM saved WHERE {kept}"""


ORACLES: dict[str, str] = {
    # sources and sinks
    "read_pages": "SELECT page_id, url, CAST(length(html) AS int) AS n_chars FROM pages",
    "read_url_list": "SELECT url FROM pages",
    "write_csv": f"{rich(0, 4, 6)} SELECT {_cell('type')} AS type, {_cell('value')} AS value, nullif({_cell('text')}, '') AS text, table_index, {_cell('source_url')} AS source_url FROM recs",
    "write_json": f"{rich(0, 4, 6)} SELECT type, value, text, table_index, source_url FROM recs",
    "export_view": f"{rich(0, 4, 6)} SELECT type, {_cell('value')} AS value, {_cell('text')} AS text, table_index, {_cell('source_url')} AS source_url FROM recs",
    "export_cap": f"{plain('link')} SELECT type, count(*) AS n FROM recs GROUP BY type",
    "save_history": f"""{plain('title', 'heading', 'link')}, firsts AS ({_FIRST_PER_VALUE}),
      runs AS (SELECT * FROM (VALUES ('r1', 1, 'title,headings,links', 1700000000, 12.5::double, false), ('r2', 3, 'title', 1800000000, 2.5::double, true)) AS v(run, step, fields, first, duration_ms, used_js))
      SELECT run, p.page_id AS id, p.url, fields, 'done' AS status, CAST(count(f.value) AS int) AS record_count, 0 AS warning_count, duration_ms, first + p.page_id AS created_s, used_js
      FROM runs JOIN pages p ON p.page_id % step = 0 LEFT JOIN firsts f ON f.page_id = p.page_id AND f.copy = 1 AND (run = 'r1' OR f.type = 'title') GROUP BY ALL""",
    "save_history_records": f"""{plain('title', 'heading', 'link')}, firsts AS ({_FIRST_PER_VALUE})
      SELECT run, page_id AS job_id, row_number() OVER (PARTITION BY run, page_id ORDER BY ord) - 1 AS ord, type, value, CAST({_EXTRA} AS varchar) AS extra, source_url
      FROM firsts JOIN (VALUES ('r1', 1), ('r2', 3)) AS v(run, step) ON page_id % step = 0 AND (run = 'r1' OR type = 'title') WHERE copy = 1""",
    "read_history_records": _saved_rich("true"),
    "read_history_job": _saved_rich("page_id = 4 AND run = 'r2'"),
    "read_responses": """SELECT url, 200 AS status, content_type, CAST(CASE WHEN page_id % 6 = 3 THEN 2 * length(html) ELSE octet_length(encode(html)) END AS int) AS n_bytes
      FROM (""" + dd(given.RAW_RESPONSES).replace("SELECT page_id, url,", "SELECT page_id, url, html,") + ") r",
    "read_body_files": "SELECT page_id % 4 AS part, CAST(sum(octet_length(encode(html)) + 1) AS int) AS n_bytes, 200 AS status FROM pages GROUP BY part",
    "read_body_files_capped": """WITH b AS (SELECT CAST(page_id % 8 <> 0 AS bigint) AS part, CAST(sum(octet_length(encode(html)) + 1) AS int) AS n FROM pages GROUP BY ALL)
      SELECT part, CASE WHEN n = (SELECT min(n) FROM b) THEN n END AS n_bytes, CASE WHEN n > (SELECT min(n) FROM b) THEN 'RESPONSE_TOO_LARGE' END AS code FROM b""",
    # extraction
    "shred": f"""WITH {ELEMENTS}, kept AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS node_id FROM els WHERE tag <> 'li')
      SELECT k.page_id, CAST(k.node_id AS int) AS node_id, (SELECT CAST(max(x.node_id) AS int) FROM kept x WHERE x.page_id = k.page_id AND x.i >= k.i AND x.i < k.j) AS end_id,
      k.tag, CASE WHEN k.tag = 'a' THEN k.href END AS href, k.txt AS text FROM kept k""",
    "page_nodes": f"WITH {ELEMENTS} SELECT page_id, tag, CASE WHEN tag = 'a' THEN href END AS href, txt AS text FROM els WHERE tag <> 'li'",
    "extract_title": f"{plain('title')} SELECT page_id, value, source_url FROM recs",
    "extract_headings": f"{rich(2)} SELECT page_id, type, value, source_url, level FROM recs",
    "extract_paragraphs": f"{plain('paragraph')} SELECT page_id, ord, value FROM recs",
    "extract_links": f"{plain('link')} SELECT page_id, ord, value, text, source_url FROM recs",
    "extract_images": f"{rich(5)} SELECT page_id, type, value, source_url, text FROM recs",
    "extract_tables": f"{rich(6)} SELECT page_id, type, value, source_url, table_index, row_index, table_headers FROM recs",
    "extract_meta": f"{rich(1)} SELECT page_id, type, value, source_url FROM recs",
    "extract_open_graph": f"{rich(7)} SELECT page_id, type, value, source_url, text FROM recs",
    "extract_canonical": f"{rich(8)} SELECT page_id, type, value, source_url FROM recs",
    "base_url": f"SELECT page_id, CASE WHEN {_ON_CDN} THEN concat({_CDN}, '/d/e/f.html') ELSE url END AS base FROM pages",
    "extract_records": f"{rich(*ALL_RANKS)} SELECT page_id, ord, type, value, text, level, table_index, row_index, table_headers, source_url FROM recs",
    "extract_warnings": "SELECT page_id, url, concat(unnest(['title', 'links']), ': extraction failed') AS message FROM pages WHERE page_id % 10 = 0",
    "extract_batch": f"""{plain('title', 'link')} SELECT p.page_id, p.url, p.page_id % 10 <> 0 AS success,
      CAST(count(r.value) AS int) AS record_count, p.page_id % 10 = 0 AS has_error FROM pages p LEFT JOIN recs r ON r.page_id = p.page_id AND p.page_id % 10 <> 0 GROUP BY p.page_id, p.url""",
    "flatten_batch": f"{plain('title', 'link')} SELECT page_id, ord, type, value, text FROM recs WHERE page_id % 10 <> 0",
    "flatten_batch_warnings": "SELECT page_id, true AS named FROM pages WHERE page_id % 10 = 0",
    "extraction_types": f"""{plain('title', 'heading', 'paragraph', 'link')}, fields AS (SELECT unnest(['title', 'meta', 'headings', 'paragraphs', 'links', 'images', 'tables', 'open_graph', 'canonical_url']) AS field, generate_subscripts(range(9), 1) - 1 AS position)
      SELECT CAST(position AS int) AS position, field, CAST((SELECT count(*) FROM recs WHERE type = rtrim(field, 's')) AS bigint) AS n FROM fields""",
    "site_header": f"""{plain('title')} SELECT p.page_id, p.url, r.value AS title, lower({HOST.replace('url', 'p.url')}) AS hostname,
      concat('https://', lower({HOST.replace('url', 'p.url')}), '/favicon.ico') AS favicon_url FROM pages p LEFT JOIN recs r ON r.page_id = p.page_id""",
    "registered_extractor": f"WITH {ELEMENTS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ord, 'list_item' AS type, txt AS value FROM els WHERE tag = 'li'",
    "page_budget": f"""WITH {ELEMENTS}, n AS (SELECT page_id, count(*) AS k FROM els WHERE tag = 'title' AND txt <> '' GROUP BY page_id)
      SELECT page_id, page_id % 10 <> 0 AS success, CAST(CASE WHEN page_id % 10 = 0 THEN 0 ELSE coalesce(k, 0) + CASE WHEN page_id % 20 = 5 THEN 2 ELSE 0 END END AS int) AS record_count,
      CASE WHEN page_id % 10 = 0 THEN 'its records exceed the 67108864-byte limit' END AS error FROM pages LEFT JOIN n USING (page_id)""",
    "isolated_extractors": f"""WITH {ELEMENTS}, n AS (SELECT page_id, count(*) FILTER (tag = 'title' AND txt <> '') AS n_title, count(*) FILTER (tag = 'li') AS n_li, count(*) FILTER (tag = 'h1') AS n_h1 FROM els GROUP BY page_id),
      f AS (SELECT page_id, url, page_id % 7 = 0 AS no_items, length(url) % 10 = 0 AS no_words FROM pages),
      c AS (SELECT page_id, CAST(n_title AS int) AS n_title, CASE WHEN no_items THEN 0 ELSE CAST(n_li AS int) END AS n_list_item, CASE WHEN no_words THEN 0 ELSE CAST(n_h1 AS int) END AS n_h1_size,
        concat_ws('; ', CASE WHEN no_items THEN concat('list_items: extraction failed — page ', page_id, ' refused') END, CASE WHEN no_words THEN concat('first_words: extraction failed — no words wanted of ', url) END) AS warnings FROM f JOIN n USING (page_id))
      SELECT page_id, true AS success, CAST(n_title + n_list_item + n_h1_size AS int) AS record_count, warnings, n_title, n_list_item, n_h1_size FROM c""",
    "isolated_warnings": """SELECT page_id, url, concat('list_items: extraction failed — page ', page_id, ' refused') AS message FROM pages WHERE page_id % 7 = 0
      UNION ALL SELECT page_id, url, concat('first_words: extraction failed — no words wanted of ', url) AS message FROM pages WHERE length(url) % 10 = 0""",
    # projections
    "resolve_url": f"SELECT page_id, href, CASE href {_WHEN} END AS resolved FROM ({dd(given.REFERENCES)}) q",
    "absolute_redirect": f"""SELECT page_id, href, CASE href {_WHEN} WHEN '' THEN url WHEN 'mailto:a@b.c' THEN href WHEN 'javascript:x' THEN href
      WHEN 'ftp://f.example.com/x' THEN href END AS target FROM ({dd(given.REFERENCES)}) q""",
    "url_parts": f"SELECT page_id, {_SCHEME} AS scheme, {HOST} AS netloc, lower({HOST}) AS hostname, {SITE} AS site, concat({SITE}, '/robots.txt') AS robots_url FROM pages",
    "cache_key": f"SELECT event_id, sha256(concat(url, '|', array_to_string(list_sort(fields), ','))) AS cache_key FROM ({dd(given.REQUESTS)}) q",
    "make_cursor": "SELECT page_id, to_base64(encode(CAST(page_id AS varchar))) AS cursor FROM pages",
    "parse_cursor": """SELECT page_id, page_id AS parsed, page_id AS parsed_dirty, CAST(0 AS bigint) AS parsed_bad,
      CASE WHEN page_id % 2 = 0 THEN page_id ELSE 0 END AS parsed_maybe FROM pages""",
    "clean_cell": f"SELECT doc_id, {_cell('text')} AS cell, concat('''=', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS formula_cell FROM documents",
    "display_text": f"""{rich(0, 1, 4, 8)} SELECT page_id, ord, CASE type WHEN 'title' THEN 'Title' WHEN 'link' THEN 'Link' WHEN 'canonical_url' THEN 'Canonical' ELSE 'Meta' END AS type_label,
      value, coalesce(text, '') AS text_or_alt, '' AS level, source_url FROM recs""",
    "detect_charset": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'UTF-8' WHEN 3 THEN 'utf-16-be' WHEN 4 THEN 'no-such-charset' ELSE 'utf-8' END AS charset FROM pages",
    "decode_body": """SELECT page_id, url, html, CASE page_id % 6 WHEN 0 THEN 'UTF-8' WHEN 3 THEN 'utf-16-be' ELSE 'utf-8' END AS encoding FROM pages WHERE page_id % 6 <> 2""",
    "meta_refresh_target": f"SELECT page_id, {_REFRESH_TARGET} AS target FROM pages",
    "field_list": f"""SELECT event_id, array_to_string(fields, ',') AS joined, concat_ws(',', fields[1], fields[2], fields[3]) AS joined_distinct,
      CAST(len(fields) AS int) AS n_split, CAST(len(list_distinct(fields)) AS int) AS n_distinct FROM ({dd(given.REQUESTS)}) q""",
    "backoff_seconds": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 2.0 WHEN 4 THEN 4.0 ELSE 8.0 END::double AS backoff FROM events",
    "clamp_progress": "SELECT event_id, CAST(greatest(0, least(100, floor(value * 2 - 20))) AS int) AS progress FROM events",
    # filters
    "validate_url": """SELECT page_id, variant, message = '' AS valid, CASE WHEN message = '' THEN '' ELSE 'INVALID_URL' END AS error_code, message AS error_message FROM (
      SELECT page_id, variant, CASE variant WHEN 'long' THEN 'URL exceeds the maximum allowed length of 2048 characters.'
        WHEN 'ftp' THEN 'URL scheme ''ftp'' is not allowed. Only http and https are supported.'
        WHEN 'none' THEN 'URL scheme ''(none)'' is not allowed. Only http and https are supported.'
        WHEN 'blank' THEN 'URL scheme ''(none)'' is not allowed. Only http and https are supported.'
        WHEN 'nohost' THEN 'URL is missing a host.' ELSE '' END AS message FROM (""" + given.URL_VARIANTS + ") v) m",
    "validate_batch": """SELECT page_id, variant, CASE WHEN variant = 'long' THEN concat('URL exceeds maximum length: ', substr(url, 1, 80))
      WHEN variant IN ('ftp', 'none', 'blank') THEN concat('Invalid URL scheme in: ', substr(url, 1, 80)) END AS problem FROM (""" + given.URL_VARIANTS + ") v",
    "ui_url_ok": "SELECT page_id, variant, variant IN ('plain', 'nohost') AS ok, variant IN ('plain', 'upper', 'nohost', 'long') AS safe FROM (" + given.URL_VARIANTS + ") v",
    "select_types": f"{plain('title', 'link')} SELECT page_id, ord, type, value FROM recs",
    "filter_type": f"{_DISPLAY} SELECT page_id, type, value, text FROM shown WHERE type = 'link'",
    "hide_empty": f"{_DISPLAY} SELECT page_id, type, value FROM shown WHERE {_FILLED}",
    "keyword_search": f"{_DISPLAY} SELECT page_id, type, value FROM shown WHERE {_mentions('th')}",
    "keyword_search_documents": "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license') OR contains(lower(lang), 'license')",
    "apply_filters": f"{_DISPLAY} SELECT DISTINCT page_id, type, value, text FROM shown WHERE type = 'link' AND {_FILLED} AND ({_mentions('the')})",
    "filtered_count": f"{_DISPLAY} SELECT count(*) FILTER (WHERE {_FILLED} AND ({_mentions('the')})) AS filtered_count, count(*) AS total_count FROM shown",
    "html_only": f"SELECT page_id, lower(trim(split_part(content_type, ';', 1))) AS mime FROM ({dd(given.RAW_RESPONSES)}) r WHERE lower(trim(split_part(content_type, ';', 1))) IN ({HTML_TYPES})",
    "not_html": """SELECT url, 'CONTENT_TYPE_UNSUPPORTED' AS code, 'Unsupported Content-Type ''application/pdf''. Only application/xhtml+xml, application/xml, text/html, text/xml are accepted.' AS message
      FROM pages WHERE page_id % 6 = 2""",
    "size_cap": "SELECT * FROM (SELECT page_id, CAST(CASE WHEN page_id % 6 = 3 THEN 2 * length(html) ELSE octet_length(encode(html)) END AS int) AS n_bytes FROM pages) b WHERE n_bytes <= 4000",
    "too_large": """SELECT url, 'RESPONSE_TOO_LARGE' AS code, 'Response body exceeds the 4000-byte limit.' AS message
      FROM pages WHERE CASE WHEN page_id % 6 = 3 THEN 2 * length(html) ELSE octet_length(encode(html)) END > 4000""",
    "retryable": f"""SELECT url, attempt % 2 AS attempt, status, transport_error, (transport_error OR status IN (502, 503, 504)) AND attempt % 2 < 1 AS retryable,
      CASE WHEN attempt % 2 = 0 THEN 0.0 ELSE 0.5 END::double AS backoff_seconds FROM ({given.ATTEMPTS}) a""",
    "final_attempt": f"""SELECT url, attempt, status, transport_error FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt DESC) AS k FROM ({given.ATTEMPTS}) a) b WHERE k = 1""",
    "classify_error": f"""SELECT event_id, outcome, code, CAST(http_status AS int) AS http_status, message FROM ({given.OUTCOMES}) o LEFT JOIN (VALUES
      ('server_busy', 'INTERNAL_ERROR', 503, 'Something went wrong on our end. Please try again.'),
      ('anything else', 'INTERNAL_ERROR', 500, 'Something went wrong on our end. Please try again.'),
      ('robots_disallowed', 'ROBOTS_DISALLOWED', 403, 'The target site''s robots.txt disallows scraping this URL.'),
      ('blocked', 'SSRF_BLOCKED', 400, 'That URL points to a private or internal address and cannot be scraped.'),
      ('too_many', 'UPSTREAM_HTTP_ERROR', 400, 'The target site returned an error or too many redirects.'),
      ('content_type', 'CONTENT_TYPE_UNSUPPORTED', 422, 'The URL did not return an HTML page (e.g. it returned a PDF or image).'),
      ('too_large', 'RESPONSE_TOO_LARGE', 413, 'The page is too large to process.'),
      ('parse_timeout', 'PARSE_ERROR', 504, 'The page could not be parsed.'),
      ('timeout', 'TIMEOUT', 504, 'The request timed out. The target site may be slow or unreachable.')) AS t(outcome, code, http_status, message) USING (outcome)""",
    # joins
    "robots_verdict": _ROBOTS_RULES,
    "robots_copies": _ROBOTS_RULES,
    "robots_allowed": f"SELECT page_id, url FROM ({_ROBOTS_RULES}) v WHERE allowed",
    "blocked_hosts": _HOST_VERDICTS,
    "drop_blocked": f"SELECT page_id, url FROM pages WHERE {HOST} NOT IN (SELECT host FROM ({_HOST_VERDICTS}) v WHERE blocked)",
    "redirect_chain": _chains(f"SELECT url, status <> 200 AS hop, location AS target FROM ({given.RESPONSES}) r", given.BLOCKED_SITES),
    "meta_refresh_chain": _chains(f"SELECT concat('https://r.example.com/p/', page_id) AS url, page_id % 6 > 1 AS hop, {_REFRESH_TARGET} AS target FROM pages", "SELECT '' AS host WHERE false"),
    "crawl_batch": _CRAWL_BATCH,
    "crawl_batch_copies": _CRAWL_BATCH,
    "answer_requests": f"""{plain('title', 'heading', 'paragraph', 'link')}, asked AS ({dd(given.TWO_REQUESTS)})
      SELECT request_id, page_id, type, value, text FROM asked JOIN recs ON source_url = asked.url AND list_contains(fields, concat(type, CASE type WHEN 'title' THEN '' ELSE 's' END))""",
    "requested_records": f"""{plain('title', 'paragraph', 'link')} SELECT page_id, type, value FROM recs
      WHERE CASE page_id % 3 WHEN 0 THEN type IN ('title', 'link') WHEN 1 THEN type = 'paragraph' ELSE false END""",
    "job_with_records": f"{_HISTORY} SELECT j.run, j.id AS job_id, j.url, j.status, CAST(j.record_count AS int) AS record_count, r.type, r.value FROM jobs j JOIN job_records r ON r.job_id = j.id AND r.run = j.run",
    "jobs_without_records": f"{_HISTORY} SELECT run, id, url FROM jobs j WHERE NOT EXISTS (SELECT 1 FROM job_records r WHERE r.job_id = j.id AND r.run = j.run)",
    # aggregates
    "dashboard_totals": f"{_HISTORY} SELECT (SELECT count(*) FROM jobs) AS total_jobs, (SELECT count(*) FROM job_records) AS total_records, (SELECT round(avg(duration_ms), 1) FROM jobs) AS avg_duration_ms",
    "records_by_type": f"{rich(*ALL_RANKS)} SELECT type, count(*) AS n FROM recs GROUP BY type",
    "type_share": f"""{rich(*ALL_RANKS)}, counted AS (SELECT type, count(*) AS n FROM recs GROUP BY type)
      SELECT type, n, CAST(floor(100.0::double * n / sum(n) OVER () + 0.5) AS bigint) AS percent, count(*) OVER () AS n_types FROM counted""",
    "distinct_types": f"{rich(*ALL_RANKS)} SELECT DISTINCT type FROM recs",
    "job_counts": f"""{plain('paragraph')} SELECT p.page_id, CAST(count(r.value) AS int) AS record_count, CASE WHEN p.page_id % 10 = 0 THEN 1 ELSE 0 END AS warning_count
      FROM pages p LEFT JOIN recs r ON r.page_id = p.page_id AND p.page_id % 10 <> 0 GROUP BY p.page_id""",
    "distinct_records": f"{plain('title', 'heading', 'link')} SELECT type, count(DISTINCT (page_id, value)) AS n FROM recs GROUP BY type",
    "dedupe_records": f"{plain('heading', 'paragraph', 'link')} SELECT page_id, ord, type, value, text FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1",
    "dedupe_in_page": f"""{plain('heading', 'paragraph', 'link')} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, type, value, text
      FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1""",
    "dedupe_rows": f"{plain('heading', 'paragraph', 'link')} SELECT page_id, min(ord) AS ord, type, value, text FROM recs GROUP BY page_id, type, value, text, level",
    "crawl_records": f"{_CRAWL} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, type, value FROM kept",
    # windows, order, paging
    "assign_ord": f"{plain('heading', 'paragraph', 'link')} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS position, value FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1",
    "page_records": f"""{plain('paragraph', 'link')}, dense AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, value,
      count(*) OVER (PARTITION BY page_id) AS total FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1)
      SELECT page_id, ord, value, CASE WHEN total > 10 THEN to_base64(encode('10')) END AS next_cursor FROM dense WHERE ord BETWEEN 5 AND 9""",
    "recent_jobs": f"{_HISTORY} SELECT run, id, created_s FROM jobs ORDER BY created_s DESC, run DESC, id DESC LIMIT 25",
    "spacing_audit": _SPACING_AUDIT,
    "spacing_audit_large_keys": _SPACING_AUDIT,
    "spacing_schedule": _SPACING_SCHEDULE,
    "spacing_schedule_large_keys": _SPACING_SCHEDULE,
    "cache_hits": _STORES,
    "cache_hits_large_keys": _STORES,
    "cache_hits_repeated": _STORES_REPEATED,
    "cache_hits_repeated_large_keys": _STORES_REPEATED,
    "union_records": f"""{plain('title', 'link')} SELECT page_id, CASE WHEN type = 'title' THEN 0 ELSE row_number() OVER (PARTITION BY page_id, type ORDER BY ord) - 1 END AS ord,
      type, value, text, level FROM recs""",
    # request state
    "rate_audit": _RATES,
    "latest_status": f"""SELECT job_id, stage, greatest(0, least(100, raw_progress)) AS progress, status, status IN ('done', 'error') AS finished
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM ({given.STATUS_EVENTS}) e) l WHERE k = 1""",
    "live_jobs": f"SELECT event_id, job_id FROM ({given.STATUS_EVENTS}) e WHERE status = 'running' OR ts >= TIMESTAMP '2024-01-10 00:00:00'",
    "stream_extract": f"{plain('title', 'link')} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord, type, value FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1",
    "stream_history": f"{plain('title', 'link')} SELECT page_id AS job_id, type, value FROM ({_FIRST_PER_VALUE}) f WHERE copy = 1",
    "stream_rate_audit": f"SELECT * FROM ({_RATES}) r WHERE window_us + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000",
    "stream_cache": _STORES,
    "stream_jobs": f"""WITH e AS (SELECT *, epoch_us(ts) AS us FROM ({given.STATUS_EVENTS}) s), w AS (SELECT max(us) // 1000 - 21600000 AS ms FROM e),
      seen AS (SELECT e.*, lead(us) OVER (PARTITION BY job_id ORDER BY us, event_id) AS then_us FROM e, w WHERE us // 1000 < w.ms)
      SELECT job_id, 'update' AS kind, us, event_id, stage, status FROM seen
      UNION ALL SELECT job_id, 'evicted' AS kind, us, event_id, stage, status FROM seen, w
      WHERE status <> 'running' AND CASE WHEN then_us IS NULL THEN (us + 43200000000) // 1000 < w.ms ELSE then_us > us + 43200000000 END""",
    "stream_cache_late": f"SELECT * FROM ({_STORES}) s WHERE event_id IN (SELECT event_id FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 - 21600000 FROM events))",
    "stream_latest_status": f"""SELECT job_id, stage, status, status IN ('done', 'error') AS finished
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS k FROM ({given.STATUS_EVENTS}) e) l WHERE k = 1""",
}
