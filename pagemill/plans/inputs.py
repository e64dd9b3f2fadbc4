"""Tables derived from the given ones, in SQL both Spark and the checking engine read.

The crawl has no images, tables, metas, redirects, robots files or addresses, so those are
built around its pages: every derived table grows with the table it is made from.
"""

from __future__ import annotations

SITE = "regexp_extract(url, '^(https?://[^/]+)', 1)"
HOST = "regexp_extract(url, '^https?://([^/]+)', 1)"

# Every page with more markup in front of its own: base, metas, canonical links, headings,
# images and tables, some of them only on some pages.
RICH_HTML = """concat(
  CASE WHEN page_id % 3 = 0 THEN concat('<base href="https://cdn', page_id % 7, '.example.com/d/e/f.html">') ELSE '' END,
  '<meta name="Description" content="  About &lt;', page_id, '&gt; ">',
  CASE WHEN page_id % 2 = 0 THEN '<meta name="keywords">' ELSE '' END,
  '<meta name="keywords" content="k', page_id, ', page">',
  '<meta property="og:title" content="Title ', page_id, '"><meta property="OG:Title" content="again">',
  '<meta property="og:image" content="../img/', page_id, '.png">',
  '<meta property="og:url" content="mailto:x', page_id, '"><meta property="og:none"><meta property="fb:x" content="y">',
  CASE WHEN page_id % 4 <> 0 THEN concat('<link rel="alternate canonical" href="/c/', page_id, '">') ELSE '' END,
  '<link rel="canonical" href="/second">',
  '<h3>Sub ', page_id, '</h3><h2> </h2><h2>Main <i>', page_id, '</i></h2>',
  '<img src="pic/', page_id, '.png" alt=" Photo ', page_id, ' "><img src="javascript:x"><img src="/logo.png">',
  '<table><tr><th>Id</th><th> Len </th></tr><tr><td>', page_id, '</td><td>', length(html), '</td></tr>',
  '<tr><td></td><td> </td></tr><tr><td><b>x</b> y</td><td>&amp;</td></tr></table>',
  '<table><tr><td>only ', page_id, '<table><tr><td>in</td></tr></table></td></tr></table>',
  html)"""
RICH_PAGES = f"SELECT page_id, url, {RICH_HTML} AS html FROM pages"

# Every tenth page starts with a character reference too long to be a number.
BROKEN_PAGES = (
    "SELECT page_id, url, CASE WHEN page_id % 10 = 0 "
    "THEN concat('&#', repeat('9', 5000), ';', html) ELSE html END AS html FROM pages"
)

# Every twentieth page has rows and cells that are never closed, so that each holds all that follow.
COSTLY_PAGES = (
    "SELECT page_id, url, CASE WHEN page_id % 20 = 0 THEN concat('<table>', repeat('<tr><td>1', 2000), html) "
    "WHEN page_id % 20 = 10 THEN concat('<table>', repeat('<tr><td>1', 60000), html) "
    "WHEN page_id % 20 = 5 THEN concat('<table><tr><td>a<tr><td>b</table>', html) ELSE html END AS html FROM pages"
)

# References to resolve, each against every page's URL.
REFERENCES = (
    "SELECT page_id, url, href FROM (SELECT page_id, url, "
    "EXPLODE(LIST('/about', 'img/logo.png', '../up/x', './a/./b/../c?d=1', '#part', '?q=2', '', '//cdn.example.com/y', "
    "'mailto:a@b.c', 'javascript:x', 'HTTPS://Other.example.com/A/../b', ' /trim ', 'ftp://f.example.com/x', '/a;p', 'x#')) AS href "
    "FROM pages) r"
)

# URLs good and bad, made from every page's URL.
URL_VARIANTS = """SELECT page_id, 'plain' AS variant, url FROM pages
  UNION ALL SELECT page_id, 'upper' AS variant, replace(replace(url, 'http://', 'HTTP://'), 'https://', 'HTTPS://') AS url FROM pages
  UNION ALL SELECT page_id, 'ftp' AS variant, replace(replace(url, 'http://', 'ftp://'), 'https://', 'ftp://') AS url FROM pages
  UNION ALL SELECT page_id, 'none' AS variant, replace(replace(url, 'http://', ''), 'https://', '') AS url FROM pages
  UNION ALL SELECT page_id, 'nohost' AS variant, 'https:///path' AS url FROM pages
  UNION ALL SELECT page_id, 'long' AS variant, concat(url, repeat('a', 2048)) AS url FROM pages
  UNION ALL SELECT page_id, 'blank' AS variant, '' AS url FROM pages"""

# Requests: one per event, for a URL of its user, with two or three fields.
REQUESTS = """SELECT event_id, ts, user_id, concat('https://u', user_id, '.example.com/', event_type) AS url,
  CASE WHEN event_id % 2 = 0 THEN LIST('title', event_type, 'links') ELSE LIST('links', 'title', event_type, 'title') END AS fields
  FROM events"""

# Requests for pages: what each asks for depends on the page.
PAGE_REQUESTS = """SELECT url, CASE WHEN page_id % 3 = 0 THEN LIST('title', 'links') WHEN page_id % 3 = 1 THEN LIST('paragraphs') ELSE LIST('images') END AS fields
  FROM pages"""

# The same requests, each with the page that it is for.
REQUESTS_BY_PAGE = PAGE_REQUESTS.replace("SELECT url", "SELECT page_id, url", 1)

# Up to two requests for a page, each with fields of its own; every fourth page is not asked for.
TWO_REQUESTS = """SELECT 2 * page_id AS request_id, url, LIST('title', 'links', 'nothing') AS fields FROM pages WHERE page_id % 4 <> 1
  UNION ALL SELECT 2 * page_id + 1 AS request_id, url, CASE WHEN page_id % 2 = 0 THEN LIST('paragraphs') ELSE LIST('headings', 'title') END AS fields FROM pages WHERE page_id % 4 > 1"""

# Older and newer copies of every response: the older one redirects elsewhere, the newest counts.
CRAWL_COPIES = """SELECT url, status, location, content_type, html, 2 AS fetched_at FROM ({0}) c
  UNION ALL SELECT url, 302 AS status, 'https://gone.example.com/' AS location, NULL AS content_type, '' AS html, 1 AS fetched_at FROM ({0}) c
  UNION ALL SELECT url, 200 AS status, NULL AS location, 'text/html' AS content_type, '<title>old</title>' AS html, NULL AS fetched_at FROM ({0}) c"""

# An attempt log: a user's events of one type are the attempts at one URL.
ATTEMPTS = """SELECT concat('https://u', user_id, '.example.com/', event_type) AS url,
  CAST(event_id AS bigint) AS attempt,
  CASE WHEN event_type = 'error' THEN 503 WHEN event_type = 'view' THEN 404 ELSE 200 END AS status,
  event_id % 11 = 0 AS transport_error FROM events"""

OUTCOMES = """SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'ok' WHEN 1 THEN 'server_busy' WHEN 2 THEN 'robots_disallowed'
  WHEN 3 THEN 'blocked' WHEN 4 THEN 'too_many' WHEN 5 THEN 'content_type' WHEN 6 THEN 'too_large' WHEN 7 THEN 'parse_timeout'
  WHEN 8 THEN 'timeout' ELSE 'anything else' END AS outcome FROM events"""

# Status events of jobs: a user is a job.
STATUS_EVENTS = """SELECT user_id AS job_id, ts, event_id, event_type AS stage, CAST(floor(value * 2 - 20) AS int) AS raw_progress,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status FROM events"""

# One robots.txt per site; what it says, and whether it could be fetched, depends on the site.
ROBOTS = f"""SELECT site, CASE WHEN length(site) % 7 = 6 THEN NULL WHEN length(site) % 6 = 4 THEN 404 WHEN length(site) % 6 = 5 THEN 500 ELSE 200 END AS status,
  CASE length(site) % 6
    WHEN 0 THEN concat('# hello', chr(10), 'User-agent: *', chr(10), 'Allow: /en/', chr(10), 'Disallow: /', chr(10))
    WHEN 1 THEN concat('User-agent: other', chr(10), 'User-agent: PageMill', chr(10), 'Disallow: /fr/', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
    WHEN 2 THEN concat('User-agent: *', chr(10), 'Disallow:', chr(10), 'Disallow: /')
    WHEN 3 THEN concat('User-agent: other', chr(10), chr(10), 'Disallow: /', chr(10), 'User-Agent: *', chr(10), 'Disallow: /en/4', chr(10), 'Disallow: /de/')
    ELSE 'User-agent: *' END AS body
  FROM (SELECT DISTINCT {SITE} AS site FROM pages) s"""

# Several copies of each file that could be read: an older one, and a newer that failed.
ROBOTS_COPIES = f"""SELECT site, status, body, 2 AS fetched_at FROM ({ROBOTS}) r
  UNION ALL SELECT site, 200 AS status, concat('User-agent: *', chr(10), 'Disallow: /') AS body, 1 AS fetched_at FROM ({ROBOTS}) r WHERE status = 200
  UNION ALL SELECT site, 503 AS status, NULL AS body, 3 AS fetched_at FROM ({ROBOTS}) r WHERE status = 200"""

# Two addresses per host, of which the second depends on the page.
ADDRESSES = f"""SELECT {HOST} AS host, concat('93.184.', page_id % 250, '.', length(url) % 250) AS ip FROM pages
  UNION ALL SELECT {HOST} AS host, CASE WHEN page_id % 97 = 0 THEN concat('10.', page_id % 256, '.0.1') WHEN page_id % 89 = 0 THEN concat('172.', page_id % 64, '.0.1')
  WHEN page_id % 83 = 0 THEN 'fe80::1' WHEN page_id % 79 = 0 THEN 'not an address' ELSE concat('2606:2800:220::', page_id % 9999) END AS ip FROM pages"""

# Responses: a page redirects to the next one unless its id says it does not.
RESPONSES = """SELECT page_id, concat('https://r', page_id % 13, '.example.com/p/', page_id) AS url,
  CASE WHEN page_id % 7 = 0 THEN 200 WHEN page_id % 5 = 0 THEN 308 ELSE 302 END AS status,
  CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 31 = 0 THEN '' WHEN page_id % 41 = 0 THEN 'https://gone.example.com/'
    ELSE concat('https://r', (page_id + page_id % 3 + 1) % 13, '.example.com/p/', page_id + page_id % 3 + 1) END AS location
  FROM pages"""
REFRESHING_PAGES = """SELECT page_id, concat('https://r.example.com/p/', page_id) AS url,
  CASE WHEN page_id % 6 = 0 THEN html WHEN page_id % 6 = 1 THEN concat('<meta http-equiv="refresh" content="0; url=#">', html)
    ELSE concat('<META http-equiv=Refresh content="5;URL=', page_id + page_id % 4 + 1, '">', html) END AS html
  FROM pages"""
BLOCKED_SITES = "SELECT concat('r', n, '.example.com') AS host FROM (SELECT DISTINCT page_id % 13 AS n FROM pages) s WHERE n IN (5, 11)"

# Responses with bodies: every seventh page answers, some of them with something else, some refreshing.
CRAWL_RESPONSES = f"""SELECT page_id, url, status, location, CASE WHEN status <> 200 THEN NULL WHEN page_id % 14 = 7 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CASE WHEN status <> 200 THEN '' WHEN page_id % 5 = 0 THEN concat('<meta http-equiv="refresh" content="0; url=', refresh, '">', html) ELSE html END AS html
  FROM (SELECT r.page_id, r.url, r.status, r.location, p.html, concat('https://r', (r.page_id + 28) % 13, '.example.com/p/', r.page_id + 28) AS refresh
    FROM ({RESPONSES}) r JOIN (SELECT page_id, html FROM pages) p ON p.page_id = r.page_id) q"""
CRAWL_COPIES = CRAWL_COPIES.format(CRAWL_RESPONSES)
CRAWL_ROBOTS = """SELECT concat('https://r', n, '.example.com') AS site, CASE WHEN n = 4 THEN 500 ELSE 200 END AS status,
  concat('User-agent: *', chr(10), CASE WHEN n = 3 THEN 'Disallow: /p/' ELSE 'Disallow:' END) AS body
  FROM (SELECT DISTINCT page_id % 13 AS n FROM pages) s"""

# Raw responses: bodies in three encodings under content types that may not say which.
RAW_RESPONSES = """SELECT page_id, url,
  CASE page_id % 6 WHEN 0 THEN 'text/html; charset=UTF-8' WHEN 1 THEN 'Text/HTML' WHEN 2 THEN 'application/pdf'
    WHEN 3 THEN 'application/xhtml+xml; charset=utf-16-be' WHEN 4 THEN 'text/html;charset=no-such-charset' ELSE ' text/xml ;q=1' END AS content_type
  FROM pages"""


def spark_text(query: str) -> str:
    """*query* in Spark's spelling of list functions, tables as ``{name}``."""
    text = query.replace("LIST(", "array(").replace("EXPLODE(", "explode(")
    return text.replace("FROM pages", "FROM {pages}").replace("FROM events", "FROM {events}")


def duckdb_text(query: str) -> str:
    """*query* in DuckDB's spelling."""
    return query.replace("LIST(", "list_value(").replace("EXPLODE(", "unnest(")
