"""Schemas and fixed values shared by the operators."""

from __future__ import annotations

# The field names a request may ask for, in emission order.
FIELDS = (
    "title",
    "meta",
    "headings",
    "paragraphs",
    "links",
    "images",
    "tables",
    "open_graph",
    "canonical_url",
)

# The record types each field yields.
TYPES_OF_FIELD = {
    "title": ("title",),
    "meta": ("meta_description", "meta_keywords"),
    "headings": ("heading",),
    "paragraphs": ("paragraph",),
    "links": ("link",),
    "images": ("image",),
    "tables": ("table_row",),
    "open_graph": ("open_graph",),
    "canonical_url": ("canonical_url",),
}

# Limits.
MAX_URL_LENGTH = 2048
MAX_BODY_BYTES = 10 * 1024 * 1024
MAX_PAGE_TEXT = 64 * 1024 * 1024
MAX_RESULT_ROWS = 2000
MAX_HISTORY_ROWS = 200
MAX_REDIRECTS = 3
MAX_RETRIES = 1
RATE_LIMIT_PER_MINUTE = 20
DOMAIN_SPACING_MS = 500
CACHE_TTL_SECONDS = 300
JOB_TTL_SECONDS = 300

# One row per page: the page's visible text once, and its elements as ranges over it.
LEAF_SCHEMA = (
    "page_id long, url string, body binary, "
    "nodes array<struct<tag: string, last: int, t0: int, t1: int, attrs: map<string, string>>>, "
    "error string, warnings array<string>, wanted int"
)

# What extractors written in Python add to such a row: their records, and why others of them failed.
MADE_SCHEMA = (
    "made array<struct<field: string, type: string, value: string, text: string, level: string, "
    "table_index: int, row_index: int, table_headers: string>>, failed array<struct<field: string, message: string>>"
)

# One row per element of interest.
NODE_SCHEMA = (
    "page_id long, url string, node_id int, end_id int, tag string, "
    "attrs map<string, string>, text string"
)

RECORD_SCHEMA = (
    "page_id long, ord long, type string, value string, text string, level string, "
    "table_index int, row_index int, table_headers string, source_url string"
)
RECORD_COLUMNS = tuple(part.split()[0] for part in RECORD_SCHEMA.split(", "))
EXPORT_COLUMNS = RECORD_COLUMNS[2:]
EXTRA_COLUMNS = ("text", "level", "table_index", "row_index", "table_headers")

JOB_SCHEMA = (
    "id long, url string, fields string, status string, record_count int, warning_count int, "
    "duration_ms double, created_at timestamp, used_js boolean"
)
JOB_RECORD_SCHEMA = (
    "job_id long, ord long, type string, value string, extra string, source_url string"
)
EXTRA_SCHEMA = (
    "text string, level string, table_index int, row_index int, table_headers string"
)
