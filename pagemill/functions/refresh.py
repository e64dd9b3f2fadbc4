"""Meta-refresh targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind_sql
from pagemill.functions.urls import join_url_sql

_HEAD_CHARS = 8192

# Fixed value: the form of a refresh tag that is recognised.
_REFRESH = (
    "(?i)<meta[^>]+http-equiv=[\"']?refresh[\"']?[^>]+"
    "content=[\"']\\s*\\d+\\s*;\\s*url=['\"\\s]?([^'\">\\s]+)"
)


def _reference_sql(html: str) -> str:
    regex = "'" + _REFRESH.replace("\\", "\\\\").replace("'", "\\'") + "'"
    target = f"btrim(regexp_extract(f_head, {regex}, 1), '\\'\"')"
    found = bind_sql(target, "f_target", "CASE WHEN f_target <> '' AND f_target <> '#' THEN f_target END")
    return bind_sql(
        f"substring({html}, 1, {_HEAD_CHARS})", "f_head", f"CASE WHEN contains(lower(f_head), 'http-equiv=') THEN {found} END"
    )


def refresh_reference(html: str) -> Column:
    """What the first refresh tag in the first 8192 characters refers to, as written, else NULL.

    The cheap ``contains`` test keeps the pattern away from the pages that have no such tag.
    """
    return F.expr(_reference_sql(html))


def resolved_refresh(reference: str, url: str) -> Column:
    """:func:`refresh_reference` on the page's URL."""
    return F.expr(f"CASE WHEN {reference} IS NOT NULL THEN {join_url_sql(url, reference)} END")


def meta_refresh_target(html: str, url: str) -> Column:
    """Absolute target of the first refresh tag in the first 8192 characters, else NULL."""
    target = f"CASE WHEN f_reference IS NOT NULL THEN {join_url_sql(url, 'f_reference')} END"
    return F.expr(bind_sql(_reference_sql(html), "f_reference", target))
