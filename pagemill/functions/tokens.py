"""Cache keys, cursors, field lists and small numeric rules. Arguments are SQL expressions."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import bind_sql, pattern


def cache_key(url: str, fields: str) -> Column:
    """SHA-256 of the URL and the sorted field list, so field order does not matter."""
    return F.expr(f"sha2(concat({url}, '|', array_join(array_sort({fields}), ',')), 256)")


def make_cursor_sql(offset: str) -> str:
    return f"base64(cast(cast({offset} AS string) AS binary))"


def make_cursor(offset: str) -> Column:
    """A row offset as an opaque token."""
    return F.expr(make_cursor_sql(offset))


def parse_cursor(cursor: str) -> Column:
    """The offset inside a token; 0 for NULL or anything that is not a token."""
    letters = f"regexp_replace({cursor}, {pattern('[^A-Za-z0-9+/=]')}, '')"
    digits = "cast(try_to_binary(c_letters, 'base64') AS string)"
    number = pattern(r"\A\s*([+-]?[0-9]+(?:_[0-9]+)*)\s*\z")
    whole = f"try_cast(replace(regexp_extract(c_digits, {number}, 1), '_', '') AS bigint)"
    return F.expr(f"coalesce({bind_sql(letters, 'c_letters', bind_sql(digits, 'c_digits', whole))}, 0)")


def cursor_offset(cursor: str | None) -> int:
    """``parse_cursor`` for a plan parameter."""
    try:
        return int(base64.b64decode((cursor or "").encode()).decode())
    except ValueError:
        return 0


def join_fields(fields: str) -> Column:
    """The comma-joined form fields are stored in."""
    return F.expr(f"array_join({fields}, ',')")


def split_fields(fields: str) -> Column:
    return F.expr(f"split({fields}, ',')")


def distinct_fields(fields: str) -> Column:
    """Requested fields without repeats, first mention first."""
    return F.expr(f"array_distinct({fields})")


def backoff_seconds(attempt: str) -> Column:
    """Wait before an attempt: none before the first, then 0.5 s doubling."""
    return F.expr(f"CASE WHEN {attempt} > 0 THEN 0.5D * pow(2, {attempt} - 1) ELSE 0.0D END")


def clamp_progress(percent: str) -> Column:
    return F.expr(f"greatest(0, least(100, {percent}))")
