"""Whitespace rules and small building blocks for SQL expressions.

The functions in this package take SQL expressions (a column name is one) and come in two
forms: ``name_sql`` returns SQL text, to be used inside other expressions and lambdas, and
``name`` returns the Column. Text keeps plan building to one parse per expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a page extractor strips (Unicode whitespace and the four separators
# U+001C..U+001F), and what a browser's trim() strips.
_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE = _SPACE + "\x1c\x1d\x1e\x1f\x85"
BROWSER_WHITESPACE = _SPACE + "\ufeff"


def literal(text: str) -> str:
    """*text* as an SQL string literal."""
    safe = "".join(
        c if c.isalnum() and c.isascii() or c in " /:.,;|#?&=!<>()[]{}*+-_@%$^~" else f"\\u{ord(c):04x}"
        for c in text
    )
    return f"'{safe}'"


def pattern(regex: str) -> str:
    """*regex* as a raw SQL string literal."""
    assert "'" not in regex
    return f"r'{regex}'"


def bind_sql(value: str, name: str, body: str) -> str:
    """*body* with *name* standing for *value*, which is computed once per row."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip_sql(text: str) -> str:
    return f"btrim({text}, {literal(WHITESPACE)})"


def browser_trim_sql(text: str) -> str:
    return f"btrim({text}, {literal(BROWSER_WHITESPACE)})"


def strip(text: str) -> Column:
    """Both ends stripped of every kind of whitespace (SQL ``trim`` only knows U+0020)."""
    return F.expr(strip_sql(text))


def browser_trim(text: str) -> Column:
    """Both ends stripped of what a browser's ``trim()`` strips."""
    return F.expr(browser_trim_sql(text))
