"""Character sets: which one a body uses, and decoding it.

UTF-8, ISO-8859-1, US-ASCII and windows-1252 are decoded in the JVM; only the others reach
the Arrow UDF, and only their bodies are sent to it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import literal
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

# Fixed value: how a charset is declared.
_CHARSET = "'(?i)charset=[\"\\']?([\\\\w-]+)'"
_HEAD_BYTES = 4096

# Spellings of the character sets the JVM decodes.
_UTF8 = ("utf-8", "utf8")
_LATIN1 = ("iso-8859-1", "iso8859-1", "latin-1", "latin1", "l1")
_ASCII = ("ascii", "us-ascii")
_CP1252 = ("windows-1252", "cp1252", "windows1252")


def _cp1252_table() -> tuple[str, str]:
    """What the bytes 0x80..0x9F stand for in windows-1252, undefined ones as U+FFFD."""
    codes = range(0x80, 0xA0)
    return "".join(map(chr, codes)), "".join(bytes([c]).decode("cp1252", "replace") for c in codes)


def detect_charset(body: str, content_type: str) -> Column:
    """Header, then the first 4 KB of the body, then UTF-8 if valid, else windows-1252."""
    header = f"nullif(regexp_extract(coalesce({content_type}, ''), {_CHARSET}, 1), '')"
    head = f"regexp_replace(decode(substring({body}, 1, {_HEAD_BYTES}), 'ISO-8859-1'), '[^\\\\x00-\\\\x7f]', '')"
    declared = f"nullif(regexp_extract({head}, {_CHARSET}, 1), '')"
    sniffed = f"CASE WHEN is_valid_utf8(cast({body} AS string)) THEN 'utf-8' ELSE 'windows-1252' END"
    return F.expr(f"coalesce({header}, {declared}, {sniffed})")


@F.pandas_udf(T.StringType())
def _decode_other(bodies: pd.Series, charsets: pd.Series) -> pd.Series:
    def one(body, charset):
        if body is None:
            return None
        try:
            text = bytes(body).decode(charset, "replace")
        except (LookupError, UnicodeDecodeError, ValueError):
            text = bytes(body).decode("utf-8", "replace")
        return text.encode("utf-8", "replace").decode("utf-8")

    return pd.Series([one(b, c) for b, c in zip(bodies, charsets)], dtype="object")


def decode_body(body: str, charset: str) -> Column:
    """The body as text, bad bytes replaced; an unknown charset is read as UTF-8."""
    names = {n: kind for kind, group in (("utf8", _UTF8), ("latin1", _LATIN1), ("ascii", _ASCII), ("cp1252", _CP1252)) for n in group}
    listed = ", ".join(f"'{n}'" for n in names)
    source, target = map(literal, _cp1252_table())

    def is_in(group: tuple[str, ...]) -> str:
        return f"lower({charset}) IN ({', '.join(f"'{n}'" for n in group)})"

    latin1 = f"decode({body}, 'ISO-8859-1')"
    in_jvm = (
        f"CASE WHEN {is_in(_UTF8)} THEN make_valid_utf8(cast({body} AS string)) "
        f"WHEN {is_in(_LATIN1)} THEN {latin1} "
        f"WHEN {is_in(_ASCII)} THEN regexp_replace({latin1}, '[\\\\x80-\\\\xff]', '\\ufffd') "
        f"WHEN {is_in(_CP1252)} THEN translate({latin1}, {source}, {target}) END"
    )
    other = F.expr(f"CASE WHEN lower({charset}) NOT IN ({listed}) THEN {body} END")
    return F.coalesce(F.expr(in_jvm), _decode_other(other, F.expr(charset)))


def known_charset(charset: str) -> Column:
    """The charset as reported: itself when a codec exists for it, else ``utf-8``."""
    return _codec_or_utf8(F.expr(charset))


@F.pandas_udf(T.StringType())
def _codec_or_utf8(charsets: pd.Series) -> pd.Series:
    import codecs

    def one(name):
        try:
            codecs.lookup(name)
            return name
        except (LookupError, TypeError):
            return None if name is None else "utf-8"

    return charsets.map({name: one(name) for name in charsets.unique()})
