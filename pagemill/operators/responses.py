"""Crawl responses: which are pages, which failed and why, which to try again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.charset import decode_body, detect_charset, known_charset
from pagemill.functions.tokens import backoff_seconds
from pagemill.schemas import MAX_BODY_BYTES, MAX_RETRIES

# MIME types taken as pages, and statuses worth another attempt.
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xml", "text/xml")
RETRYABLE_STATUSES = (502, 503, 504)

# Outcome -> (code, HTTP status). Anything else is an internal error.
OUTCOMES = {
    "server_busy": ("INTERNAL_ERROR", 503),
    "robots_disallowed": ("ROBOTS_DISALLOWED", 403),
    "blocked": ("SSRF_BLOCKED", 400),
    "too_many": ("UPSTREAM_HTTP_ERROR", 400),
    "content_type": ("CONTENT_TYPE_UNSUPPORTED", 422),
    "too_large": ("RESPONSE_TOO_LARGE", 413),
    "parse_timeout": ("PARSE_ERROR", 504),
    "timeout": ("TIMEOUT", 504),
}

# What a user is told for each code.
MESSAGES = {
    "INVALID_URL": "The URL you entered is not valid. Please enter a full http:// or https:// URL.",
    "SSRF_BLOCKED": "That URL points to a private or internal address and cannot be scraped.",
    "ROBOTS_DISALLOWED": "The target site's robots.txt disallows scraping this URL.",
    "CONTENT_TYPE_UNSUPPORTED": "The URL did not return an HTML page (e.g. it returned a PDF or image).",
    "RESPONSE_TOO_LARGE": "The page is too large to process.",
    "TIMEOUT": "The request timed out. The target site may be slow or unreachable.",
    "UPSTREAM_HTTP_ERROR": "The target site returned an error or too many redirects.",
    "RATE_LIMITED": "You've made too many requests. Please wait a moment and try again.",
    "PARSE_ERROR": "The page could not be parsed.",
    "VALIDATION_ERROR": "The request was invalid.",
    "INTERNAL_ERROR": "Something went wrong on our end. Please try again.",
    "SERVICE_UNAVAILABLE": "The extraction service is unreachable. Please try again shortly.",
}


def mime_type(content_type: str) -> Column:
    """MIME type before any parameter, lower-cased."""
    return F.expr(f"lower(btrim(substring_index(coalesce({content_type}, ''), ';', 1), ' \\t'))")


def html_only(responses: DataFrame) -> DataFrame:
    return responses.filter(mime_type("content_type").isin(*HTML_TYPES))


def not_html(responses: DataFrame) -> DataFrame:
    """The rejected rest, with the message a caller would see."""
    mime = mime_type("content_type")
    accepted = ", ".join(sorted(HTML_TYPES))
    return responses.filter(~mime.isin(*HTML_TYPES)).select(
        "url",
        F.lit("CONTENT_TYPE_UNSUPPORTED").alias("code"),
        F.concat(F.lit("Unsupported Content-Type '"), mime, F.lit(f"'. Only {accepted} are accepted.")).alias("message"),
    )


def size_cap(responses: DataFrame, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """Bodies of at most *limit* bytes, measured on the body whatever its headers say."""
    return responses.filter(F.octet_length("body") <= limit)


def too_large(responses: DataFrame, limit: int = MAX_BODY_BYTES) -> DataFrame:
    return responses.filter(F.octet_length("body") > limit).select(
        "url",
        F.lit("RESPONSE_TOO_LARGE").alias("code"),
        F.lit(f"Response body exceeds the {limit}-byte limit.").alias("message"),
    )


def decode_pages(responses: DataFrame, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """Responses that are pages, decoded: ``url, html, encoding`` (and ``page_id``, ``handle`` and
    ``fetched_at`` if present).
    The others are the rows of :func:`refused_responses`."""
    kept = size_cap(html_only(responses), limit).withColumn("charset", detect_charset("body", "content_type"))
    ids = [c for c in ("page_id", "handle", "fetched_at") if c in responses.columns]
    return kept.select(
        *ids,
        "url",
        decode_body("body", "charset").alias("html"),
        known_charset("charset").alias("encoding"),
    )


def refused_responses(responses: DataFrame, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """``url, code, message`` of each response that :func:`decode_pages` leaves out: of no type
    for a page, or else too large, or without a body."""
    pages = html_only(responses)
    empty = pages.filter("body IS NULL").select(
        "url", F.lit("UPSTREAM_HTTP_ERROR").alias("code"), F.lit(MESSAGES["UPSTREAM_HTTP_ERROR"]).alias("message")
    )
    return not_html(responses).unionByName(too_large(pages, limit)).unionByName(empty)


def classify_error(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """*outcomes* with ``code``, ``http_status`` and ``message``; ``ok`` rows get NULLs.

    The look-up is a literal expression: no table, no join.
    """
    known = F.col(outcome)
    code, status = F.when(known == "ok", F.lit(None)), F.when(known == "ok", F.lit(None))
    for name, (error, http) in OUTCOMES.items():
        code, status = code.when(known == name, error), status.when(known == name, http)
    code, status = code.otherwise("INTERNAL_ERROR"), status.otherwise(500)
    messages = F.create_map(*(F.lit(part) for pair in MESSAGES.items() for part in pair))
    return (
        outcomes.withColumn("code", code.cast("string"))
        .withColumn("http_status", status.cast("int"))
        .withColumn("message", messages[F.col("code")])
    )


def may_retry(attempts: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Attempt log (``url, attempt`` from 0, ``status``, ``transport_error``) with whether each
    attempt is followed by another, and the wait that comes before it."""
    transient = F.col("transport_error") | F.coalesce(F.col("status").isin(*RETRYABLE_STATUSES), F.lit(False))
    return attempts.withColumn("retryable", transient & (F.col("attempt") < max_retries)).withColumn(
        "backoff_seconds", backoff_seconds("attempt")
    )


def final_attempt(attempts: DataFrame) -> DataFrame:
    """Last attempt per URL. Partial maxima, so a URL with a long log is combined per task."""
    return (
        attempts.groupBy("url")
        .agg(F.max(F.struct("attempt", "status", "transport_error")).alias("last"))
        .select("url", "last.*")
    )
