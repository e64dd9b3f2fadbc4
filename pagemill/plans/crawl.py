"""Jobs from a crawl to its answers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.refresh import refresh_reference, resolved_refresh
from pagemill.functions.urls import validate_url
from pagemill.operators.chains import follow_chains, redirect_edges
from pagemill.operators.extract import explode_records, extract_batch, extract_records, page_arrays
from pagemill.operators.prune import by_keys
from pagemill.operators.records import records_by_type
from pagemill.operators.responses import HTML_TYPES, classify_error, decode_pages, mime_type
from pagemill.operators.robots import DEFAULT_AGENT, robots_allowed, robots_verdict
from pagemill.schemas import FIELDS, MAX_BODY_BYTES, MAX_REDIRECTS, TYPES_OF_FIELD
from pagemill.session import checked_broadcast, materialize


def distinct_records_by_type(pages: DataFrame, fields: Iterable[str] = ("title", "headings", "links")) -> DataFrame:
    """How many distinct records of each type a crawl gives. One shuffle, of the counts."""
    return records_by_type(extract_records(pages, fields, dedupe=True))


def crawl_to_records(pages: DataFrame, robots: DataFrame | None = None, fields: Iterable[str] | None = None,
                     agent: str = DEFAULT_AGENT) -> DataFrame:
    """Valid and allowed pages to de-duplicated records; refused pages are never parsed."""
    valid = pages.filter(validate_url("url")["valid"])
    allowed = valid if robots is None else robots_allowed(valid, robots, agent)
    return extract_records(allowed.filter(F.col("html").isNotNull()), fields, dedupe=True)


def with_handles(responses: DataFrame) -> DataFrame:
    """*responses* with ``handle``, the name of a response without its body: as given (by
    ``read_responses(handles=True)``, say), else a hash of the URL and all else."""
    if "handle" in responses.columns:
        return responses
    told = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("url", "status", "content_type", "location")]
    return responses.withColumn("handle", F.sha2(F.concat_ws("\n", *told, F.coalesce(F.sha2("body", 256), F.lit("-"))), 256))


def observed(responses: DataFrame, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """One narrow row per URL, of the copy that counts: ``url, handle, n, state, reference, redirects,
    target``; *n* rows have that handle.

    The newest copy counts, by ``fetched_at`` if there is such a column; of equally new ones one that
    redirects, then one that is a page. ``state`` is ``ok``, ``content_type`` or ``too_large``, NULL without a
    body; ``reference`` is what the page refreshes to. Bodies are only read.
    """
    given = with_handles(responses)
    given = given if "fetched_at" in given.columns else given.withColumn("fetched_at", F.lit(None).cast("long"))
    pages = decode_pages(given, limit).select("url", "handle", F.lit("ok").alias("state"), refresh_reference("html").alias("reference"))
    refused = F.when(~mime_type("content_type").isin(*HTML_TYPES), "content_type").when(F.octet_length("body") > limit, "too_large")
    narrow = given.select("url", "handle", "fetched_at", "status", "location", refused.alias("refused"))
    hops = redirect_edges(narrow, "handle", "refused").select("url", "handle", "fetched_at", F.col("refused").alias("state"), "redirects", "target")
    each = (
        hops.unionByName(pages, allowMissingColumns=True).groupBy("url", "handle")
        .agg(F.max("fetched_at").alias("fetched_at"), F.count("redirects").alias("n"), F.max("state").alias("state"), F.max("reference").alias("reference"),
             F.max("redirects").alias("redirects"), F.max("target").alias("target"))
    )
    rank = F.struct("fetched_at", "redirects", "target", F.col("state") == "ok", F.coalesce(F.col("state") == "content_type", F.lit(False)), "handle")
    best = F.max_by(F.struct("handle", "n", "state", "reference", "redirects", "target"), rank)
    return each.groupBy("url").agg(best.alias("k")).select("url", "k.*")


def fetches(responses: DataFrame, blocked: DataFrame | None = None, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """``url, final_url, outcome, target, handle, n`` for every URL of *responses*: where its redirects end,
    what became of that, where the page found there refreshes to, and which response it is.

    Outcomes are those of the chain, and ``content_type`` or ``too_large`` for what is no page.
    """
    known = materialize(observed(responses, limit), "observed")
    landed = follow_chains(known.select("url", "redirects", "target"), blocked).select(F.col("start_url").alias("url"), "final_url", "outcome")
    ends = known.select(F.col("url").alias("final_url"), "state", "reference", "handle", "n")
    ended = F.when(F.col("outcome") == "ok", F.coalesce("state", F.lit("missing"))).otherwise(F.col("outcome"))
    target = F.when(ended == "ok", resolved_refresh("reference", "url"))
    return landed.join(ends, "final_url", "left").select("url", "final_url", ended.alias("outcome"), target.alias("target"), "handle", "n")


def landing_pages(responses: DataFrame, wanted: DataFrame, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """``handle, html`` of the responses named by *wanted* (``handle, n``), each once. Responses are
    kept or left out where they are; only those that are there several times, if any, are moved."""
    given = with_handles(responses)
    kept = by_keys(given, "handle", wanted.select("handle"), True, 96)
    several = wanted.filter("n > 1").select("handle")
    if not several.isEmpty():
        once = by_keys(kept, "handle", several, True, 96).dropDuplicates(["handle"])
        kept = by_keys(kept, "handle", several, False, 96).unionByName(once)
    return decode_pages(kept, limit).select("handle", "html")


def crawl_batch(requests: DataFrame, responses: DataFrame, fields: Iterable[str] | None = None, robots: DataFrame | None = None,
                blocked: DataFrame | None = None, agent: str = DEFAULT_AGENT, limit: int = MAX_BODY_BYTES,
                max_refreshes: int = MAX_REDIRECTS, with_data: bool = False) -> DataFrame:
    """From requests (``page_id, url``) and the crawl's responses to one batch row per request:
    ``page_id, url, success, record_count, warnings, code, error`` and, if asked, ``data``.

    A request is refused by robots rules, or fetched: redirects are followed, what is no page or
    too large is an error, the page is decoded, its meta refresh is fetched in the same way, and
    the last page is extracted under the requested URL. All decisions are made on narrow rows, of one
    copy per URL; markup stays where it is, and the requests that end at a page come to it, by
    broadcast as long as they are counted small. A URL without a response is ``missing``. The robots
    warning is among the row's warnings.
    """
    fetched = materialize(fetches(responses, blocked, limit), "fetches")
    edges = fetched.select("url", F.col("target").isNotNull().alias("redirects"), "target")
    last = follow_chains(edges, blocked, max_refreshes).select(F.col("start_url").alias("url"), F.col("final_url").alias("last_url"), F.col("outcome").alias("chain"))
    ends = fetched.select(F.col("url").alias("last_url"), "handle", "n", F.col("outcome").alias("end"))
    asked = requests.select("page_id", "url").join(last, "url", "left").join(ends, "last_url", "left")
    outcome = F.when(F.col("chain") == "ok", F.coalesce("end", F.lit("missing"))).otherwise(F.coalesce("chain", F.lit("missing")))
    warnings = F.array().cast("array<string>")
    if robots is not None:
        verdict = robots_verdict(requests, robots, agent).select("page_id", F.col("url").alias("asked_url"), "allowed", "warning").distinct()
        asked = asked.join(verdict, (asked.page_id.eqNullSafe(verdict.page_id)) & (F.col("url") == F.col("asked_url")), "left").drop(verdict.page_id)
        outcome = F.when(F.col("allowed"), outcome).otherwise("robots_disallowed")
        warnings = F.when(F.col("warning") != "", F.array("warning")).otherwise(warnings)
    decided = materialize(asked.select("page_id", "url", "handle", "n", outcome.alias("outcome"), warnings.alias("warnings")), "decided")
    wanted = decided.filter("outcome = 'ok'")
    pages = landing_pages(responses, wanted.select("handle", "n").distinct(), limit)
    coming = checked_broadcast(wanted.select("page_id", "url", "handle", "warnings"), 256, "landing-requests")
    found = extract_batch(pages.join(coming, "handle"), fields, with_data)
    parsed = found.withColumn("code", F.when(~F.col("success"), "PARSE_ERROR"))
    failed = classify_error(decided.filter("outcome <> 'ok'")).select(
        "page_id", "url", F.lit(False).alias("success"), F.lit(0).alias("record_count"), "warnings", "code", F.col("message").alias("error")
    )
    return parsed.unionByName(failed, allowMissingColumns=True)


def answer_requests(requests: DataFrame, pages: DataFrame, dedupe: bool = True) -> DataFrame:
    """The records of each request (``request_id, url, fields``): ``request_id`` and record columns.

    What all requests want of a URL is one bit mask, worked out first. Pages that nobody asked for are left
    out where they are and never parsed; of the others only the wanted elements are collected and the
    wanted extractors run. Requests for one URL are then answered apart, each with its own fields.
    Unknown fields ask for nothing.
    """
    bits = {field: 1 << i for i, field in enumerate(FIELDS)}
    bit = F.create_map(*(F.lit(part) for pair in bits.items() for part in pair))
    mask = F.aggregate("fields", F.lit(0), lambda m, f: m.bitwiseOR(F.coalesce(F.element_at(bit, f), F.lit(0))))
    asked = requests.select("request_id", "url", F.coalesce(mask, F.lit(0)).alias("mask")).filter("mask <> 0 AND url IS NOT NULL")
    masks = materialize(asked.groupBy("url").agg(F.bit_or("mask").alias("wanted")), "wanted")
    kept = by_keys(pages, "url", masks.select("url"), True, 256)
    told = kept.join(checked_broadcast(masks, 256, "masks"), "url")
    records = explode_records(page_arrays(told, dedupe=dedupe))
    of_type = F.create_map(*(F.lit(part) for field, kinds in TYPES_OF_FIELD.items() for kind in kinds for part in (kind, bits[field])))
    answers = records.join(asked.withColumnRenamed("url", "source_url"), "source_url")
    return answers.filter(F.element_at(of_type, F.col("type")).bitwiseAND(F.col("mask")) != 0).select("request_id", *records.columns)
