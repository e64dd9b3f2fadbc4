"""robots.txt verdicts for a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import bind_sql, pattern, strip_sql
from pagemill.functions.urls import url_parts_sql, url_site
from pagemill.operators.prune import BROADCAST_BYTES, by_keys

DEFAULT_AGENT = "pagemill/1.0"


def _unquote_sql(text: str) -> str:
    """Percent escapes decoded; a ``%`` that starts none stays, and so does ``+``."""
    kept = f"regexp_replace(replace({text}, '+', '%2B'), {pattern('%(?![0-9A-Fa-f]{2})')}, '%25')"
    return f"CASE WHEN contains({text}, '%') THEN url_decode({kept}) ELSE {text} END"


def _quote_sql(text: str) -> str:
    """Everything but letters, digits and ``_ . - ~ /`` percent-escaped."""
    encoded = f"replace(replace(replace(replace(url_encode({text}), '+', '%20'), '*', '%2A'), '%7E', '~'), '%2F', '/')"
    return f"CASE WHEN rlike({text}, {pattern(r'\A[A-Za-z0-9_.~/-]*\z')}) THEN {text} ELSE {encoded} END"


def _from_path_sql(parts: str) -> str:
    """path;params?query#fragment of split URL parts, empty ones left out."""
    return (
        f"concat(CASE WHEN startswith({parts}[2], '//') THEN '//' ELSE '' END, {parts}[2], "
        + ", ".join(
            f"CASE WHEN {parts}[{i}] <> '' THEN concat('{mark}', {parts}[{i}]) ELSE '' END"
            for i, mark in ((3, ";"), (4, "?"), (5, "#"))
        )
        + ")"
    )


def robots_path(url: str) -> Column:
    """What rules are compared with: the quoted path and query, ``/`` when empty."""
    path = bind_sql(url_parts_sql(_unquote_sql(url)), "u_parts", _from_path_sql("u_parts"))
    return F.expr(bind_sql(path, "u_path", f"coalesce(nullif({_quote_sql('u_path')}, ''), '/')"))


def _rule_path(text: str) -> Column:
    """A rule's path in the same quoted form."""
    lead = "concat(CASE WHEN u_parts[0] <> '' THEN concat(lower(u_parts[0]), ':') ELSE '' END, CASE WHEN u_parts[1] <> '' THEN concat('//', u_parts[1]) ELSE '' END, "
    path = bind_sql(url_parts_sql(_unquote_sql(text)), "u_parts", lead + _from_path_sql("u_parts") + ")")
    return F.expr(bind_sql(path, "u_path", _quote_sql("u_path")))


def _one_per_site(robots: DataFrame) -> DataFrame:
    """Copies of a site's file combined to one: the newest that could be read (by ``fetched_at``, if
    there is such a column), else the newest; of equally new ones the last by status and body."""
    usable = F.coalesce(F.col("status") < 400, F.lit(False)).alias("usable")
    newest = ["fetched_at"] if "fetched_at" in robots.columns else []
    best = F.max(F.struct(usable, *newest, "status", "body")).alias("file")
    return robots.groupBy("site").agg(best).select("site", "file.status", "file.body")


def robots_rules(robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """Per site the rules that apply to *agent*, in file order: ``site, rules``.

    *robots* has ``site`` (scheme://host), ``status`` and ``body``. A group
    starts at a ``User-agent`` line that follows a rule, a blank line or nothing. The first
    group naming the agent applies, else the first ``*`` group.
    """
    name = agent.split("/")[0].lower()
    lines = _one_per_site(robots).filter("status < 400").select(
        "site", F.posexplode(F.split("body", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "raw")
    )
    text = strip_sql("regexp_replace(raw, '(?s)#.*$', '')")
    word = F.expr(f"lower({strip_sql(f'substring_index({text}, ":", 1)')})")
    rest = F.expr(strip_sql(f"substr({text}, instr({text}, ':') + 1)"))
    is_rule = word.isin("allow", "disallow", "crawl-delay", "request-rate")
    kind = F.when(F.col("raw") == "", "blank").when(
        F.expr(f"contains({text}, ':')"), F.when(word == "user-agent", "agent").when(is_rule, "rule")
    )
    # one file's lines: a window partition is bounded by the size of a robots.txt
    by_site = W.partitionBy("site").orderBy("pos")
    kept = lines.select("site", "pos", kind.alias("kind"), word.alias("word"), rest.alias("rest")).filter("kind IS NOT NULL")
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(by_site), F.lit("blank")) != "agent")
    last_blank = F.max(F.when(F.col("kind") == "blank", F.col("pos"))).over(by_site)
    last_agent = F.max(F.when(F.col("kind") == "agent", F.col("pos"))).over(by_site)
    grouped = (
        kept.withColumn("group_no", F.sum(starts.cast("int")).over(by_site))
        .withColumn("owned", F.coalesce(last_agent > F.coalesce(last_blank, F.lit(-1)), F.lit(False)))
        .filter((F.col("kind") == "agent") | ((F.col("kind") == "rule") & F.col("owned")))
    )
    agents = F.col("kind") == "agent"
    listed = F.expr(_unquote_sql("rest"))
    rule = F.struct(
        "pos",
        (F.col("word") == "allow").alias("allow"),
        _rule_path("rest").alias("path"),
    )
    ruled = F.col("word").isin("allow", "disallow")
    groups = (
        grouped.groupBy("site", "group_no")
        .agg(
            F.bool_or(agents & F.lit(name).contains(F.lower(listed))).alias("named"),
            F.bool_or(agents & (listed == "*")).alias("anyone"),
            F.bool_or(~agents).alias("complete"),
            F.sort_array(F.collect_list(F.when(~agents & ruled, rule))).alias("rules"),
        )
        .filter("complete AND (anyone OR named)")
    )
    chosen = groups.groupBy("site").agg(
        F.min(F.struct(F.col("anyone").alias("fallback"), "group_no", "rules")).alias("g")
    )
    return chosen.select("site", F.col("g.rules").alias("rules"))


def robots_verdict(pages: DataFrame, robots: DataFrame, agent: str = DEFAULT_AGENT) -> DataFrame:
    """``page_id, url, allowed, warning`` for every page.

    A missing or failing robots.txt lets everything pass, with a warning; 404 without one. The
    page side carries only its id and URL. The site side is one row per site, so a site that
    holds a third of the pages is split by the skew join without multiplying anything.
    """
    rules = robots_rules(robots, agent)
    sites = _one_per_site(robots).select("site", "status").join(rules, "site", "left")
    keyed = pages.select("page_id", "url", url_site("url").alias("site"))
    joined = keyed.join(sites, "site", "left").withColumn("path", robots_path("url"))
    # the first rule whose path is a prefix decides; an empty Disallow allows everything
    first = F.expr("get(filter(rules, r -> startswith(path, r.path)), 0)")
    allowed = F.coalesce(first["allow"] | (first["path"] == ""), F.lit(True))
    status = F.col("status")
    warning = (
        F.when(status.isNull(), "robots.txt could not be fetched; proceeding without check.")
        .when(
            (status >= 400) & (status != 404),
            F.concat(F.lit("robots.txt fetch returned HTTP "), status.cast("string"), F.lit("; proceeding without check.")),
        )
        .otherwise("")
    )
    return joined.select("page_id", "url", allowed.alias("allowed"), warning.alias("warning"))


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str = DEFAULT_AGENT, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pages that may be used.

    The verdict reads ids and URLs only, and the wide table stays where it is (``by_keys``).
    """
    refused = robots_verdict(pages, robots, agent).filter(~F.col("allowed")).select("page_id")
    return by_keys(pages, "page_id", refused, False, 16, limit_bytes)
