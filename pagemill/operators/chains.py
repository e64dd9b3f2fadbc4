"""Redirect and meta-refresh chains over a table of responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.refresh import meta_refresh_target
from pagemill.functions.urls import absolute_redirect, url_host
from pagemill.schemas import MAX_REDIRECTS
from pagemill.session import materialize

# Statuses that redirect.
REDIRECT_STATUSES = (301, 302, 303, 307, 308)

_RESULT = ("start_url", "final_url", "hops", "outcome")


def redirect_edges(responses: DataFrame, *columns: str) -> DataFrame:
    """``url, redirects, target`` from ``url, status, location`` (and other *columns*, and ``fetched_at`` if there);
    NULL target: nowhere to go."""
    redirects = F.coalesce(F.col("status").isin(*REDIRECT_STATUSES), F.lit(False))
    located = F.coalesce(F.col("location"), F.lit("")) != ""
    brought = [*columns, *(c for c in ("fetched_at",) if c in responses.columns)]
    return responses.select(
        "url", redirects.alias("redirects"), F.when(redirects & located, absolute_redirect("location", "url")).alias("target"), *brought
    )


def meta_refresh_edges(pages: DataFrame) -> DataFrame:
    """``url, redirects, target`` from ``url, html``."""
    targets = pages.select("url", meta_refresh_target("html", "url").alias("target"))
    return targets.select("url", F.col("target").isNotNull().alias("redirects"), "target")


def follow_chains(edges: DataFrame, blocked: DataFrame | None = None, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """``start_url, final_url, hops, outcome`` for every URL of *edges*.

    Outcomes: ``ok``, ``too_many`` (more than *max_hops* redirects), ``blocked`` (a hop's host
    is in *blocked*), ``missing`` (no response for a hop). The narrow edges are written out
    once; after that comes one equi join per hop, over the chains that still run: each hop is
    written, and chains that have ended are read from there. Copies of a URL are combined to one
    row first, the newest if *edges* have ``fetched_at``, so a URL that many chains lead to has a
    single row on the right, and the skew join can split its left side.
    """
    newest = ["fetched_at"] if "fetched_at" in edges.columns else []
    known = (
        edges.groupBy("url").agg(F.max(F.struct(*newest, "redirects", "target")).alias("edge")).select("url", "edge.redirects", "edge.target")
    )
    if blocked is not None:
        refused = blocked.select(F.col("host").alias("_host")).distinct().withColumn("refused", F.lit(True))
        # rows without a target get a key of their own, not one NULL they would all share
        target_host = F.coalesce(url_host("target"), F.concat(F.lit("\n"), "url"))
        known = (
            known.withColumn("_host", url_host("url")).join(refused, "_host", "left").withColumnRenamed("refused", "url_refused")
            .withColumn("_host", target_host).join(refused, "_host", "left").withColumnRenamed("refused", "target_refused")
            .drop("_host")
        )
    else:
        none = F.lit(None).cast("boolean")
        known = known.withColumn("url_refused", none).withColumn("target_refused", none)

    # several scans follow; none of them should go back to the responses or pages
    known = materialize(known, "chain-edges")
    moving = F.col("redirects") & F.col("target").isNotNull() & F.col("url_refused").isNull()
    settled = known.filter(~moving).select(
        F.col("url").alias("start_url"),
        F.col("url").alias("final_url"),
        F.when(F.col("redirects") & F.col("url_refused").isNull(), 1).otherwise(0).alias("hops"),
        F.when(F.col("url_refused").isNotNull(), "blocked")
        .when(F.col("redirects") & F.lit(max_hops < 1), "too_many")
        .otherwise("ok")
        .alias("outcome"),
    )
    running = known.filter(moving).select(
        F.col("url").alias("start_url"),
        F.col("target").alias("at"),
        F.lit(1).alias("hops"),
        _arrival(F.lit(1), F.col("target_refused"), max_hops).alias("outcome"),
    )
    step = known.select(
        F.col("url").alias("at"), "redirects", "target", "target_refused", F.lit(True).alias("present")
    )
    done = [settled]
    for _ in range(max_hops):
        # what has ended stays in the table of its hop; only the others are looked up once more
        frontier = materialize(running, "chain-hop")
        done.append(_finished(frontier.filter("outcome IS NOT NULL")))
        hop = F.coalesce(F.col("redirects"), F.lit(False))
        hops = F.col("hops") + F.when(hop, 1).otherwise(0)
        outcome = (
            F.when(F.col("present").isNull(), "missing")
            .when(hop & (hops > max_hops), "too_many")
            .when(~hop | F.col("target").isNull(), "ok")
            .otherwise(_arrival(hops, F.col("target_refused"), max_hops))
        )
        moved = hop & F.col("target").isNotNull() & (hops <= max_hops)
        running = frontier.filter("outcome IS NULL").drop("outcome").join(step, "at", "left").select(
            "start_url",
            F.when(moved, F.col("target")).otherwise(F.col("at")).alias("at"),
            hops.alias("hops"),
            outcome.alias("outcome"),
        )
    done.append(_finished(running))
    return reduce(DataFrame.unionByName, [part.select(*_RESULT) for part in done])


def _finished(chains: DataFrame) -> DataFrame:
    return chains.select("start_url", F.col("at").alias("final_url"), "hops", "outcome")


def _arrival(hops: Column, target_refused: Column, max_hops: int) -> Column:
    """Outcome of having moved to a target: NULL while the chain goes on."""
    return F.when(hops > max_hops, "too_many").when(target_refused.isNotNull(), "blocked")


def redirect_chain(responses: DataFrame, blocked: DataFrame | None = None, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Where each URL ends after HTTP redirects."""
    return follow_chains(redirect_edges(responses), blocked, max_hops)


def meta_refresh_chain(pages: DataFrame, blocked: DataFrame | None = None, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """Where each page ends after meta refreshes."""
    return follow_chains(meta_refresh_edges(pages), blocked, max_hops)
