"""Hosts that must not be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.hosts import is_blocked_ip
from pagemill.functions.urls import url_host
from pagemill.operators.prune import BROADCAST_BYTES, by_keys

_HOST_BYTES = 300  # a host name has at most 253 characters


def host_verdicts(addresses: DataFrame) -> DataFrame:
    """``host, blocked``: blocked when any address is. Ranges are tested by expression, so there
    is no join; a host with millions of addresses is combined before the shuffle."""
    return addresses.groupBy(F.lower("host").alias("host")).agg(
        F.bool_or(is_blocked_ip("ip")).alias("blocked")
    )


def blocked_hosts(addresses: DataFrame) -> DataFrame:
    return host_verdicts(addresses).filter("blocked").select("host")


def drop_blocked(pages: DataFrame, addresses: DataFrame, unresolved_too: bool = True,
                 limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pages whose host is not blocked and, unless *unresolved_too* is off, has an address.

    Pages carry their markup, so they stay where they are (``by_keys``).
    """
    keyed = pages.withColumn("_host", url_host("url"))
    listed = host_verdicts(addresses).filter(~F.col("blocked")).select("host") if unresolved_too else blocked_hosts(addresses)
    return by_keys(keyed, "_host", listed, unresolved_too, _HOST_BYTES, limit_bytes).select(*pages.columns)
