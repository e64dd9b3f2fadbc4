"""Request state over time: cache freshness, rates, job status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.times import as_instant
from pagemill.operators.audit import latest_status, rate_audit
from pagemill.schemas import CACHE_TTL_SECONDS, RATE_LIMIT_PER_MINUTE
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

_MICROS = 1_000_000
_HITS = "key string, us long, id long, hit boolean, stored_us long"


def stream_rate_audit(requests: DataFrame, client: str, ts: str, limit: int = RATE_LIMIT_PER_MINUTE,
                      window: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """``rate_audit`` on a stream (append mode); rows later than the watermark are dropped."""
    timed = requests.withColumn(ts, as_instant(requests, ts)).withWatermark(ts, lateness)
    return rate_audit(timed, client, ts, limit, window)


def stream_latest_status(events: DataFrame, job: str, ts: str, order: str, fields: list[str]) -> DataFrame:
    """``latest_status`` on a stream (update mode)."""
    return latest_status(events, job, ts, order, fields)


def _serve(ttl_us: int, key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's requests of a micro-batch, in time order, against its stored time."""
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(chunks), ignore_index=True).sort_values(["us", "id"], ignore_index=True)
    us = rows["us"].to_numpy()
    hit, stored_us = np.ones(len(us), dtype=bool), np.empty(len(us), dtype=np.int64)
    at, stored = 0, None
    if state.exists:
        (stored,) = state.get
        late = int(np.searchsorted(us, stored))  # older than what is stored: misses that store nothing
        hit[:late], stored_us[:late] = False, us[:late]
        at = int(np.searchsorted(us, stored + ttl_us, "right"))
        stored_us[late:at] = stored
    while at < len(us):
        stored, hit[at] = int(us[at]), False
        following = at + int(np.searchsorted(us[at:], stored + ttl_us, "right"))
        stored_us[at:following] = stored
        at = following
    state.update((stored,))
    expiry_ms = (stored + ttl_us) // 1000 + 1
    state.setTimeoutTimestamp(max(expiry_ms, state.getCurrentWatermarkMs() + 1))
    yield rows.assign(key=key[0], hit=hit, stored_us=stored_us)[["key", "us", "id", "hit", "stored_us"]]


def stream_cache(requests: DataFrame, key: str, ts: str, order: str, ttl_seconds: int = CACHE_TTL_SECONDS,
                 lateness: str = "1 minute") -> DataFrame:
    """``cache_hits`` on a stream: per key the stored time, dropped when the TTL has passed.

    Requests are put in time order within a micro-batch; the state per key is one number. A
    micro-batch holds at most what the source's trigger limit lets in, which bounds a key's
    rows per batch. A request older than its key's stored time comes out as a miss of its own time
    and leaves the stored time alone.
    """
    ttl_us = ttl_seconds * _MICROS

    def serve(keys, chunks, state):
        return _serve(ttl_us, keys, chunks, state)

    timed = requests.withColumn(ts, as_instant(requests, ts))
    slim = timed.withWatermark(ts, lateness).select(
        F.col(key).cast("string").alias("key"),
        F.col(ts),
        F.unix_micros(ts).alias("us"),
        F.col(order).cast("long").alias("id"),
    )
    hits = slim.groupBy("key").applyInPandasWithState(
        serve, _HITS, "stored long", "append", GroupStateTimeout.EventTimeTimeout
    )
    return hits.select(
        F.col("key").cast(dict(requests.dtypes)[key]).alias(key),
        F.timestamp_micros("us").alias(ts),
        F.col("id").alias(order),
        "hit",
        F.timestamp_micros("stored_us").alias("stored_at"),
    )
