"""Audits of a request log: spacing per domain, rate per client, cache hits, latest status.

Ordered work per key is one window for most keys. Keys with more than ``hot_rows`` rows,
counted beforehand, are cut into time buckets, so one key with a third of all rows spreads
over as many tasks as it has buckets; what crosses a bucket border is carried over from one
summary row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.times import epoch_micros, from_micros
from pagemill.schemas import CACHE_TTL_SECONDS, DOMAIN_SPACING_MS, JOB_TTL_SECONDS, RATE_LIMIT_PER_MINUTE
from pagemill.session import checked_broadcast, materialize
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

_MICROS = 1_000_000
HOT_ROWS = 5_000_000  # what one task sorts with ease


def _bucket(micros: str, width: int) -> Column:
    """Index of the time bucket. The remainder goes first: what is left divides exactly, where a
    plain division could round a time just before a border over it."""
    time = F.col(micros)
    return ((time - F.pmod(time, F.lit(width).cast("long"))) / width).cast("long")


def _split_hot(rows: DataFrame, key: str, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and, if there are any, rows of keys with more than *hot_rows*.

    Runs a count per key. The list of large keys is at most the row count over *hot_rows* long;
    it is broadcast when counted small. Keys are structs of the key column, so that a NULL key is a
    key like any other in counts, windows and joins.
    """
    counted = rows.groupBy(key).count().filter(F.col("count") > hot_rows).select(key)
    hot = checked_broadcast(counted, 256, "hot-keys")
    if hot.isEmpty():
        return rows, None
    usual, large = rows.join(hot, key, "left_anti"), rows.join(hot, key, "left_semi")
    return usual.select(*rows.columns), large.select(*rows.columns)


def _gaps(rows: DataFrame, key: str, order: str) -> DataFrame:
    previous = F.lag("_us").over(W.partitionBy(key).orderBy("_us", order))
    return rows.withColumn("_previous", previous)


def _gaps_in_buckets(rows: DataFrame, key: str, order: str, width: int) -> DataFrame:
    rows = rows.withColumn("_bucket", _bucket("_us", width))
    last = rows.groupBy(key, "_bucket").agg(F.max("_us").alias("_last"))
    by_key = W.partitionBy(key).orderBy("_bucket")
    carried = last.select(key, "_bucket", F.lag("_last").over(by_key).alias("_carried"))
    in_bucket = W.partitionBy(key, "_bucket").orderBy("_us", order)
    previous = F.coalesce(F.lag("_us").over(in_bucket), F.col("_carried"))
    return rows.join(carried, [key, "_bucket"]).withColumn("_previous", previous).drop("_bucket", "_carried")


def spacing_audit(requests: DataFrame, key: str, ts: str, order: str, min_gap_ms: int = DOMAIN_SPACING_MS,
                  bucket_seconds: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Requests closer than *min_gap_ms* to the previous one of the same key, with the gap."""
    timed = requests.withColumns({"_us": epoch_micros(requests, ts), "_key": F.struct(key)})
    usual, large = _split_hot(timed, "_key", hot_rows)
    spaced = _gaps(usual, "_key", order)
    if large is not None:
        spaced = spaced.unionByName(_gaps_in_buckets(large, "_key", order, bucket_seconds * _MICROS))
    gaps = spaced.withColumn("gap_ms", (F.col("_us") - F.col("_previous")) / 1000.0)
    return gaps.filter(F.col("gap_ms") < min_gap_ms).drop("_us", "_previous", "_key")


def _slots(rows: DataFrame, key: str, order: str, gap: int) -> DataFrame:
    in_order = W.partitionBy(key).orderBy("_us", order)
    rows = rows.withColumn("_pos", F.row_number().over(in_order).cast("long"))
    lead = F.max(F.col("_us") - F.col("_pos") * gap).over(in_order)
    return rows.withColumn("_slot", lead + F.col("_pos") * gap).drop("_pos")


def _slots_in_buckets(rows: DataFrame, key: str, order: str, gap: int, width: int) -> DataFrame:
    rows = rows.withColumn("_bucket", _bucket("_us", width))
    in_bucket = W.partitionBy(key, "_bucket").orderBy("_us", order)
    rows = rows.withColumn("_pos", F.row_number().over(in_bucket).cast("long"))
    rows = rows.withColumn("_lead", F.max(F.col("_us") - F.col("_pos") * gap).over(in_bucket))
    per_bucket = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n"), F.max("_lead").alias("_most"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        per_bucket.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .withColumn("_most", F.col("_most") - F.col("_before") * gap)
        .select(key, "_bucket", "_before", F.max("_most").over(before).alias("_carried"))
    )
    lead = F.greatest(F.col("_carried"), F.col("_lead") - F.col("_before") * gap)
    slot = lead + (F.col("_before") + F.col("_pos")) * gap
    return rows.join(carried, [key, "_bucket"]).withColumn("_slot", slot).drop(
        "_bucket", "_pos", "_lead", "_before", "_carried"
    )


def spacing_schedule(requests: DataFrame, key: str, ts: str, order: str, gap_ms: int = DOMAIN_SPACING_MS,
                     bucket_seconds: int = 3600, hot_rows: int = HOT_ROWS) -> DataFrame:
    """When each request may go out: ``slot = max(arrival, previous slot + gap)``, as ``slot_ts``.

    Unrolled, a slot is the greatest ``arrival_j + (i - j) * gap`` over ``j <= i``: a running
    maximum of ``arrival - position * gap`` plus the own position. Both split over buckets.
    """
    gap = gap_ms * 1000
    timed = requests.withColumns({"_us": epoch_micros(requests, ts), "_key": F.struct(key)})
    usual, large = _split_hot(timed, "_key", hot_rows)
    slots = _slots(usual, "_key", order, gap)
    if large is not None:
        slots = slots.unionByName(_slots_in_buckets(large, "_key", order, gap, bucket_seconds * _MICROS))
    return slots.withColumn("slot_ts", from_micros(requests, ts, F.col("_slot"))).drop("_us", "_slot", "_key")


def rate_audit(requests: DataFrame, client: str, ts: str, limit: int = RATE_LIMIT_PER_MINUTE,
               window: str = "1 minute") -> DataFrame:
    """Clients over *limit* requests in a tumbling window. Works on a watermarked stream too."""
    return (
        requests.groupBy(client, F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > limit)
        .select(client, F.col("w.start").alias("window_start"), "n")
    )


def latest_status(events: DataFrame, job: str, ts: str, order: str, fields: list[str]) -> DataFrame:
    """Newest *fields* per job and whether it is finished. Works on a stream in update mode."""
    newest = F.max_by(F.struct(*fields), F.struct(ts, order))
    finished = F.col("s")["status"].isin("done", "error") if "status" in fields else F.lit(None).cast("boolean")
    return events.groupBy(job).agg(newest.alias("s")).select(job, "s.*", finished.alias("finished"))


def live_jobs(jobs: DataFrame, now: str, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs not finished, or finished at most *ttl_seconds* before *now* (an SQL expression)."""
    age = F.unix_micros(F.expr(now)) - epoch_micros(jobs, "finished_at")
    return jobs.filter(F.col("finished_at").isNull() | (age <= ttl_seconds * _MICROS))


# -- cache hits ------------------------------------------------------------------------

_HITS = "key string, us long, id long, hit boolean, stored_us long"


def _fold_batches(ttl_us: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Greedy pass over rows sorted by (key, us, id); only the last store is carried along."""
    last_key, stored = object(), 0  # no key yet; a key may be NULL
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).dictionary_encode(null_encoding="encode")
        codes = keys.indices.to_numpy()
        us = batch.column(1).to_numpy()
        same_key = codes[1:] == codes[:-1]
        # a key's first request, or one longer than the TTL after the one before, must store
        must_store = np.r_[True, ~same_key | (us[1:] - us[:-1] > ttl_us)]
        stored_us, hit = us.copy(), ~must_store
        if keys.dictionary[int(codes[0])].as_py() == last_key:
            first_key = int(np.argmin(same_key)) + 1 if not same_key.all() else len(us)
            served = int(np.searchsorted(us[:first_key], stored + ttl_us, "right"))
            stored_us[:served], hit[:served], must_store[:served] = stored, True, False
            if served < first_key:
                must_store[served] = True
        starts = np.flatnonzero(must_store)
        ends = np.r_[starts[1:], len(us)]
        several = ends - starts > 1
        hit[starts] = False
        for at, end in zip(starts[several].tolist(), ends[several].tolist()):
            while at < end:
                following = at + int(np.searchsorted(us[at:end], us[at] + ttl_us, "right"))
                hit[at], hit[at + 1 : following], stored_us[at:following] = False, True, us[at]
                at = following
        last_key, stored = keys.dictionary[int(codes[-1])].as_py(), int(stored_us[-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(hit), pa.array(stored_us)],
            names=["key", "us", "id", "hit", "stored_us"],
        )


def _fold(rows: DataFrame, ttl_us: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fold_batches(ttl_us, batches)

    return rows.repartition("key").sortWithinPartitions("key", "us", "id").mapInArrow(run, _HITS)


def _stores(rows: DataFrame, ttl_us: int) -> DataFrame:
    """Times at which a store happens, for keys too large for one task: ``key, us, bucket``.

    A bucket as wide as the TTL holds at most one store. For a block of buckets it is enough
    to know, for every event that could be the block's first store (those in its first bucket
    and the one after), where the chain of stores leaves the block. Two neighbouring blocks
    combine by looking up the right block's first store after each exit of the left one; each
    round halves the rows. Going back down, a block's known first store yields its right
    half's. Every step works per (key, block), however many rows the key has.
    """
    times = materialize(rows.select("key", "us").distinct().withColumn("bucket", _bucket("us", ttl_us)), "cache-times")
    low, high = times.agg(F.min("bucket"), F.max("bucket")).first()
    levels = ceil(log2(high - low + 1)) if high > low else 0

    block = times.select("key", F.col("us").alias("entry"), F.col("us").alias("exit"), (F.col("bucket") - low).alias("block"))
    halves = []
    for level in range(levels):
        is_left = (F.col("block") % 2) == 0
        first_bucket = F.shiftleft("block", level) + low
        sides = block.select(
            "key", "entry", "exit", F.shiftright("block", 1).alias("parent"), is_left.alias("left"),
            F.when(is_left, F.col("exit") + ttl_us).otherwise(F.col("entry")).alias("at"),
            (_bucket("entry", ttl_us) > first_bucket).alias("beyond"),
        )
        family = W.partitionBy("key", "parent")
        # latest first, so the nearest right-hand entry strictly after the exit comes last
        later = family.orderBy(F.desc("at"), F.desc("left")).rowsBetween(W.unboundedPreceding, 0)
        combined = sides.select(
            "key", "parent", "entry", "exit", "left",
            F.last(F.when(~F.col("left"), F.struct("entry", "exit")), ignorenulls=True).over(later).alias("next"),
            F.min(F.when(~F.col("left"), F.col("entry"))).over(family).alias("first_right"),
            F.bool_or(F.col("left") & F.col("beyond")).over(family).alias("covered"),
        )
        combined = materialize(combined, "cache-level")
        halves.append(combined.filter("left AND next IS NOT NULL").select("key", "entry", F.col("next.entry").alias("then")))
        block = combined.filter("left OR (entry = first_right AND NOT covered)").select(
            "key", "entry",
            F.when(F.col("left"), F.coalesce(F.col("next.exit"), F.col("exit"))).otherwise(F.col("exit")).alias("exit"),
            F.col("parent").alias("block"),
        )

    found = times.groupBy("key").agg(F.min("us").alias("entry"))
    for half in reversed(halves):
        found = materialize(found, "cache-stores")
        found = found.unionByName(found.join(half, ["key", "entry"]).select("key", F.col("then").alias("entry")))
    return found.withColumnRenamed("entry", "us").join(times, ["key", "us"]).select("key", "us", "bucket")


def _stamp(rows: DataFrame, stores: DataFrame, ttl_us: int) -> DataFrame:
    """Each row with the store it is served by: that of its own bucket or the one before. Of the
    rows of the store's time the first by id (NULL before all) is the miss."""
    own = stores.select("key", "bucket", F.col("us").alias("own_us"))
    earlier = stores.select("key", (F.col("bucket") + 1).alias("bucket"), F.col("us").alias("earlier_us"))
    joined = (
        rows.withColumn("bucket", _bucket("us", ttl_us))
        .join(own, ["key", "bucket"], "left")
        .join(earlier, ["key", "bucket"], "left")
    )
    served_here = F.coalesce(F.col("us") >= F.col("own_us"), F.lit(False))
    stores_now = served_here & (F.col("us") == F.col("own_us"))
    # ties of one time share a window; other rows get one of their own time, which is as small
    first = F.row_number().over(W.partitionBy("key", "us").orderBy("id")) == 1
    return joined.select(
        "key", "us", "id",
        (~(stores_now & first)).alias("hit"),
        F.when(served_here, F.col("own_us")).otherwise(F.col("earlier_us")).alias("stored_us"),
    )


def cache_hits(requests: DataFrame, key: str, ts: str, order: str, ttl_seconds: int = CACHE_TTL_SECONDS,
               hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key, ts, <order>, hit, stored_at``: a request hits when the stored entry of its key is at
    most *ttl_seconds* old; a miss stores anew, a hit does not refresh.

    Keys up to *hot_rows* requests are folded in one sorted pass per partition. Larger keys,
    found by a count beforehand, are worked out in blocks of time (``_stores``).
    """
    ttl_us = ttl_seconds * _MICROS
    rows = requests.select(
        F.struct(F.col(key).cast("string").alias("name")).alias("key"),
        epoch_micros(requests, ts).alias("us"),
        F.col(order).cast("long").alias("id"),
    )
    usual, large = _split_hot(rows, "key", hot_rows)
    hits = _fold(usual.withColumn("key", F.col("key.name")), ttl_us)
    if large is not None:
        served = _stamp(large, _stores(large, ttl_us), ttl_us)
        hits = hits.unionByName(served.withColumn("key", F.col("key.name")))
    return hits.select(
        F.col("key").cast(dict(requests.dtypes)[key]).alias(key),
        from_micros(requests, ts, F.col("us")).alias(ts),
        F.col("id").alias(order),
        "hit",
        from_micros(requests, ts, F.col("stored_us")).alias("stored_at"),
    )
