"""Per-key state over arriving rows, in event-time order: job store and cache.

Rows wait in state until the watermark has passed them, so what comes out does not depend on how
they were cut into micro-batches or on rows that come late (but before the watermark). State is kept
by ``transformWithStateInPandas`` in the RocksDB store; timers of event time wake it when the next
row is due or an entry expires, and nothing is kept of a key after that.

Every call of the state store costs far more than a row, so keys are dealt to buckets: a bucket's
waiting rows and the entries of its keys are kept as Arrow blobs, and all its keys are served at once
by array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pagemill.functions.times import as_instant
from pagemill.schemas import CACHE_TTL_SECONDS, JOB_TTL_SECONDS
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

_MICROS = 1_000_000
#: Buckets that keys are dealt to. A stream keeps its number: it is in the checkpoint.
BUCKETS = 512
#: Rows of a micro-batch that enter a bucket's state as one blob.
BLOB_ROWS = 1 << 16
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blobs: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(b).read_all() for b in blobs)]).combine_chunks()


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def _in_turn(rows: pa.Table, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by key, entries before fresh rows, these by (time, id), NULL ids first; and each
    row's key as a number, in that order."""
    key = pd.factorize(rows["key"].to_pandas(), use_na_sentinel=False)[0]
    order = np.lexsort((_ints(rows, "id"), _ints(rows, "named"), _ints(rows, "us"), fresh, key))
    return order, key[order]


class InOrder(StatefulProcessor):
    """Holds a bucket's rows back until the watermark has passed, then hands them to :meth:`serve` together
    with the entries of its keys. Rows of a micro-batch enter the state chunk by chunk.

    Rows and entries have the columns of :attr:`ROWS`; ``named`` is 0 where an id is NULL."""

    ROWS: pa.Schema

    def __init__(self, ttl_us: int):
        self.ttl_us = ttl_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.entries = handle.getValueState("entries", "rows binary")
        self.served: set[tuple] = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held, count = None, [], 0

        def keep() -> None:
            made = pa.Table.from_pandas(pd.concat(held)[self.ROWS.names], schema=self.ROWS, preserve_index=False)
            self.waiting.appendValue((_blob(made.replace_schema_metadata()),))
            held.clear()

        for chunk in rows:
            least = int(chunk["us"].min())
            first = least if first is None else min(first, least)
            held.append(chunk)
            count += len(chunk)
            if count >= BLOB_ROWS:
                keep()
                count = 0
        if held:
            keep()
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if (key[0], now) in self.served:  # several of a bucket's timers may expire together
            return
        self.served.add((key[0], now))
        waiting = _table([bytes(r[0]) for r in self.waiting.get()], self.ROWS)
        entries = _table([bytes(self.entries.get()[0])] if self.entries.exists() else [], self.ROWS)
        due = _ints(waiting, "us") // 1000 < now
        later = waiting.filter(pa.array(~due))
        rows = pa.concat_tables([entries, waiting.filter(pa.array(due))]).combine_chunks()
        made, kept = self.serve(rows, np.arange(len(rows)) >= len(entries), now)
        if due.any():
            self.waiting.clear()
            if len(later):
                self.waiting.put([(_blob(later),)])
        if len(kept):
            self.entries.update((_blob(kept),))
        else:
            self.entries.clear()
        times = [*_ints(later, "us").tolist(), *self.expiries(kept).tolist()]
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1)
        if len(made):
            yield made

    def serve(self, rows: pa.Table, fresh: np.ndarray, now: int) -> tuple[pd.DataFrame, pa.Table]:
        """What comes out, and the entries after the fresh rows of *rows*, where the others are the entries
        before. *now*: the watermark in milliseconds; entries that expired before it are left out."""
        raise NotImplementedError

    def expiries(self, entries: pa.Table) -> np.ndarray:
        """When (microseconds) those of the entries expire that do."""
        raise NotImplementedError

    def close(self) -> None:
        pass


def _ids(rows: pa.Table) -> pd.Series:
    return pd.Series(pd.arrays.IntegerArray(_ints(rows, "id").copy(), _ints(rows, "named") == 0))


class JobStore(InOrder):
    ROWS = pa.schema([("key", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("named", pa.int32()), ("stage", pa.string()), ("status", pa.string())])

    def _finished(self, rows: pa.Table) -> np.ndarray:
        return rows["status"].to_pandas().isin(("done", "error")).to_numpy(bool)

    def expiries(self, entries):
        return _ints(entries, "us")[self._finished(entries)] + self.ttl_us

    def serve(self, rows, fresh, now):
        order, key = _in_turn(rows, fresh)
        us, over = _ints(rows, "us")[order], self._finished(rows)[order]
        followed = np.append(key[1:] == key[:-1], False)[: len(key)]
        then = np.append(us[1:], 0)[: len(us)]
        gone = over & np.where(followed, then > us + self.ttl_us, (us + self.ttl_us) // 1000 < now)
        at = np.arange(len(order))
        place = np.concatenate((2 * at[fresh[order]], 2 * at[gone] + 1))
        out = rows.take(pa.array(order[np.sort(place) // 2]))
        kinds = np.where(np.sort(place) % 2, "evicted", "update")
        made = pd.DataFrame({"key": out["key"].to_pandas(), "kind": kinds.astype(object), "us": _ints(out, "us"), "id": _ids(out),
                             "stage": out["stage"].to_pandas(), "status": out["status"].to_pandas()})
        return made, rows.take(pa.array(order[~followed & ~gone]))


class CacheStore(InOrder):
    ROWS = pa.schema([("key", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("named", pa.int32())])

    def expiries(self, entries):
        return _ints(entries, "us") + self.ttl_us

    def serve(self, rows, fresh, now):
        order, key = _in_turn(rows, fresh)
        us, n = _ints(rows, "us")[order], len(order)
        # A request is a miss if the time that its key stored last is over: from each row that stores the next
        # one that does is found among all, ranked by (key, time); every step serves all keys.
        times = np.unique(us)
        ranks = len(times) + 1
        own = np.maximum.accumulate(key * ranks + np.searchsorted(times, us)) if n else us
        then = np.searchsorted(own, key * ranks + np.searchsorted(times, us + self.ttl_us, "right"))
        stores = np.zeros(n, bool)
        at = np.flatnonzero(np.diff(key, prepend=-1))
        while len(at):
            stores[at] = True
            after = then[at]
            inside = after < n
            inside[inside] = key[after[inside]] == key[at[inside]]
            at = after[inside]
        stored = us[np.maximum.accumulate(np.where(stores, np.arange(n), 0))] if n else us
        new = fresh[order]
        out = rows.take(pa.array(order[new]))
        made = pd.DataFrame({"key": out["key"].to_pandas(), "us": _ints(out, "us"), "id": _ids(out), "hit": ~stores[new], "stored_us": stored[new]})
        last = np.append(key[1:] != key[:-1], True)[:n]
        kept = order[last & ((stored + self.ttl_us) // 1000 >= now)]
        left = rows.take(pa.array(kept))
        return made, left.set_column(1, "us", pa.array(stored[last & ((stored + self.ttl_us) // 1000 >= now)], pa.int64()))


def _in_order(rows: DataFrame, store: InOrder, schema: str) -> DataFrame:
    spark = rows.sparkSession
    if spark.conf.get(_PROVIDER, None) != ROCKS_DB:
        spark.conf.set(_PROVIDER, ROCKS_DB)  # the only store that this kind of state runs on
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"), "*").filter("us IS NOT NULL")
    named = dealt.withColumns({"named": F.col("id").isNotNull().cast("int"), "id": F.coalesce("id", F.lit(0))})
    return named.groupBy("bucket").transformWithStateInPandas(store, schema, "append", "EventTime")


def stream_jobs(events: DataFrame, job: str, ts: str, order: str, stage: str = "stage", status: str = "status",
                ttl_seconds: int = JOB_TTL_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Status events as a job store: every event once its turn has come (``kind`` ``update``), and
    one row (``evicted``, with the last status) when a job has been finished for *ttl_seconds*.

    ``<job>, kind, <ts>, <order>, stage, status``. A job that goes on after it was evicted starts anew.
    Events older than the watermark are dropped. What is held is one row per live job and the rows
    of the last *lateness*.
    """
    timed = events.withColumn(ts, as_instant(events, ts)).withWatermark(ts, lateness)
    slim = timed.select(F.col(job).cast("string").alias("key"), ts, F.unix_micros(ts).alias("us"), F.col(order).cast("long").alias("id"),
                        F.col(stage).alias("stage"), F.col(status).alias("status"))
    made = _in_order(slim, JobStore(ttl_seconds * _MICROS), "key string, kind string, us long, id long, stage string, status string")
    return made.select(F.col("key").cast(dict(events.dtypes)[job]).alias(job), "kind", F.timestamp_micros("us").alias(ts), F.col("id").alias(order), "stage", "status")


def stream_cache_in_order(requests: DataFrame, key: str, ts: str, order: str, ttl_seconds: int = CACHE_TTL_SECONDS,
                          lateness: str = "1 minute") -> DataFrame:
    """``cache_hits`` on a stream, with the same rows as the batch operator for all requests that the
    watermark has passed, however they arrive. A key's stored time leaves the state with its TTL."""
    timed = requests.withColumn(ts, as_instant(requests, ts)).withWatermark(ts, lateness)
    slim = timed.select(F.col(key).cast("string").alias("key"), ts, F.unix_micros(ts).alias("us"), F.col(order).cast("long").alias("id"))
    made = _in_order(slim, CacheStore(ttl_seconds * _MICROS), "key string, us long, id long, hit boolean, stored_us long")
    return made.select(F.col("key").cast(dict(requests.dtypes)[key]).alias(key), F.timestamp_micros("us").alias(ts), F.col("id").alias(order),
                       "hit", F.timestamp_micros("stored_us").alias("stored_at"))
