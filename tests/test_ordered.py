"""Buckets of keys in event-time order: what comes out is what a loop over each key's rows gives."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest

from pagemill.sources.readers import stream_table
from pagemill.streaming import ordered
from pagemill.streaming.ordered import CacheStore, JobStore, stream_cache_in_order

TTL = 50_000


class Held:
    """A bucket's state, timers and watermark without Spark."""

    def __init__(self):
        self.blobs, self.value, self.timers, self.now = [], None, [], 0

    def getListState(self, name, schema):
        return self

    def getValueState(self, name, schema):
        return Value()

    def appendValue(self, value):
        self.blobs.append(value)

    def put(self, values):
        self.blobs = list(values)

    def get(self):
        return iter(self.blobs)

    def clear(self):
        self.blobs = []

    def registerTimer(self, ms):
        self.timers.append(ms)

    def getCurrentWatermarkInMs(self):
        return self.now


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held

    def clear(self):
        self.held = None


def by_loop(kind, batches, marks):
    """Row by row: per key the rows that the watermark has passed, and the entry that they leave."""
    waiting, entries, out = [], {}, []
    for batch, now in zip(batches, marks):
        waiting += batch
        due = sorted((r for r in waiting if r[1] // 1000 < now), key=lambda r: (r[1], r[2] is not None, r[2] or 0))
        waiting = [r for r in waiting if r[1] // 1000 >= now]
        for key, us, *rest in due:
            entry = entries.get(key)
            if kind is CacheStore:
                hit = entry is not None and us <= entry + TTL
                entries[key] = entry if hit else us
                out.append((key, us, rest[0], hit, entries[key]))
            else:
                if entry is not None and entry[3] in ("done", "error") and us > entry[0] + TTL:
                    out.append((key, "evicted", *entry))
                entries[key] = (us, *rest)
                out.append((key, "update", us, *rest))
        for key, entry in list(entries.items()):
            last, ends = (entry, True) if kind is CacheStore else (entry[0], entry[3] in ("done", "error"))
            if ends and (last + TTL) // 1000 < now:
                if kind is JobStore:
                    out.append((key, "evicted", *entry))
                del entries[key]
    return out, waiting, entries


def by_store(kind, batches, marks):
    state, store, out = Held(), kind(TTL), []
    store.init(state)
    for batch, state.now in zip(batches, marks):
        names = ["key", "us", "id", "stage", "status"][: 3 if kind is CacheStore else 5]
        if batch:
            rows = pd.DataFrame(batch, columns=names).astype({"id": object})
            rows["named"] = [int(r[2] is not None) for r in batch]
            rows["id"] = pd.Series([r[2] or 0 for r in batch], dtype="int64")
            list(store.handleInputRows((3,), iter([rows.iloc[:7], rows.iloc[7:]] if len(rows) > 7 else [rows]), state))
        due, state.timers = [t for t in state.timers if t <= state.now], [t for t in state.timers if t > state.now]
        for _ in due:  # none is due: nothing to do
            for made in store.handleExpiredTimer((3,), state, None):
                out += [tuple(None if pd.isna(v) else getattr(v, "tolist", lambda v=v: v)() for v in r) for r in made.itertuples(index=False)]
    return out, state, store


@pytest.mark.parametrize("kind", [CacheStore, JobStore])
@pytest.mark.parametrize("seed", range(12))
def test_stores_agree_with_a_loop(kind, seed):
    made = random.Random(seed)
    keys, batches, marks, now = ["a", "b", "", None, *map(str, range(seed))], [], [], 0
    for _ in range(8):
        rows = [(made.choice(keys), made.randrange(now * 1000, (now + 150) * 1000, made.choice((1, 1000, 25_000))), made.choice((None, 1 << 60, made.randrange(5))))
                for _ in range(made.randrange(0, 40))]
        batches.append([(*r, made.choice(("x", None)), made.choice(("running", "done", "error", None))) if kind is JobStore else r for r in rows])
        marks.append(now := now + made.choice((0, 1, 40, 120)))
    out, waiting, entries = by_loop(kind, batches, marks)
    got, state, store = by_store(kind, batches, marks)
    order = lambda rows: sorted(map(str, rows))
    if kind is JobStore:  # rows of one key, time and id may change places among themselves
        out, got = ([(*r[:4], *r[5:]) for r in rows if r[1] == "update"] for rows in (out, got))
        assert {(r[0], r[2]) for r in got} == {(r[0], r[2]) for r in out} and len(got) == len(out)
    else:
        assert order(got) == order(out)
    assert sum(map(len, (ordered._table([bytes(b[0])], kind.ROWS) for b in state.blobs))) == len(waiting)
    held = ordered._table([bytes(store.entries.get()[0])], kind.ROWS) if store.entries.exists() else []
    assert len(held) == len(entries)


def test_evictions_of_jobs_with_different_times():
    made = random.Random(5)
    times = made.sample(range(0, 900_000), 200)
    rows = [(made.choice("abcdef"), us, i, "s", made.choice(("running", "done"))) for i, us in enumerate(times)]
    batches, marks = [[r for r in rows if r[1] // 300_000 == b] for b in range(3)] + [[]], [200, 500, 800, 2000]
    out, got = by_loop(JobStore, batches, marks)[0], by_store(JobStore, batches, marks)[0]
    assert sorted(got) == sorted(out) and {r[1] for r in got} == {"update", "evicted"}


def test_state_and_its_calls_do_not_grow_with_the_keys(spark, tmp_path):
    """Rows of far more keys than buckets are held as a few blobs per bucket; one row is 1 ms before the last watermark."""
    source, start = str(tmp_path / "events"), datetime(2024, 1, 1)
    keys = 4 * ordered.BUCKETS
    first = [(k, start + timedelta(seconds=1), k) for k in range(keys)]
    last = [(-1, start + timedelta(seconds=59, milliseconds=999), keys), (-1, start + timedelta(minutes=2), keys + 1)]
    for rows in (first, last):
        spark.createDataFrame(rows, "k long, ts timestamp, id long").coalesce(1).write.mode("append").parquet(source)
    stream = stream_cache_in_order(stream_table(spark, source, spark.read.parquet(source).schema, 1), "k", "ts", "id", 3600, "1 minute")
    query = stream.writeStream.format("memory").queryName("cache_out").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("cache_out").filter("NOT hit").count() == keys + 1
    held = max(sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress if p.stateOperators)
    assert 0 < held < keys
