"""Audits against step-by-step loops, and the streaming forms against the batch forms."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions.times import as_instant
from pagemill.operators import audit, history
from pagemill.operators.extract import extract_batch, extract_records
from pagemill.sources.readers import stream_pages, stream_table
from pagemill.streaming.pages import stream_extract, stream_history
from pagemill.streaming.requests import stream_cache, stream_latest_status, stream_rate_audit

START = dt.datetime(2024, 1, 1)


def requests(seed=1, keys=6, busy=500):
    rng, rows = random.Random(seed), []
    for key in range(keys):
        t = 0
        for _ in range(busy if key < 2 else 40):
            t += rng.choice([0, 1, 3, 7, 20, 90, 100, 101, 350]) if key != 1 else 50
            rows.append((len(rows), key, START + dt.timedelta(seconds=t, milliseconds=rng.choice([0, 0, 500]))))
    rng.shuffle(rows)
    return rows


def by_key(rows):
    found = {}
    for row in sorted(rows, key=lambda r: (r[2], r[0])):
        found.setdefault(row[1], []).append(row)
    return found


def served(rows, ttl):
    out = {}
    for group in by_key(rows).values():
        stored = None
        for id_, _, ts in group:
            hit = stored is not None and (ts - stored).total_seconds() <= ttl
            stored = stored if hit else ts
            out[id_] = (hit, stored)
    return out


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(requests(), "id long, k long, ts timestamp_ntz")


@pytest.mark.parametrize("ttl", [1, 100, 5000])
@pytest.mark.parametrize("hot_rows", [10**9, 100, 0])
def test_cache_hits(log, ttl, hot_rows):
    got = {r.id: (r.hit, r.stored_at) for r in audit.cache_hits(log, "k", "ts", "id", ttl, hot_rows).collect()}
    assert got == served(requests(), ttl)


def test_fold_carries_a_key_over_batches():
    import pyarrow as pa

    rows = [(key, us, us) for key in "ab" for us in range(0, 50)]
    columns = [pa.array([r[i] for r in rows]) for i in range(3)]
    whole = pa.RecordBatch.from_arrays(columns, ["key", "us", "id"])
    parts = [whole.slice(i, 7) for i in range(0, len(rows), 7)]
    one = pa.Table.from_batches(audit._fold_batches(12, iter([whole]))).to_pydict()
    many = pa.Table.from_batches(audit._fold_batches(12, iter(parts))).to_pydict()
    assert one == many and one["hit"].count(False) == 8


@pytest.mark.parametrize("hot_rows", [10**9, 1])
def test_null_keys_are_a_key(spark, hot_rows):
    rows = [(i, k, START + dt.timedelta(seconds=60 * i)) for i, k in enumerate([None, 1, None, 1, None, None])]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz")
    got = {r.id: (r.hit, r.stored_at) for r in audit.cache_hits(df, "k", "ts", "id", 130, hot_rows).collect()}
    assert got == served(rows, 130) and {r.k for r in audit.cache_hits(df, "k", "ts", "id", 130).collect()} == {None, 1}


@pytest.mark.parametrize("bucket, hot_rows", [(60, 0), (1000, 100), (10**6, 0), (60, 10**9)])
def test_spacing(log, bucket, hot_rows):
    gap = 30_000
    audited, slots = {}, {}
    for group in by_key(requests()).values():
        last, slot = None, None
        for id_, _, ts in group:
            if last is not None and (ts - last).total_seconds() * 1000 < gap:
                audited[id_] = (ts - last).total_seconds() * 1000
            last = ts
            slot = ts if slot is None else max(ts, slot + dt.timedelta(milliseconds=gap))
            slots[id_] = slot
    assert {r.id: r.gap_ms for r in audit.spacing_audit(log, "k", "ts", "id", gap, bucket, hot_rows).collect()} == audited
    assert {r.id: r.slot_ts for r in audit.spacing_schedule(log, "k", "ts", "id", gap, bucket, hot_rows).collect()} == slots


def test_live_jobs(spark):
    rows = [(1, None), (2, START), (3, START - dt.timedelta(seconds=1))]
    jobs = spark.createDataFrame(rows, "id long, finished_at timestamp_ntz")
    assert sorted(r.id for r in audit.live_jobs(jobs, "TIMESTAMP '2024-01-01 00:05:00Z'").collect()) == [1, 2]


def run_to_rows(stream, spark, folder, mode="append"):
    """Every micro-batch's rows, in order."""
    seen = []
    run = (
        stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: seen.append([r.asDict() for r in df.collect()]))
        .option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return [row for batch in seen for row in batch], seen


@pytest.fixture
def arriving(spark, log, tmp_path):
    """The log as files in time order, one micro-batch each."""
    folder = tmp_path / "log"
    for i in range(4):
        lo, hi = START + dt.timedelta(seconds=6000 * i), START + dt.timedelta(seconds=6000 * (i + 1) if i < 3 else 10**7)
        log.filter((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi))).coalesce(1).write.mode("append").parquet(str(folder))
    return stream_table(spark, str(folder), log.schema, files_per_trigger=1)


def test_stream_cache_agrees_with_batch(spark, log, arriving, tmp_path):
    rows, batches = run_to_rows(stream_cache(arriving, "k", "ts", "id", 100, "1 day"), spark, tmp_path / "c1")
    assert len(batches) > 2
    expected = {i: (hit, at) for i, (hit, at) in served(requests(), 100).items()}
    assert {r["id"]: (r["hit"], r["stored_at"]) for r in rows} == expected


def test_stream_rates_agree_with_batch(spark, log, arriving, tmp_path):
    rows, _ = run_to_rows(stream_rate_audit(arriving, "k", "ts", 5, "10 minutes", "0 seconds"), spark, tmp_path / "c2")
    got = {(r["k"], r["window_start"], r["n"]) for r in rows}
    timed = log.withColumn("ts", as_instant(log, "ts"))
    closed = timed.agg(F.max("ts").alias("m")).first().m
    batch = {(r.k, r.window_start, r.n) for r in audit.rate_audit(timed, "k", "ts", 5, "10 minutes").collect()}
    assert got and got <= batch
    assert {w for w in batch if w[1] + dt.timedelta(minutes=10) <= closed} <= got


def test_stream_status_agrees_with_batch(spark, log, arriving, tmp_path):
    rows, _ = run_to_rows(stream_latest_status(arriving, "k", "ts", "id", ["id"]), spark, tmp_path / "c3", "update")
    latest = {}
    for row in rows:
        latest[row["k"]] = row["id"]
    assert latest == {r.k: r.id for r in audit.latest_status(log, "k", "ts", "id", ["id"]).collect()}


PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_stream_extract_agrees_with_batch(spark, tmp_path):
    rows, _ = run_to_rows(stream_extract(stream_pages(spark, PAGES), ["title", "links"]), spark, tmp_path / "c4")
    batch = extract_records(spark.read.parquet(PAGES), ["title", "links"], dedupe=True).collect()
    assert sorted(map(repr, (tuple(r.values()) for r in rows))) == sorted(map(repr, map(tuple, batch)))


def test_history_round_trip_and_reruns(spark, tmp_path):
    pages = spark.read.parquet(PAGES)
    path = str(tmp_path / "history")
    for _ in range(2):  # the second run of the same id replaces the first
        history.save_history(pages, path, ["title", "headings", "links"], run="a")
    history.save_history(pages.filter("page_id < 3"), path, ["title"], run="b")
    jobs, saved = history.read_jobs(spark, path), history.read_job_records(spark, path)
    expected = extract_records(pages, ["title", "headings", "links"], dedupe=True)
    assert jobs.count() == pages.count() + 3
    assert saved.count() == expected.count() + 3
    assert saved.filter("type = 'title' AND extra IS NULL").count() == pages.count() + 3
    one = history.history_records(saved, 1, "a").orderBy("ord").collect()
    assert [(r.type, r.value, r.text, r.level) for r in one] == [
        (r.type, r.value, r.text, r.level) for r in expected.filter("page_id = 1").orderBy("ord").collect()]
    assert {r.run for r in history.history_records(saved, 1).collect()} == {"a", "b"}
    assert history.job_with_records(jobs, saved).count() == saved.count()
    counts = {r.id: r.record_count for r in jobs.filter("fields <> 'title'").collect()}
    assert counts == {r.page_id: r.record_count for r in extract_batch(pages, ["title", "headings", "links"], dedupe=True).collect()}
    totals = history.dashboard_totals(jobs, saved).first()
    assert (totals.total_jobs, totals.total_records, totals.avg_duration_ms) == (jobs.count(), saved.count(), 0.0)
    empty = history.dashboard_totals(jobs.limit(0), saved.limit(0)).first()
    assert (empty.total_jobs, empty.total_records, empty.avg_duration_ms) == (0, 0, 0.0)
    assert history.recent_jobs(jobs, 1000).count() <= 200
    left = history.jobs_without_records(jobs, saved.filter("run <> 'b' OR job_id <> 2")).collect()
    assert [(r.run, r.id) for r in left] == [("b", 2)]


def test_history_of_wide_ids_and_warnings(spark, tmp_path):
    rows = [((1 << 63) - 1, "https://a.test/", "<title>x</title>", ["w1", "w2"]), (-(1 << 62), "https://b.test/", "<title>y</title>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, warnings array<string>")
    path = str(tmp_path / "wide")
    history.save_history(pages, path, ["title"], run="a")
    assert {r.id: r.warning_count for r in history.read_jobs(spark, path).collect()} == {rows[0][0]: 2, rows[1][0]: 0}
    assert {(r.job_id, r.ord, r.value) for r in history.read_job_records(spark, path).collect()} == {(rows[0][0], 0, "x"), (rows[1][0], 0, "y")}


def test_cache_hits_of_tied_and_null_rows(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=s), i) for k in ("a", None) for s, i in ((0, 1), (0, 1), (0, 2), (50, None), (50, None), (150, 3), (151, None), (151, 4))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    answers = []
    for hot in (100, 2):
        found = audit.cache_hits(df, "k", "ts", "id", 60, hot_rows=hot).collect()
        answers.append(sorted((str(r.k), r.ts, str(r.id), r.hit, r.stored_at) for r in found))
        assert sum(not r.hit for r in found) == 4
    assert answers[0] == answers[1]


def test_null_keys_are_split_like_others(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(None if i % 2 else "a", base + dt.timedelta(milliseconds=7 * i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long")
    for run in (audit.spacing_audit, audit.spacing_schedule):
        answers = [sorted(map(str, run(df, "k", "ts", "id", 20, bucket_seconds=1, hot_rows=hot).collect())) for hot in (1000, 10)]
        assert answers[0] == answers[1] and len(answers[0]) >= 398
    usual, large = audit._split_hot(df.withColumn("_key", F.struct("k")), "_key", 10)
    assert usual.count() == 0 and large.count() == 400


def test_late_requests_hit_nothing_newer():
    import pandas as pd

    class State:
        exists, hasTimedOut, held = True, False, (1_000,)
        get = property(lambda self: self.held)

        def update(self, held):
            self.held = held

        def setTimeoutTimestamp(self, ms):
            pass

        def getCurrentWatermarkMs(self):
            return 0

    from pagemill.streaming.requests import _serve

    state = State()
    rows = pd.DataFrame({"us": [10, 999, 1_000, 1_050, 1_200], "id": [1, 2, 3, 4, 5]})
    (out,) = _serve(100, ("k",), iter([rows]), state)
    assert out.hit.tolist() == [False, False, True, True, False] and out.stored_us.tolist() == [10, 999, 1_000, 1_000, 1_200]
    assert state.held == (1_200,)


def test_stream_history_is_saved_once(spark, tmp_path):
    path = str(tmp_path / "h")
    for _ in range(2):  # a restart finds nothing new
        stream_history(stream_pages(spark, PAGES), path, str(tmp_path / "hc"), ["title"]).awaitTermination()
    pages = spark.read.parquet(PAGES).count()
    assert (history.read_jobs(spark, path).count(), history.read_job_records(spark, path).count()) == (pages, pages)
