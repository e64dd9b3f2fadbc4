"""Streams of more than one micro-batch: run ids, and state that leaves."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.operators import history
from pagemill.sources.readers import stream_pages, stream_table
from pagemill.streaming.ordered import stream_jobs
from pagemill.streaming.pages import stream_history


def test_runs_of_two_checkpoints_stay_apart(spark, tmp_path):
    source, out = str(tmp_path / "pages"), str(tmp_path / "history")
    for i in range(2):
        row = [(i, f"http://{i}.example/", f"<title>{i}</title>")]
        spark.createDataFrame(row, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(source)
    for name in ("one", "two", "one"):  # the third call goes on with the first checkpoint: nothing new
        stream_history(stream_pages(spark, source, 1), out, str(tmp_path / name), ["title"]).awaitTermination()
    runs = {(r.run, r.id) for r in history.read_jobs(spark, out).collect()}
    assert len(runs) == 4 and len({run for run, _ in runs}) == 4
    assert history.read_job_records(spark, out).count() == 4


def test_finished_jobs_leave_the_state(spark, tmp_path):
    """Jobs finish in the first batch; after their TTL none of them is held any more."""
    source, start = str(tmp_path / "events"), datetime(2024, 1, 1)
    kind = "job_id long, ts timestamp, event_id long, stage string, status string"
    batches = [
        [(j, start + timedelta(seconds=j), j, "end", "done") for j in range(50)] + [(99, start, 990, "begin", "running")],
        [(100, start + timedelta(minutes=3), 1000, "begin", "running")],
        [(100, start + timedelta(minutes=20), 1001, "go", "running"), (7, start + timedelta(minutes=19), 1002, "again", "running")],
        [(100, start + timedelta(minutes=40), 1003, "go", "running")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
    stream = stream_jobs(stream_table(spark, source, spark.read.parquet(source).schema, 1), "job_id", "ts", "event_id", ttl_seconds=300)
    query = stream.writeStream.format("memory").queryName("jobs_out").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.table("jobs_out")
    gone = found.filter("kind = 'evicted'")
    assert sorted(r.job_id for r in gone.collect()) == list(range(50))
    assert found.filter("kind = 'update' AND job_id = 7").orderBy("ts").select(F.collect_list("stage")).first()[0] == ["end", "again"]
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    assert held[-1] < 50 < max(held)
