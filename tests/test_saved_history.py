"""Queries over a saved history do the whole job each time: pages are read, parsed and saved again."""

import pytest

from __spark_entry__ import queries
from pagemill.operators import history

NAMES = ["dashboard_totals", "job_with_records", "jobs_without_records", "recent_jobs"]


def write_pages(spark, folder, first, n):
    rows = [(i, f"http://{i}.example/", f"<title>{i}</title><p>words</p>") for i in range(first, first + n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.mode("overwrite").parquet(f"{folder}/pages.parquet")


@pytest.mark.parametrize("name", NAMES)
def test_a_second_call_reads_the_pages_again(spark, tmp_path, name):
    write_pages(spark, tmp_path, 1, 20)
    before = sorted(map(str, queries()[name](spark, str(tmp_path)).collect()))
    write_pages(spark, tmp_path, 101, 30)
    after = sorted(map(str, queries()[name](spark, str(tmp_path)).collect()))
    write_pages(spark, tmp_path / "fresh", 101, 30)
    assert after == sorted(map(str, queries()[name](spark, str(tmp_path / "fresh")).collect())) != before


@pytest.mark.parametrize("name", NAMES)
def test_each_call_saves_both_runs(spark, tmp_path, monkeypatch, name):
    write_pages(spark, tmp_path, 1, 6)
    saved, save = [], history.save_history
    monkeypatch.setattr(history, "save_history", lambda pages, path, *rest, **named: saved.append((path, rest[1])) or save(pages, path, *rest, **named))
    for _ in range(2):
        queries()[name](spark, str(tmp_path)).collect()
    assert [run for _, run in saved] == ["r1", "r2"] * 2 and len({path for path, _ in saved}) == 2
