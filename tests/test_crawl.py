"""Jobs over a crawl: copies of responses, answers per request, and what is never moved."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.operators.chains import follow_chains
from pagemill.plans.crawl import answer_requests, crawl_batch
from pagemill.sources.readers import large_body_files, read_body_files, read_responses

RESPONSE = "url string, status int, content_type string, location string, body binary, fetched_at long"


def page(url, html, at=None):
    return (url, 200, "text/html; charset=utf-8", None, html.encode(), at)


@pytest.fixture(scope="module")
def responses(spark):
    rows = [
        page("http://a.example/", "<title>old</title>", 1), page("http://a.example/", "<title>new</title><a href='x'>l</a>", 2),
        ("http://b.example/", 302, None, "http://a.example/", b"", 5), page("http://b.example/", "<title>no longer</title>", 4),
        page("http://c.example/", "<title>twice</title>"), page("http://c.example/", "<title>twice</title>"),
        ("http://d.example/", 200, "application/pdf", None, b"", 1),
    ]
    return spark.createDataFrame(rows, RESPONSE)


@pytest.fixture(scope="module")
def requests(spark):
    urls = ["http://a.example/", "http://b.example/", "http://c.example/", "http://c.example/", "http://d.example/", "http://e.example/"]
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_the_newest_copy_counts(requests, responses):
    rows = {r.page_id: r for r in crawl_batch(requests, responses, ["title", "links"], with_data=True).collect()}
    assert [rows[i].success for i in range(6)] == [True, True, True, True, False, False]
    assert [d.value for d in rows[0].data] == ["new", "http://a.example/x"]
    assert [d.value for d in rows[1].data] == ["new", "http://b.example/x"]
    assert [d.value for d in rows[2].data] == [d.value for d in rows[3].data] == ["twice"]
    assert rows[4].code == "CONTENT_TYPE_UNSUPPORTED"


def test_markup_is_not_shuffled(spark, requests, responses, tmp_path):
    path = str(tmp_path / "responses")
    responses.drop("fetched_at").filter("url <> 'http://c.example/' OR status = 200").dropDuplicates(["url", "body"]).write.parquet(path)
    batch = crawl_batch(requests, read_responses(spark, path, handles=True), ["title"])
    plan = batch._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if re.search(r"Exchange (hash|range|Round|Single)", line)]
    assert "MapInArrow" in plan and "BroadcastHashJoin" in plan and not moved
    assert {r.page_id for r in batch.collect() if r.success} == {0, 1, 2, 3}


def test_requests_are_answered_apart(spark):
    rows = [(1, "http://a.example/", "<title>A</title><h1>H</h1><p>P</p><a href='/x'>x</a>"), (2, "http://b.example/", "<title>B</title>"), (3, "http://c.example/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    asked = [("r1", "http://a.example/", ["title"]), ("r2", "http://a.example/", ["links", "headings", "bogus"]), ("r3", "http://c.example/", ["title"]),
             ("r4", "http://none.example/", ["title"]), ("r5", "http://b.example/", ["bogus"]), ("r6", "http://b.example/", None), ("r7", None, ["title"])]
    requests = spark.createDataFrame(asked, "request_id string, url string, fields array<string>")
    got = {(r.request_id, r.type, r.value) for r in answer_requests(requests, pages).collect()}
    assert got == {("r1", "title", "A"), ("r2", "link", "http://a.example/x"), ("r2", "heading", "H")}


def test_pages_nobody_asked_for_are_not_parsed(spark):
    from pagemill.operators import extract

    seen = spark.sparkContext.accumulator(0)

    def counting(url, elements):
        seen.add(1)
        return []

    extract.register_function("counting", ["title"], counting)
    try:
        pages = spark.createDataFrame([(i, f"http://{i}.example/", "<title>T</title>") for i in range(20)], "page_id long, url string, html string")
        requests = spark.createDataFrame([("r", "http://3.example/", ["title"])], "request_id string, url string, fields array<string>")
        assert [r.page_id for r in answer_requests(requests, pages).collect()] == [3]
        assert seen.value <= 1
    finally:
        del extract.EXTRACTORS["counting"]


def test_chains_that_have_ended_leave_the_frontier(spark):
    edges = [(f"u{i}", i % 4 != 0, f"u{i - 1}" if i % 4 else None) for i in range(40)] + [("x", True, "nowhere"), ("y", True, "y")]
    found = {r.start_url: (r.final_url, r.hops, r.outcome) for r in follow_chains(spark.createDataFrame(edges, "url string, redirects boolean, target string")).collect()}
    assert all(found[f"u{i}"] == (f"u{i - i % 4}", i % 4, "ok") for i in range(40))
    assert found["x"] == ("nowhere", 1, "missing") and found["y"][2] == "too_many" and len(found) == 42


def test_files_over_the_limit_are_told_by_size(spark, tmp_path):
    for name, size in (("a", 10), ("b", 11), ("c", 1)):
        (tmp_path / f"{name}.html").write_bytes(b"x" * size)
    path = str(tmp_path / "*.html")
    kept = read_body_files(spark, path, limit=10)
    assert sorted(r.n for r in kept.select(F.octet_length("body").alias("n")).collect()) == [1, 10]
    assert "LessThanOrEqual(length,10)" in kept._jdf.queryExecution().executedPlan().toString()
    large = large_body_files(spark, path, 10)
    assert [r.url.rsplit("/", 1)[1] for r in large.collect()] == ["b.html"]
    assert "content" not in large._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
