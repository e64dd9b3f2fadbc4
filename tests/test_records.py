"""Filters, de-duplication, paging, exports and token functions on small tables."""

import glob
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagemill.functions import cells, tokens
from pagemill.operators import records as rc
from pagemill.schemas import RECORD_SCHEMA
from pagemill.sources.readers import read_url_list
from pagemill.sources.writers import export_cap, write_csv, write_json

URL = "https://example.com/"


def rec(page, ord_, kind, value, text=None, level=None, table_index=None):
    return (page, ord_, kind, value, text, level, table_index, None, None, URL)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(
        [
            rec(1, 0, "title", "Hello World"),
            rec(1, 1, "heading", "Section", level="h2"),
            rec(1, 2, "link", "https://a.example/", "First"),
            rec(1, 3, "link", "https://a.example/", "Second"),
            rec(1, 4, "image", "https://a.example/i.png", ""),
            rec(1, 5, "meta_description", " 　\t"),
            rec(1, 6, "meta_keywords", None),
            rec(1, 7, "link", "https://a.example/", "First"),
            rec(2, 0, "title", "Hello World"),
        ],
        RECORD_SCHEMA,
    )


def ords(df):
    return sorted((r.page_id, r.ord) for r in df.collect())


def test_filters(table):
    assert ords(rc.filter_type(table, "link")) == [(1, 2), (1, 3), (1, 7)]
    assert rc.filter_type(table, "all").count() == 9
    assert ords(rc.hide_empty(table)) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 7), (2, 0)]
    assert ords(rc.keyword_search(table, "  HELLO ")) == [(1, 0), (2, 0)]
    assert ords(rc.keyword_search(table, "SECond")) == [(1, 3)]
    assert ords(rc.keyword_search(table, "h2")) == [(1, 1)]
    assert rc.keyword_search(table, "example.com").count() == 9  # the source URL is searched too
    assert rc.keyword_search(table, "   ").count() == 9
    assert ords(rc.keyword_search(table, "meta_")) == [(1, 5), (1, 6)]
    assert ords(rc.apply_filters(table, "link", True, "a.example", True)) == [(1, 2), (1, 3)]
    assert rc.filtered_count(table, "link").first() == Row(filtered_count=3, total_count=9)


def test_dedupe(table):
    kept = rc.dedupe_records(table)
    assert kept.schema.names == table.schema.names
    assert ords(kept) == [(1, 0), (1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (2, 0)]
    assert kept.filter("type = 'link'").first().text == "First"
    # whole rows: texts count, pages do not (same source URL)
    assert ords(rc.dedupe_rows(table)) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6)]


def test_filters_keep_the_records_of_each_page(table):
    """Two pages of one URL have the same title; each shows its own."""
    assert ords(rc.apply_filters(table, "title", True, "hello", True, within=("page_id",))) == [(1, 0), (2, 0)]


def test_dedupe_combines_copies_before_the_shuffle(table):
    plan = rc.dedupe_records(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min") > plan.index("Exchange")  # below it in the tree


def test_types_and_counts(spark, table):
    assert [r.type for r in rc.distinct_types(table).collect()] == [
        "heading", "image", "link", "meta_description", "meta_keywords", "title"]
    share = rc.type_share(table).collect()
    assert (share[0].type, share[0].n, share[0].percent, share[0].n_types) == ("link", 3, 33, 6)
    assert (share[1].type, share[1].percent) == ("title", 22)
    assert [r.field for r in rc.extraction_types(spark).orderBy("position").collect()] == [
        "title", "meta", "headings", "paragraphs", "links", "images", "tables", "open_graph", "canonical_url"]


def test_ord_and_pages(spark):
    rows = spark.createDataFrame([rec(p, 10 * i, "link", f"v{i}") for p in (1, 2) for i in range(p * 4)], RECORD_SCHEMA)
    dense = rc.assign_ord(rows)
    for span in (1, 20, 25):
        assert sorted(rc.assign_ord(rows, span=span).collect()) == sorted(dense.collect())
    assert dense.columns == rows.columns
    assert sorted(r.ord for r in dense.filter("page_id = 1").collect()) == [0, 1, 2, 3]
    first = rc.page_records(rows, None, 4)
    by_page = {r.page_id: r.next_cursor for r in first.collect()}
    assert first.count() == 8 and by_page[1] is None and tokens.cursor_offset(by_page[2]) == 4
    second = rc.page_records(rows, by_page[2], 4).collect()
    assert sorted((r.page_id, r.value, r.next_cursor) for r in second) == [(2, f"v{i}", None) for i in range(4, 8)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_requested_records(spark, table):
    requests = spark.createDataFrame([(URL, ["links", "meta"]), (URL, ["links"]), ("https://other/", ["title"])], "url string, fields array<string>")
    kept = rc.requested_records(requests, table)
    assert {r.type for r in kept.collect()} == {"link", "meta_description", "meta_keywords"} and kept.count() == 5


def test_requests_that_name_a_page_are_for_that_page(spark, table):
    requests = spark.createDataFrame([(1, URL, ["links"]), (2, URL, ["title"])], "page_id long, url string, fields array<string>")
    assert ords(rc.requested_records(requests, table)) == [(1, 2), (1, 3), (1, 7), (2, 0)]


def test_union_fills_missing_columns(spark, table):
    other = spark.createDataFrame([(9, 0, "title", "x")], "page_id long, ord long, type string, value string")
    assert rc.union_records(table, other).filter("page_id = 9").first().source_url is None


def test_clean_cells(spark):
    cases = {
        "=HYPERLINK(B2)": "'=HYPERLINK(B2)", "+49 30 12": "'+49 30 12", "-7%": "'-7%", "@now": "'@now",
        "bed 4, row 2": "bed 4, row 2", "=a<b>&": "'=a&lt;b&gt;&amp;", '"q"': '"q"', " =x": " =x", "": "", "x\n=y": "x\n=y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.out for r in df.select("c", cells.clean_cell("c").alias("out")).collect()} == cases


def test_cursors(spark):
    cases = {"NDI=": 42, "*no token*": 0, None: 0, "": 0, "YWJj": 0, "LTU=": -5, "IDcg": 7, "N\nDI=": 42, "MV8w": 10, "////": 0}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.n for r in df.select("c", tokens.parse_cursor("c").alias("n")).collect()} == cases
    for token, offset in cases.items():
        assert tokens.cursor_offset(token) == offset
    assert spark.range(1).select(tokens.make_cursor("42L").alias("c")).first().c == "NDI="


def test_cache_key_ignores_field_order(spark):
    import hashlib

    df = spark.createDataFrame([("u", ["b", "a"]), ("u", ["a", "b"])], "url string, fields array<string>")
    keys = {r.k for r in df.select(tokens.cache_key("url", "fields").alias("k")).collect()}
    assert keys == {hashlib.sha256(b"u|a,b").hexdigest()}


def test_small_rules(spark):
    row = spark.range(1).select(
        F.array(*(tokens.backoff_seconds(str(i)) for i in range(4))).alias("b"),
        F.array(*(tokens.clamp_progress(str(i)) for i in (-3, 50, 101))).alias("p"),
        tokens.distinct_fields("array('b', 'a', 'b')").alias("d"),
    ).first()
    assert (row.b, row.p, row.d) == ([0.0, 0.5, 1.0, 2.0], [0, 50, 100], ["b", "a"])


def test_csv_and_json(spark, table, tmp_path):
    values = ["=1", " padded ", 'say "hi", ok', "line\nbreak", "<b>&", ""]
    rows = spark.createDataFrame([rec(1, i, "link", v, table_index=i) for i, v in enumerate(values)], RECORD_SCHEMA)
    write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    (path,) = glob.glob(str(tmp_path / "csv" / "*.csv"))
    import csv

    with open(path, newline="", encoding="utf-8") as handle:
        read = list(csv.DictReader(handle))
    assert [r["value"] for r in read] == ["'=1", " padded ", 'say "hi", ok', "line\nbreak", "&lt;b&gt;&amp;", ""]
    assert [r["table_index"] for r in read] == list("012345")
    write_csv(rows.limit(0), str(tmp_path / "empty"))
    (path,) = glob.glob(str(tmp_path / "empty" / "*.csv"))
    assert open(path).read().strip() == "type,value,text,level,table_index,row_index,table_headers,source_url"
    write_json(rows.coalesce(1), str(tmp_path / "json"))
    (path,) = glob.glob(str(tmp_path / "json" / "*.json"))
    lines = [json.loads(line) for line in open(path, encoding="utf-8")]
    assert [r["value"] for r in lines] == values and "text" not in lines[0]


def test_export_cap(table):
    assert export_cap(table, 9) is table
    with pytest.raises(ValueError):
        export_cap(table, 8)


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("  https://a/\t\n\n   \nhttps://b/ \r\n﻿https://c/\n", encoding="utf-8")
    assert [r.url for r in read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a/", "https://b/", "https://c/"]
