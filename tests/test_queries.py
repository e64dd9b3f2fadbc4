"""Every registered query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_every_query_has_its_sql():
    own = {name for name in queries() if not name.startswith("op") or not name[2:3].isdigit()} - {"pipeline"}
    assert own <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query(spark, connection, name):
    assert difference(spark, connection, SF, name, queries(), oracle_sql()) is None


def test_entry(spark):
    assert {r.type for r in entry(spark).collect()} == {"title", "heading", "link"}


@pytest.mark.parametrize("name", ["apply_filters", "dedupe_rows", "requested_records"])
def test_query_on_urls_under_several_ids(spark, tmp_path, name):
    import duckdb

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.limit(20).unionAll(pages.limit(20).selectExpr("page_id + 10001", "url", "html")).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    copies = duckdb.connect()
    copies.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert difference(spark, copies, str(tmp_path), name, queries(), oracle_sql()) is None
