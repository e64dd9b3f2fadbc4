"""Dropping wide rows by keys: equal on both ways, and without moving the rows."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import hosts, robots
from pagemill.operators.prune import by_keys


@pytest.mark.parametrize("bits", [1 << 6, 1 << 12, 1 << 27])
def test_filters_are_exact(spark, bits):
    given = random.Random(bits)
    rows = [(given.choice([None, given.randrange(1 << 40)]) if i % 50 == 0 else i * 7 - 900, "x" * 10) for i in range(800)]
    frame = spark.createDataFrame(rows + rows[:30], "k long, html string")
    listed = {k for k, _ in rows if k is not None and given.random() < 0.3} | {-5, 1 << 50}
    keys = spark.createDataFrame([(k,) for k in listed] + [(None,)], "key long")
    values = [k for k, _ in rows + rows[:30]]
    show = lambda df: sorted(str(r.k) for r in df.collect())
    for limit in (0, 1 << 20):
        assert show(by_keys(frame, "k", keys, True, 16, limit, bits)) == sorted(str(k) for k in values if k in listed)
        assert show(by_keys(frame, "k", keys, False, 16, limit, bits)) == sorted(str(k) for k in values if k not in listed)
    none = keys.limit(0)
    assert by_keys(frame, "k", none, False, 16, -1, bits).count() == len(values) and by_keys(frame, "k", none, True, 16, -1, bits).count() == 0


def moved(df):
    """Exchanges of the plan that move the markup."""
    text = df._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in text.split("\n") if "Exchange" in line and "BroadcastExchange" not in line]
    return lines


def test_pages_stay_where_they_are(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    site = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    files = pages.select(site.alias("site")).distinct().withColumns({"status": F.lit(200), "body": F.when(F.length("site") % 3 == 0, "User-agent: *\nDisallow: /").otherwise("")})
    addresses = pages.select(F.regexp_extract("url", "//([^/]+)", 1).alias("host")).withColumn("ip", F.when(F.length("host") % 4 == 0, "10.0.0.1").otherwise("198.41.0.4"))
    for build in (lambda limit: robots.robots_allowed(pages, files, limit_bytes=limit), lambda limit: hosts.drop_blocked(pages, addresses, limit_bytes=limit),
                  lambda limit: hosts.drop_blocked(pages, addresses, False, limit_bytes=limit)):
        near, far = build(1 << 30), build(0)
        ids = sorted(r.page_id for r in near.select("page_id").collect())
        assert 0 < len(ids) < pages.count() and sorted(r.page_id for r in far.select("page_id").collect()) == ids
        assert near.columns == far.columns == pages.columns
        assert not moved(near) and not moved(far)
