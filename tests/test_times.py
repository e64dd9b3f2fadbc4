"""Times do not depend on the session's zone."""

import datetime as dt

from pagemill.functions.times import as_instant, epoch_micros, from_micros

MOMENTS = [dt.datetime(1969, 7, 20, 20, 17, 40, 123456), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 10, 2, 30),
           dt.datetime(2024, 3, 31, 1, 30, 0, 1), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(2100, 1, 1, 0, 0, 0, 999999)]


def test_micros_both_ways(spark):
    epoch = dt.datetime(1970, 1, 1)
    expected = {m: (m - epoch) // dt.timedelta(microseconds=1) for m in MOMENTS}
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([(m,) for m in MOMENTS], "ts timestamp_ntz")
    try:
        for name in ("UTC", "America/New_York", "Europe/London"):
            spark.conf.set("spark.sql.session.timeZone", name)
            out = df.select("ts", epoch_micros(df, "ts").alias("us"))
            back = out.withColumn("back", from_micros(df, "ts", out["us"]))
            assert {r.ts: r.us for r in back.collect()} == expected
            assert all(r.ts == r.back for r in back.collect())
            instants = df.select("ts", as_instant(df, "ts").alias("at"))
            assert {r.ts: r.us for r in instants.select("ts", epoch_micros(instants, "at").alias("us")).collect()} == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
