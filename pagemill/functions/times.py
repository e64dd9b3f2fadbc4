"""Times as instants, whatever kind of timestamp a table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def epoch_micros(df: DataFrame, ts: str) -> Column:
    """Microseconds since the epoch; a timestamp without zone is read as UTC.

    By interval arithmetic, because converting such a timestamp would use the session's zone
    and its clock changes.
    """
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        seconds = f"cast(cast({ts} - {_EPOCH} AS INTERVAL SECOND) AS decimal(20, 6))"
        return F.expr(f"cast({seconds} * 1000000 AS bigint)")
    return F.unix_micros(F.col(ts).cast("timestamp"))


def from_micros(df: DataFrame, ts: str, micros: Column) -> Column:
    """The way back, to the type *ts* has in *df*."""
    if dict(df.dtypes)[ts] == "timestamp_ntz":
        return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))
    return F.timestamp_micros(micros)


def as_instant(df: DataFrame, ts: str) -> Column:
    """*ts* as a TIMESTAMP, which is what a watermark needs."""
    return F.timestamp_micros(epoch_micros(df, ts))
