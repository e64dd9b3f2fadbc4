"""Sinks: CSV and JSON exports of records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pagemill.operators.records import export_view
from pagemill.schemas import EXPORT_COLUMNS, MAX_RESULT_ROWS


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cleaned records as CSV files with a header each; without records, a header alone."""
    (
        export_view(records)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Records as JSON lines, not cleaned; absent keys are left out."""
    records.select(*EXPORT_COLUMNS).write.mode(mode).json(path)


def export_cap(records: DataFrame, limit: int = MAX_RESULT_ROWS) -> DataFrame:
    """*records* unchanged, or an error when there are more than *limit*. Runs a bounded count."""
    if records.limit(limit + 1).count() > limit:
        raise ValueError(f"Row count exceeds the maximum allowed export size of {limit}.")
    return records
