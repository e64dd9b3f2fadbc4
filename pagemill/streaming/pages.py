"""Extraction on arrival."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.extract import extract_records
from pagemill.operators.history import save_history


def stream_extract(pages: DataFrame, fields: Iterable[str] | None = None, dedupe: bool = True) -> DataFrame:
    """A stream of pages as a stream of records. Stateless: a page is all its records need."""
    return extract_records(pages, fields, dedupe)


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query when it began this checkpoint."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first().id


def stream_history(pages: DataFrame, path: str, checkpoint: str, fields: Iterable[str] | None = None,
                   stream: str = "pages", **trigger) -> StreamingQuery:
    """Save the history of every micro-batch as a run of its own.

    The run is named by the stream, the id that its checkpoint holds and the batch: a batch that is run
    again replaces its own rows, and another stream, or this one with a new checkpoint, adds runs.
    """
    wanted = None if fields is None else list(fields)

    def save(batch: DataFrame, batch_id: int) -> None:
        save_history(batch, path, wanted, run=f"{stream}-{checkpoint_id(batch.sparkSession, checkpoint)}-{batch_id:06}")

    return (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
