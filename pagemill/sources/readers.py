"""Sources: page tables, URL lists, raw responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.text import browser_trim
from pagemill.schemas import MAX_BODY_BYTES

PAGE_SCHEMA = "page_id long, url string, html string"
RESPONSE_SCHEMA = "url string, status int, content_type string, location string, body binary"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A crawl table (parquet) as ``page_id, url, html``. Pages are never shuffled: for more tasks
    write more row groups or set smaller splits (``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def spread(pages: DataFrame, tasks: int, limit_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """A small crawl in few row groups, dealt out to *tasks*; one over *limit_bytes* comes back as
    it is, so no more than that is ever moved."""
    spark, total = pages.sparkSession, 0
    for file in pages.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if total > limit_bytes:
            return pages
    return pages.repartition(tasks)


def stream_table(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """New parquet files of a folder as a stream; one file is taken as a pattern for itself. The
    limit per micro-batch bounds what a key's state step has to hold of a backlog."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]" if path.endswith(".parquet") else path)


def stream_pages(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A crawl folder as a stream of pages."""
    return stream_table(spark, path, PAGE_SCHEMA, files_per_trigger)


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """One URL per line, trimmed, blank lines dropped; ``line_no`` is not kept."""
    return spark.read.text(path).select(browser_trim("value").alias("url")).filter("url <> ''")


def read_responses(spark: SparkSession, path: str, handles: bool = False) -> DataFrame:
    """Raw responses (parquet, ``RESPONSE_SCHEMA``), with *handles* also where each one stands: its file
    and the row in it, which costs no reading of bodies."""
    rows = spark.read.schema(RESPONSE_SCHEMA).parquet(path)
    if not handles:
        return rows
    return rows.select("*", F.concat("_metadata.file_path", F.lit("#"), "_metadata.row_index").alias("handle"))


def read_body_files(spark: SparkSession, path: str, content_type: str = "text/html", limit: int | None = None) -> DataFrame:
    """A folder of saved bodies, one file each; the path stands in for the URL.

    With *limit*, files of more bytes are left out by their size and never opened;
    :func:`large_body_files` tells which. Without it all are read, and ``size_cap`` and ``too_large``
    part them.
    """
    files = spark.read.format("binaryFile").load(path)
    files = files if limit is None else files.filter(F.col("length") <= limit)
    return files.select(
        F.col("path").alias("url"),
        F.lit(200).alias("status"),
        F.lit(content_type).alias("content_type"),
        F.lit(None).cast("string").alias("location"),
        F.col("content").alias("body"),
    )


def large_body_files(spark: SparkSession, path: str, limit: int = MAX_BODY_BYTES) -> DataFrame:
    """``url, code, message`` of the files that :func:`read_body_files` leaves out at this limit, from
    their names and sizes alone."""
    files = spark.read.format("binaryFile").load(path)
    return files.filter(F.col("length") > limit).select(
        F.col("path").alias("url"), F.lit("RESPONSE_TOO_LARGE").alias("code"), F.lit(f"Response body exceeds the {limit}-byte limit.").alias("message")
    )
