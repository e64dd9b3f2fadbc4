"""Job history: append-only tables of jobs and their records, and what is read off them.

A job is known by the pair (``run``, ``id``): the run that saved it and the page. Its records carry
the pair as (``run``, ``job_id``) and are told apart by ``ord``. No id is computed, so none collides
between runs and none overflows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.extract import explode_records, page_arrays, select_fields
from pagemill.schemas import (
    EXTRA_COLUMNS,
    EXTRA_SCHEMA,
    JOB_RECORD_SCHEMA,
    JOB_SCHEMA,
    MAX_HISTORY_ROWS,
)
from pagemill.session import materialize, remove

def extra_json() -> Column:
    """A record's other keys as JSON, NULL when it has none."""
    return F.expr(f"nullif(to_json(struct({', '.join(EXTRA_COLUMNS)})), '{{}}')")


def job_rows(batch: DataFrame, fields: Iterable[str], created_at: Column, duration_ms: Column | None = None,
             used_js: bool = False) -> DataFrame:
    """``JOB_SCHEMA`` rows of the pages of ``extract_batch`` that could be read."""
    return batch.filter("success").select(
        F.col("page_id").alias("id"),
        "url",
        F.lit(",".join(fields)).alias("fields"),
        F.lit("done").alias("status"),
        "record_count",
        F.size("warnings").alias("warning_count"),
        (F.lit(0.0) if duration_ms is None else duration_ms).cast("double").alias("duration_ms"),
        created_at.cast("timestamp").alias("created_at"),
        F.lit(used_js).alias("used_js"),
    )


def job_record_rows(records: DataFrame) -> DataFrame:
    """``JOB_RECORD_SCHEMA`` rows."""
    return records.select(
        F.col("page_id").alias("job_id"),
        "ord",
        "type",
        "value",
        extra_json().alias("extra"),
        "source_url",
    )


def save_history(
    pages: DataFrame,
    path: str,
    fields: Iterable[str] | None = None,
    run: str | None = None,
    created_at: Column | None = None,
    duration_ms: float | Column = 0.0,
    used_js: bool = False,
) -> str:
    """Extract *pages* and append ``jobs`` and ``job_records`` under *path*; returns the run id.

    Records are de-duplicated per page. Pages are parsed once: the shredded rows are written
    to the shared folder and both tables are made from them. Saving a run again replaces it,
    so a retried job or micro-batch leaves nothing twice.
    """
    wanted = select_fields(fields)
    run = run or uuid.uuid4().hex
    arrays = page_arrays(pages, wanted, dedupe=True)
    arrays = materialize(arrays.withColumn("record_count", F.size("records")), "history")
    batch = arrays.select(
        "page_id", "url", F.col("error").isNull().alias("success"), "record_count", "warnings"
    )
    jobs = job_rows(batch, wanted, created_at if created_at is not None else F.current_timestamp(),
                    duration_ms if isinstance(duration_ms, Column) else F.lit(duration_ms), used_js)
    records = job_record_rows(explode_records(arrays.filter("error IS NULL")))
    for name, rows in (("job_records", records), ("jobs", jobs)):
        (
            rows.withColumn("run", F.lit(run))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run")
            .parquet(f"{path.rstrip('/')}/{name}")
        )
    remove(arrays)
    return run


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """``JOB_SCHEMA`` rows with their ``run``."""
    return spark.read.schema(JOB_SCHEMA + ", run string").parquet(f"{path.rstrip('/')}/jobs")


def read_job_records(spark: SparkSession, path: str) -> DataFrame:
    """``JOB_RECORD_SCHEMA`` rows with the ``run`` of their job."""
    return spark.read.schema(JOB_RECORD_SCHEMA + ", run string").parquet(f"{path.rstrip('/')}/job_records")


def history_records(job_records: DataFrame, job_id: int | None = None, run: str | None = None) -> DataFrame:
    """Records of one job (*run* and *job_id*), of a page's jobs in all runs, or all; ``extra``
    spread back into columns.

    The filters reach the scan: the run is a folder, and file and row-group ranges of ``job_id``
    prune the rest.
    """
    rows = job_records if run is None else job_records.filter(F.col("run") == run)
    rows = rows if job_id is None else rows.filter(F.col("job_id") == job_id)
    spread = rows.withColumn("e", F.from_json("extra", EXTRA_SCHEMA))
    return spread.select("run", "job_id", "ord", "type", "value", "e.*", "source_url")


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """Newest jobs first, at most 200."""
    return jobs.orderBy(F.desc("created_at"), F.desc("run"), F.desc("id")).limit(min(limit, MAX_HISTORY_ROWS))


def job_with_records(jobs: DataFrame, job_records: DataFrame) -> DataFrame:
    """Each job's row beside each of its records."""
    left = jobs.select("run", F.col("id").alias("job_id"), "url", "status", "record_count")
    right = job_records.select("run", "job_id", "ord", "type", "value")
    return left.join(right, ["run", "job_id"])


def jobs_without_records(jobs: DataFrame, job_records: DataFrame) -> DataFrame:
    return jobs.join(job_records.select("run", F.col("job_id").alias("id")), ["run", "id"], "left_anti")


def dashboard_totals(jobs: DataFrame, job_records: DataFrame) -> DataFrame:
    """``total_jobs, total_records, avg_duration_ms``: one aggregate over both tables stacked."""
    stacked = jobs.select(F.lit(True).alias("is_job"), "duration_ms").unionByName(
        job_records.select(F.lit(False).alias("is_job"), F.lit(None).cast("double").alias("duration_ms"))
    )
    return stacked.agg(
        F.count_if("is_job").alias("total_jobs"),
        F.count_if(~F.col("is_job")).alias("total_records"),
        F.coalesce(F.round(F.avg("duration_ms"), 1), F.lit(0.0)).alias("avg_duration_ms"),
    )
