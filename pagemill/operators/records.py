"""Operators on record tables (``RECORD_SCHEMA``): filters, de-duplication, paging, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.cells import clean_cell, display_text, type_label
from pagemill.functions.text import BROWSER_WHITESPACE, browser_trim
from pagemill.functions.tokens import cursor_offset, make_cursor
from pagemill.schemas import EXPORT_COLUMNS, FIELDS, MAX_RESULT_ROWS, RECORD_COLUMNS, TYPES_OF_FIELD

ALL_TYPES = "all"


def extraction_types(spark) -> DataFrame:
    """The nine field names, in emission order."""
    return spark.createDataFrame(list(enumerate(FIELDS)), "position int, field string")


def types_of_fields(spark) -> DataFrame:
    """(field, type) pairs: which record types a field asks for."""
    pairs = [(field, kind) for field, kinds in TYPES_OF_FIELD.items() for kind in kinds]
    return spark.createDataFrame(pairs, "field string, type string")


def union_records(*parts: DataFrame) -> DataFrame:
    """Concatenation of extractor outputs; columns a part lacks are NULL."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


# -- filters ---------------------------------------------------------------------------


def _type_is(kind: str) -> Column:
    return F.lit(True) if kind == ALL_TYPES else F.col("type") == kind


def _has_value() -> Column:
    return F.coalesce(browser_trim("value") != "", F.lit(False))


def _mentions(keyword: str, columns: list[str]) -> Column:
    needle = keyword.strip(BROWSER_WHITESPACE).lower()
    if not needle:
        return F.lit(True)
    # one disjunct per column, so the scan stops at the first that matches
    found = (F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in columns)
    return reduce(lambda a, b: a | b, found)


def record_filter(kind: str = ALL_TYPES, hide_empty: bool = False, keyword: str = "",
                  columns: tuple[str, ...] = EXPORT_COLUMNS) -> Column:
    """Type, hide-empty and keyword filters as one predicate."""
    keep = _type_is(kind) & _mentions(keyword, list(columns))
    return keep & _has_value() if hide_empty else keep


def filter_type(records: DataFrame, kind: str = ALL_TYPES) -> DataFrame:
    return records.filter(_type_is(kind))


def hide_empty(records: DataFrame) -> DataFrame:
    """Rows whose value is neither NULL nor blank."""
    return records.filter(_has_value())


def keyword_search(records: DataFrame, keyword: str, columns: list[str] | None = None) -> DataFrame:
    """Rows where any field contains the trimmed keyword, whatever the case."""
    searched = columns or [c for c in records.columns if c not in ("page_id", "ord")]
    return records.filter(_mentions(keyword, searched))


def apply_filters(records: DataFrame, kind: str = ALL_TYPES, hide_empty: bool = False, keyword: str = "",
                  dedupe: bool = False, within: tuple[str, ...] = ()) -> DataFrame:
    """Type, hide-empty, keyword, then whole-row de-duplication, *within* the given columns if any."""
    kept = records.filter(record_filter(kind, hide_empty, keyword))
    return dedupe_rows(kept, within) if dedupe else kept


def filtered_count(records: DataFrame, kind: str = ALL_TYPES, hide_empty: bool = False,
                   keyword: str = "") -> DataFrame:
    """``filtered_count`` of ``total_count``, both counted in one pass."""
    return records.agg(
        F.count_if(record_filter(kind, hide_empty, keyword)).alias("filtered_count"),
        F.count("*").alias("total_count"),
    )


# -- de-duplication --------------------------------------------------------------------


def dedupe_records(records: DataFrame) -> DataFrame:
    """First record per (page, type, value), by ``ord``.

    A minimum over the whole row instead of a ranking window: copies are combined before the
    shuffle, so a value repeated a million times arrives once per task. For records straight
    from pages ``extract_records(dedupe=True)`` does the same without any shuffle.
    """
    rest = [c for c in RECORD_COLUMNS if c not in ("page_id", "type", "value", "ord")]
    first = F.min(F.struct("ord", *rest)).alias("first")
    return (
        records.groupBy("page_id", "type", "value")
        .agg(first)
        .select("page_id", "type", "value", "first.*")
        .select(*RECORD_COLUMNS)
    )


def dedupe_rows(records: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Whole-record duplicates dropped; the first by (page_id, ord) stays.

    A record holds its page's URL but not its id: crawls of one URL under several ids count as one source
    unless *within* names ``page_id``, by which each of them keeps its own.
    """
    return (
        records.groupBy(*within, *EXPORT_COLUMNS)
        .agg(F.min(F.struct("page_id", "ord")).alias("first"))
        .select("first.*", *EXPORT_COLUMNS)
    )


# -- order and paging ------------------------------------------------------------------


def assign_ord(records: DataFrame, name: str = "ord", span: int = 65_536) -> DataFrame:
    """Dense 0-based position within the page, in the order of ``ord``.

    A page is numbered in stretches of *span* consecutive ``ord`` values, so a page with very
    many records is shared by as many tasks; what the stretches before hold is added on.
    """
    parts = records.withColumn("_part", ((F.col("ord") - F.pmod("ord", F.lit(span))) / span).cast("long"))
    earlier = W.partitionBy("page_id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = (
        parts.groupBy("page_id", "_part")
        .agg(F.count("*").alias("n"))
        .select("page_id", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    )
    position = F.row_number().over(W.partitionBy("page_id", "_part").orderBy("ord")) - 1 + F.col("_before")
    return (
        parts.join(before, ["page_id", "_part"])
        .withColumn(name, position.cast("long"))
        .select(*records.columns, *([] if name in records.columns else [name]))
    )


def page_records(records: DataFrame, cursor: str | None = None, size: int = MAX_RESULT_ROWS) -> DataFrame:
    """Each page's slice of *size* rows at the cursor, with ``next_cursor`` (NULL on the last).

    One row more than the slice is ranked, to tell whether a next slice exists. The bound on
    the rank lets Spark drop the rest of a large page before the shuffle.
    """
    offset = max(cursor_offset(cursor), 0)
    by_page = W.partitionBy("page_id")
    ranked = records.withColumn("row_no", F.row_number().over(by_page.orderBy("ord"))).filter(
        F.col("row_no") <= offset + size + 1
    )
    more = F.max("row_no").over(by_page) > offset + size
    return (
        ranked.withColumn("next_cursor", F.when(more, make_cursor(str(offset + size))))
        .filter(F.col("row_no").between(offset + 1, offset + size))
        .drop("row_no")
    )


# -- aggregates ------------------------------------------------------------------------


def records_by_type(records: DataFrame) -> DataFrame:
    return records.groupBy("type").agg(F.count("*").alias("n"))


def type_share(records: DataFrame) -> DataFrame:
    """Types by count with their rounded percentage and the number of types."""
    counted = records_by_type(records)
    # a closed list of types: their counts fit one row
    listed = counted.agg(
        F.sum("n").alias("total"), F.count("*").alias("n_types"), F.collect_list(F.struct("type", "n")).alias("types")
    )
    return (
        listed.select("total", "n_types", F.inline("types"))
        .select("type", "n", F.expr("cast(floor(100.0D * n / total + 0.5D) AS bigint)").alias("percent"), "n_types")
        .orderBy(F.desc("n"), "type")
    )


def distinct_types(records: DataFrame) -> DataFrame:
    return records.select("type").distinct().orderBy("type")


def job_counts(batch: DataFrame) -> DataFrame:
    """Record and warning count per page, from ``extract_batch`` (pages without any included)."""
    return batch.select(
        "page_id",
        "record_count",
        (F.size("warnings") + F.when(F.col("success"), 0).otherwise(1)).alias("warning_count"),
    )


# -- views -----------------------------------------------------------------------------


def export_view(records: DataFrame) -> DataFrame:
    """The records as exported: text cells cleaned, numbers untouched."""
    kinds = dict(records.dtypes)
    return records.select(
        *((clean_cell(c) if kinds[c] == "string" else F.col(c)).alias(c) for c in EXPORT_COLUMNS)
    )


def display_view(records: DataFrame) -> DataFrame:
    """The columns of the result table."""
    return records.select(
        "page_id",
        "ord",
        type_label("type").alias("type_label"),
        display_text("value").alias("value"),
        display_text("text").alias("text_or_alt"),
        display_text("level").alias("level"),
        display_text("source_url").alias("source_url"),
    )


# -- requests --------------------------------------------------------------------------


def requested_records(requests: DataFrame, records: DataFrame, spark=None) -> DataFrame:
    """Records of the types some request for their page's URL asked for.

    *requests* has ``url`` and ``fields``. Those that name a ``page_id`` too are for that page alone,
    whatever others have its URL. Wanted (url, type) pairs are made distinct first, so a URL requested
    over and over is one row on the right of the semi join.
    """
    page = ["page_id"] if "page_id" in requests.columns else []
    pairs = F.broadcast(types_of_fields(spark or records.sparkSession))  # ten fixed rows
    wanted = (
        requests.select(*page, F.col("url").alias("source_url"), F.explode("fields").alias("field"))
        .join(pairs, "field")
        .select(*page, "source_url", "type")
        .distinct()
    )
    return records.join(wanted, [*page, "source_url", "type"], "left_semi").select(*records.columns)
