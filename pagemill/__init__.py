"""Typed records out of tables of crawled HTML pages, as Spark DataFrame operators."""

from pagemill.schemas import FIELDS, LEAF_SCHEMA, RECORD_COLUMNS
from pagemill.session import build_session

__all__ = ["FIELDS", "LEAF_SCHEMA", "RECORD_COLUMNS", "build_session"]
