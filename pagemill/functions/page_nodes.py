"""``page_nodes(url, html [, tags])``: the shredder as a table function for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagemill.operators.shred import ALL_TAGS, ATTRIBUTES, _PageParser, parse_page
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)


class _PageNodes:
    def __init__(self) -> None:
        self._parsers: dict[str, _PageParser] = {}

    def eval(self, url: str, html: str, tags: str = ""):
        if tags not in self._parsers:
            self._parsers[tags] = _PageParser(frozenset(tags.split(",")) if tags else ALL_TAGS, ATTRIBUTES)
        body, nodes, error = parse_page(self._parsers[tags], html)
        if error is not None:
            yield None, None, None, None, None, error
        for node_id, (tag, last, t0, t1, attrs) in enumerate(nodes):
            yield node_id, last, tag, attrs, body[t0:t1].decode("utf-8"), None


def register_page_nodes(spark: SparkSession, name: str = "page_nodes") -> None:
    """Make ``SELECT ... FROM pages p, LATERAL page_nodes(p.url, p.html, 'title,a') n`` work in *spark*.

    Without the third argument all tags of interest come out. A page that cannot be parsed gives
    one row with its ``error`` and no tag.
    """
    table_function = udtf(
        _PageNodes, returnType="node_id int, end_id int, tag string, attrs map<string, string>, text string, error string"
    )
    spark.udtf.register(name, table_function)
