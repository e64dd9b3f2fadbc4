"""Extractors: shredded page row -> records, without a shuffle.

An extractor is a Column expression over one shredded row that yields the page's records
of one field as an array, in emission order. A page's arrays are concatenated, optionally
de-duplicated, and only then exploded, so extraction, ordering, de-duplication and paging
of a page are all narrow. Text stays a byte range until the rows are out: nested unclosed
paragraphs never sit in memory together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import bind_sql, strip_sql
from pagemill.functions.urls import base_parts_sql, resolve_url_sql, url_host_sql
from pagemill.operators.shred import ATTRIBUTES, PageFunction, cut_sql, shred
from pagemill.schemas import EXPORT_COLUMNS, FIELDS

# A record before its texts are cut: v0..v1 is the value's range, t0..t1 the text's.
_SLIM = {
    "type": "string",
    "value": "string",
    "text": "string",
    "level": "string",
    "table_index": "int",
    "row_index": "int",
    "table_headers": "string",
    "v0": "int",
    "v1": "int",
    "t0": "int",
    "t1": "int",
}


@dataclass(frozen=True)
class Extractor:
    """``build()`` is SQL text over one shredded row: an array of slim records.

    ``failure()``, if given, is SQL text for why it fails on the row, NULL if it does not; where it
    fails the records are never worked out. An extractor with a ``function`` is Python instead.
    """

    tags: frozenset[str]
    build: Callable[[], str] | None
    failure: Callable[[], str] | None = None
    function: PageFunction | None = None


def slim_sql(**given: str) -> str:
    """A slim record; absent keys are NULL."""
    pairs = (f"'{name}', cast({given.get(name, 'NULL')} AS {kind})" for name, kind in _SLIM.items())
    return f"named_struct({', '.join(pairs)})"


_NO_RECORDS = f"filter(array({slim_sql()}), r -> false)"


def tagged_sql(tag: str, condition: str = "true") -> str:
    """The page's *tag* elements ``n`` that meet *condition*, in document order."""
    return f"filter(nodes, n -> n.tag = '{tag}' AND {condition})"


def _each(array: str, record: str) -> str:
    return f"transform({array}, n -> {record})"


def _first(array: str) -> str:
    return f"slice({array}, 1, 1)"


_SHOWN = "n.t1 > n.t0"


def _title() -> str:
    shown = f"filter({_first(tagged_sql('title'))}, n -> {_SHOWN})"
    return _each(shown, slim_sql(type="'title'", v0="n.t0", v1="n.t1"))


def _meta() -> str:
    def named(name: str) -> str:
        first = _first(tagged_sql("meta", f"lower(n.attrs['name']) = '{name}'"))
        record = slim_sql(type=f"'meta_{name}'", value=strip_sql("n.attrs['content']"))
        return _each(f"filter({first}, n -> n.attrs['content'] <> '')", record)

    return f"concat({named('description')}, {named('keywords')})"


def _headings() -> str:
    levels = (
        _each(tagged_sql(tag, _SHOWN), slim_sql(type="'heading'", level=f"'{tag}'", v0="n.t0", v1="n.t1"))
        for tag in (f"h{i}" for i in range(1, 7))
    )
    return f"concat({', '.join(levels)})"


def _paragraphs() -> str:
    return _each(tagged_sql("p", _SHOWN), slim_sql(type="'paragraph'", v0="n.t0", v1="n.t1"))


def _on_base(raw: str) -> str:
    return resolve_url_sql(raw, "base", "base_parts")


def _resolved_only(records: str) -> str:
    return f"filter({records}, r -> r.value IS NOT NULL)"


def _links() -> str:
    record = slim_sql(type="'link'", value=_on_base("n.attrs['href']"), t0="n.t0", t1="n.t1")
    return _resolved_only(_each(tagged_sql("a", "n.attrs['href'] IS NOT NULL"), record))


def _images() -> str:
    alt = strip_sql("coalesce(n.attrs['alt'], '')")
    record = slim_sql(type="'image'", value=_on_base("n.attrs['src']"), text=alt)
    return _resolved_only(_each(tagged_sql("img", "n.attrs['src'] IS NOT NULL"), record))


def _inside(index: str, tag: str, i: str) -> str:
    """Indexes of the *tag* elements inside element *index*: an element's descendants are the range
    up to its ``last``, so this reads only the element's own."""
    return f"filter(sequence({index}, nodes[{index}].last), {i} -> {i} > {index} AND nodes[{i}].tag = '{tag}')"


def _cell_texts(indexes: str) -> str:
    cell = bind_sql("nodes[c]", "cell", cut_sql("page_text", "cell.t0", "cell.t1"))
    return f"transform({indexes}, c -> {cell})"


_TABLES = "filter(transform(nodes, (n, i) -> CASE WHEN n.tag = 'table' THEN i END), i -> i IS NOT NULL)"


def _tables() -> str:
    cells_per_row = (
        f"filter(transform({_inside('tab', 'tr', 'tr')}, tr -> {_inside('tr', 'td', 'td')}), "
        "cells -> size(cells) > 0)"
    )
    record = slim_sql(type="'table_row'", value="array_join(cells, ' | ')", table_index="tab_no", row_index="row_no")
    rows = (
        f"transform(filter(transform(transform({cells_per_row}, ids -> {_cell_texts('ids')}), "
        f"(cells, row_no) -> named_struct('shown', exists(cells, c -> c <> ''), 'record', {record})), "
        "r -> r.shown), r -> r.record)"
    )
    # reading ``body`` copies it, so it is read once
    return bind_sql("body", "page_text", f"flatten(transform({_TABLES}, (tab, tab_no) -> {rows}))")


def _table_heads() -> str:
    """The header text of each table, once; a row's record finds it by ``table_index``."""
    headers = f"nullif(array_join({_cell_texts(_inside('tab', 'th', 'th'))}, ' | '), '')"
    return bind_sql("body", "page_text", f"transform({_TABLES}, tab -> {headers})")


def _open_graph() -> str:
    named = (
        f"transform({tagged_sql('meta', 'n.attrs[\'property\'] IS NOT NULL')}, n -> named_struct("
        f"'property', lower({strip_sql("n.attrs['property']")}), 'content', n.attrs['content']))"
    )
    filled = f"filter({named}, m -> startswith(m.property, 'og:') AND m.content <> '')"
    keyed = f"transform({filled}, (m, i) -> named_struct('key', m.property, 'pos', i, 'item', m))"
    absolute = f"CASE WHEN e.item.property IN ('og:image', 'og:url') THEN {_on_base('og_value')} END"
    value = bind_sql(strip_sql("e.item.content"), "og_value", f"coalesce({absolute}, og_value)")
    record = slim_sql(type="'open_graph'", value=value, text="e.item.property")
    return f"transform({first_of_key_sql(keyed)}, e -> {record})"


def _canonical() -> str:
    first = _first(tagged_sql("link", "contains(n.attrs['rel'], 'canonical')"))
    href = "n.attrs['href']"
    record = slim_sql(type="'canonical_url'", value=f"coalesce({resolve_url_sql(href, 'url')}, {href})")
    return _each(f"filter({first}, n -> {href} <> '')", record)


def first_of_key_sql(entries: str) -> str:
    """Of ``array<struct<key, pos, ...>>`` the first entry per key, in ``pos`` order.

    Sorts once and compares neighbours, so it stays near-linear on pages with many records.
    """
    firsts = bind_sql(
        f"sort_array({entries})", "by_key", "filter(by_key, (e, i) -> i = 0 OR e.key <> by_key[i - 1].key)"
    )
    by_pos = f"transform({firsts}, e -> named_struct('pos', e.pos, 'entry', e))"
    return f"transform(sort_array({by_pos}), e -> e.entry)"


#: field name -> extractor, in emission order. ``register`` adds to it.
EXTRACTORS: dict[str, Extractor] = {
    "title": Extractor(frozenset({"title"}), _title),
    "meta": Extractor(frozenset({"meta"}), _meta),
    "headings": Extractor(frozenset(f"h{i}" for i in range(1, 7)), _headings),
    "paragraphs": Extractor(frozenset({"p"}), _paragraphs),
    "links": Extractor(frozenset({"a", "base"}), _links),
    "images": Extractor(frozenset({"img", "base"}), _images),
    "tables": Extractor(frozenset({"table", "tr", "td", "th"}), _tables),
    "open_graph": Extractor(frozenset({"meta", "base"}), _open_graph),
    "canonical_url": Extractor(frozenset({"link"}), _canonical),
}
assert tuple(EXTRACTORS) == FIELDS


def register(field: str, tags: Iterable[str], build: Callable[[], str], failure: Callable[[], str] | None = None) -> None:
    """Add (or replace) an extractor; it is looked up when a plan is built. *failure* tells on which
    pages it fails: these get a warning, and their other fields stay."""
    EXTRACTORS[field] = Extractor(frozenset(tags), build, failure)


def register_function(field: str, tags: Iterable[str], function: PageFunction) -> None:
    """Add (or replace) an extractor written in Python: ``function(url, elements)`` gives the page's
    records as dicts. It runs in the step that parses the page; whatever it raises is a warning of
    that page and field alone."""
    EXTRACTORS[field] = Extractor(frozenset(tags), None, None, function)


def _functions(fields: Iterable[str]) -> dict[str, tuple[frozenset[str], PageFunction]]:
    return {f: (EXTRACTORS[f].tags, EXTRACTORS[f].function) for f in fields if EXTRACTORS[f].function}


def _records_sql(field: str) -> str:
    """The field's records; none where its extractor fails."""
    extractor = EXTRACTORS[field]
    if extractor.function:
        record = slim_sql(**{c: f"m.{c}" for c in ("type", "value", "text", "level", "table_index", "row_index", "table_headers")})
        return f"transform(filter(made, m -> m.field = '{field}'), m -> {record})"
    if extractor.failure is None:
        return extractor.build()
    return f"CASE WHEN ({extractor.failure()}) IS NULL THEN {extractor.build()} ELSE {_NO_RECORDS} END"


def failures_sql(fields: Iterable[str]) -> str:
    """Messages of the extractors that fail on a row, as ``array<string>``."""
    wanted = list(fields)
    said = [f"CASE WHEN ({EXTRACTORS[f].failure()}) IS NOT NULL THEN concat('{f}{FAILED}', ({EXTRACTORS[f].failure()})) END" for f in wanted if EXTRACTORS[f].failure]
    messages = f"array_compact(array({', '.join(said)}))" if said else "cast(array() AS array<string>)"
    thrown = f"transform(failed, f -> concat(f.field, '{FAILED}', f.message))"
    return f"concat({messages}, {thrown})" if _functions(wanted) else messages


#: Between a field's name and why it failed.
FAILED = ": extraction failed — "


def select_fields(requested: Iterable[str] | None) -> tuple[str, ...]:
    """The requested fields in emission order; unknown or no fields are an error."""
    if requested is None:
        return FIELDS
    wanted = list(dict.fromkeys(requested))
    if not wanted:
        raise ValueError("At least one extraction type must be selected.")
    unknown = [f for f in wanted if f not in EXTRACTORS]
    if unknown:
        raise ValueError(f"Unknown extraction type: {', '.join(unknown)}")
    return tuple(f for f in EXTRACTORS if f in wanted)


def base_url() -> Column:
    """First ``<base href>`` as written, else the page URL (over a shredded row)."""
    first = f"get({tagged_sql('base', 'n.attrs[\'href\'] IS NOT NULL')}, 0)"
    return F.expr(f"coalesce({first}.attrs['href'], url)")


def page_arrays(pages: DataFrame, fields: Iterable[str] | None = None, dedupe: bool = False) -> DataFrame:
    """One row per page: ``page_id, url, body, error, warnings, heads, records`` (slim, in emission
    order; ``heads`` are the headers of the page's tables). A field that fails on a page is among its
    warnings and has no records there. Pages may bring ``wanted`` along, a bit mask of the fields (the
    first field is bit 0): others are neither collected nor extracted on that page.

    ``dedupe`` keeps the first record per (type, value) within the page.
    """
    wanted = select_fields(fields)
    tags = frozenset().union(*(EXTRACTORS[f].tags for f in wanted))
    bits = {1 << i: f for i, f in enumerate(wanted)} if "wanted" in pages.columns else {}
    leaves = shred(pages, tags, ATTRIBUTES, _functions(wanted), {bit: EXTRACTORS[f].tags for bit, f in bits.items()})
    if "base" in tags:
        leaves = leaves.withColumn("base", base_url()).withColumn("base_parts", F.expr(base_parts_sql("base")))
    parts = {f: _records_sql(f) for f in wanted}
    for bit, f in bits.items():
        parts[f] = f"CASE WHEN wanted IS NULL OR wanted & {bit} <> 0 THEN {parts[f]} ELSE {_NO_RECORDS} END"
    records = f"concat({', '.join(parts.values())})"
    if dedupe:
        records = _first_per_value_sql(records)
    brought = F.coalesce("warnings", F.array().cast("array<string>"))
    warnings = F.when(F.col("error").isNotNull(), brought).otherwise(F.concat(brought, F.expr(failures_sql(wanted)))).alias("warnings")
    heads = F.expr(_table_heads() if "tables" in wanted else "cast(NULL AS array<string>)").alias("heads")
    return leaves.select("page_id", "url", "body", "error", warnings, heads, F.expr(records).alias("records"))


def _first_per_value_sql(records: str) -> str:
    """First slim record per (type, value); long texts are compared by SHA-256 and length."""
    raw = "substring(page_text, r.v0 + 1, r.v1 - r.v0)"
    value_key = (
        "CASE WHEN r.value IS NOT NULL THEN concat(r.type, '=', r.value) "
        f"WHEN r.v1 - r.v0 <= 64 THEN concat(r.type, '=', cast({raw} AS string)) "
        f"ELSE concat(r.type, '#', sha2({raw}, 256), r.v1 - r.v0) END"
    )
    keyed = f"transform({records}, (r, i) -> named_struct('key', {value_key}, 'pos', i, 'record', r))"
    # reading ``body`` copies it, so it is read once
    return bind_sql("body", "page_text", f"transform({first_of_key_sql(keyed)}, e -> e.record)")


_MADE = {
    "value": f"coalesce(r.value, {cut_sql('body', 'r.v0', 'r.v1')})",
    "text": f"coalesce(r.text, {cut_sql('body', 'r.t0', 'r.t1')})",
    "table_headers": "CASE WHEN r.type = 'table_row' THEN get(heads, r.table_index) ELSE r.table_headers END",
    "source_url": "url",
}


def _full_record() -> list[Column]:
    """Record columns of a slim record ``r``, texts cut out of ``body``."""
    return [F.expr(_MADE.get(c, f"r.{c}")).alias(c) for c in EXPORT_COLUMNS]


def explode_records(arrays: DataFrame) -> DataFrame:
    """``page_arrays`` output as one row per record; ``ord`` counts from 0 within a page.

    An outer explode, because a plain one makes the optimizer test ``size(records) > 0`` on
    the page row first, computing every page's records twice.
    """
    rows = arrays.select("page_id", "url", "body", "heads", F.posexplode_outer("records").alias("ord", "r"))
    return rows.filter("ord IS NOT NULL").select(
        "page_id", F.col("ord").cast("long").alias("ord"), *_full_record()
    )


def extract_records(pages: DataFrame, fields: Iterable[str] | None = None, dedupe: bool = False) -> DataFrame:
    """Pages to records (``RECORD_SCHEMA``). Unrequested extractors never enter the plan."""
    return explode_records(page_arrays(pages, fields, dedupe))


def extract_warnings(pages: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """``page_id, url, message``: one row per requested field that fails on a page, and for each of
    them where the page cannot be parsed."""
    wanted = select_fields(fields)
    leaves = shred(pages, frozenset().union(*(EXTRACTORS[f].tags for f in wanted)), functions=_functions(wanted))
    all_of_them = F.transform(F.array(*map(F.lit, wanted)), lambda field: F.concat(field, F.lit(FAILED), "error"))
    messages = F.when(F.col("error").isNotNull(), all_of_them).otherwise(F.expr(failures_sql(wanted)))
    return leaves.select("page_id", "url", F.explode(messages).alias("message"))


def extract_batch(
    pages: DataFrame, fields: Iterable[str] | None = None, with_data: bool = False, dedupe: bool = False
) -> DataFrame:
    """One row per page: ``success, record_count, warnings, error`` and, if asked, ``data``.
    ``warnings`` are those that the pages bring along (of the robots check, say).

    The page's records are already together in one row, so nothing is grouped or joined.
    """
    arrays = page_arrays(pages, fields, dedupe)
    columns = [
        "page_id",
        "url",
        F.col("error").isNull().alias("success"),
        F.size("records").alias("record_count"),
        "warnings",
        "error",
    ]
    if with_data:
        pairs = ", ".join(f"'{c}', {_MADE.get(c, f'r.{c}').replace('body', 'page_text')}" for c in EXPORT_COLUMNS)
        data = bind_sql("body", "page_text", f"transform(records, r -> named_struct({pairs}))")
        columns.append(F.expr(data).alias("data"))
    return arrays.select(*columns)


def flatten_batch(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``extract_batch(with_data=True)`` output as (records, messages): a page's warnings as they are,
    its error as ``url: error``."""
    records = batch.select("page_id", F.posexplode("data").alias("ord", "r")).select(
        "page_id", F.col("ord").cast("long").alias("ord"), "r.*"
    )
    failure = F.when(F.col("success"), F.array().cast("array<string>")).otherwise(F.array(F.concat("url", F.lit(": "), "error")))
    messages = F.concat("warnings", failure)
    return records, batch.select("page_id", "url", F.explode(messages).alias("message"))


def site_header(pages: DataFrame) -> DataFrame:
    """Per page: first title, host and favicon address (NULL without a host)."""
    host = url_host_sql("url")
    return page_arrays(pages, ["title"]).select(
        "page_id",
        "url",
        F.expr(cut_sql("body", "get(records, 0).v0", "get(records, 0).v1")).alias("title"),
        F.expr(host).alias("hostname"),
        F.expr(f"concat('https://', nullif({host}, ''), '/favicon.ico')").alias("favicon_url"),
    )


def extract_title(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["title"])


def extract_meta(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["meta"])


def extract_headings(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["headings"])


def extract_paragraphs(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["paragraphs"])


def extract_links(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["links"])


def extract_images(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["images"])


def extract_tables(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["tables"])


def extract_open_graph(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["open_graph"])


def extract_canonical(pages: DataFrame) -> DataFrame:
    return extract_records(pages, ["canonical_url"])
