"""``shred``: HTML text to element ranges, one row per page.

The only Python in the extraction path. Each page's visible text is kept once; an element
is a byte range over it, so nested unclosed paragraphs cost nothing until a record is cut.
All later steps are Column expressions over the row, so a page is never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial
from html import unescape
from html.entities import html5
from html.parser import HTMLParser
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.schemas import LEAF_SCHEMA, MADE_SCHEMA, MAX_PAGE_TEXT
from pagemill.shipping import ship_with_jobs

ship_with_jobs(__name__)

# Elements that never have content, and elements whose text is not shown.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN = frozenset(("script", "style", "template", "rt", "rp"))
TEXT_TAGS = frozenset("title h1 h2 h3 h4 h5 h6 p a td th".split())
ALL_TAGS = TEXT_TAGS | frozenset("base meta link img table tr".split())
ATTRIBUTES = frozenset("href rel src alt name property content".split())

_BATCH_BYTES = 16 * 1024 * 1024
_BATCH_PAGES = 256

_NODE = pa.struct(
    [
        ("tag", pa.string()),
        ("last", pa.int32()),
        ("t0", pa.int32()),
        ("t1", pa.int32()),
        ("attrs", pa.map_(pa.string(), pa.string())),
    ]
)


# Markup every reader agrees on: plain tags with well-formed attributes, doctypes, comments
# without inner dashes. Pages made of nothing else are read token by token.
_SPACE = r"[ \t\n\r\f]"
_NAME = r"""[^\s/>="'<]++"""
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`][^\s"'<>`]*+)"""
_VALUE_PARTS = r"""(?:"([^"]*+)"|'([^']*+)'|([^\s"'=<>`][^\s"'<>`]*+))"""
_EQUALS = rf"{_SPACE}*+={_SPACE}*+"
_ATTRIBUTE = re.compile(rf"({_NAME})(?:{_EQUALS}{_VALUE_PARTS})?")
_TAG = re.compile(
    rf"""<(?:/([a-zA-Z][a-zA-Z0-9:_-]*+){_SPACE}*+>
    |([a-zA-Z][a-zA-Z0-9:_-]*+)
     ((?:{_SPACE}++{_NAME}(?:{_EQUALS}{_VALUE})?)*+)
     {_SPACE}*+(/?)>
    |!(?:--(?!-?>)(?:[^-]|-(?!-))*+-{{2,}}+>|[dD][oO][cC][tT][yY][pP][eE][^>]*+>))""",
    re.VERBOSE,
)
_REFERENCE = re.compile(r"&(?:#([0-9]+|[xX][0-9a-fA-F]+)|([a-zA-Z][-.a-zA-Z0-9]*));?")
_ODD_REFERENCE = re.compile(r"&#(?:(?!(?:[0-9]+|[xX][0-9a-fA-F]+)[^0-9a-fA-F])|[0-9]{4000})")
_RAW_END = {tag: re.compile(rf"</\s*{tag}", re.I) for tag in ("script", "style")}


def _named(name: str) -> str:
    return html5.get(name + ";") or html5.get(name) or "&" + name


def _numbered(digits: str) -> str:
    code = int(digits[1:], 16) if digits[:1] in "xX" else int(digits)
    if 0x80 <= code < 0xA0:
        try:
            return bytes([code]).decode("windows-1252")
        except UnicodeDecodeError:
            pass
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "�"


def _odd_reference(html: str) -> bool:
    # single characters are found many times faster
    return "&" in html and "#" in html and _ODD_REFERENCE.search(html) is not None


def _marked_section(html: str) -> bool:
    return "[" in html and "!" in html and "<![" in html


def _dereference(match: re.Match) -> str:
    return _numbered(match[1]) if match[1] else _named(match[2])


class _TooMuch(Exception):
    """What has been read of a page already yields more text than its limit."""


class _PageParser(HTMLParser):
    """Element ranges of one page at a time.

    An end tag closes the nearest open element of its name and all inside it; one without
    an open match is ignored; nothing else closes an element. Text runs between two tags
    (or comments) are stripped and joined without a separator.

    A page of ordinary markup is read by ``_read``; anything odd in it, and the page is read
    again by the standard parser, whose recovery rules then hold.
    """

    def __init__(self, tags: frozenset[str], attributes: frozenset[str]):
        super().__init__(convert_charrefs=False)
        self._tags, self._attributes = tags, attributes
        self._limit = inf

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def parse(self, html: str, limit: int | None = None) -> tuple[bytes, list[list]]:
        """Text and nodes of a page. One that comes to more than *limit* bytes of text is given up as soon
        as that is certain, unless something in it may be unreadable, which would be its error then."""
        unsure = limit is None or _marked_section(html) or _odd_reference(html)
        self._limit = inf if unsure else limit
        self._start_page()
        if not self._read(html):
            self._start_page()
            self.reset()
            self.feed(html)
            self.close()
        self._end_run()
        while self._open:
            self._pop()
        return b"".join(self._pieces), self._nodes

    def _start_page(self) -> None:
        self._pieces: list[bytes] = []
        self._size = 0
        self._run: list[str] = []
        self._nodes: list[list] = []
        self._open: list[tuple[str, int]] = []
        self._count: Counter = Counter()
        self._showing = self._hiding = 0
        self._closed_void: Counter = Counter()
        self._cost = self._rate = self._rows = 0
        self._weights: list[int] = []

    def _check(self) -> None:
        """Ends a page whose elements, were they all closed here, came to more than the limit: what
        follows can only add to it. ``_cost`` is what ``text_cost`` makes of them; one more byte of text
        adds ``_rate`` to it, a cell as many times as there are rows around it."""
        if self._cost > self._limit and len(self._nodes) ** 2 * (self._size + 3) > MAX_PAGE_TEXT:
            raise _TooMuch

    def _read(self, html: str) -> bool:
        """Read a page of ordinary markup; False when it is not."""
        if _odd_reference(html):
            return False
        at, end = 0, len(html)
        tags, run = self._tags, self._run
        find, match = html.find, _TAG.match
        while at < end:
            here = find("<", at)
            if here != at:
                text = html[at:] if here < 0 else html[at:here]
                if self._showing and not self._hiding:
                    if "&" in text:
                        if here < 0:
                            return False  # a reference may be cut off by the end
                        text = _REFERENCE.sub(_dereference, text)
                    run.append(text)
                if here < 0:
                    break
            token = match(html, here)
            if token is None:
                following = html[here + 1 : here + 2]
                if not following or following in "/!?" or following.isascii() and following.isalpha():
                    return False
                if self._showing and not self._hiding:
                    run.append("<")  # not markup
                at = here + 1
                continue
            at = token.end()
            closing, opening, attributes, slash = token.groups()
            if opening:
                tag = opening.lower()
                attrs = _attributes(attributes) if attributes and tag in tags else ()
                if slash:
                    self.handle_startendtag(tag, attrs)
                    continue
                self.handle_starttag(tag, attrs)
                if tag in _RAW_END:
                    stop = _RAW_END[tag].search(html, at)
                    if stop is None or not html.startswith(">", stop.end()) or html[stop.start() + 2] in " \t\n\r\f":
                        return False
                    at = stop.start()
            elif closing:
                self.handle_endtag(closing.lower())
            else:
                self._end_run()
        return True

    def _end_run(self) -> None:
        if self._run:
            if self._showing and not self._hiding:
                piece = "".join(self._run).strip()
                if piece:
                    raw = piece.encode("utf-8", "replace")
                    self._pieces.append(raw)
                    self._size += len(raw)
                    self._cost += len(raw) * self._rate
                    if self._cost > self._limit:
                        self._check()
            self._run.clear()

    def _pop(self) -> str:
        tag, node = self._open.pop()
        self._count[tag] -= 1
        if tag in HIDDEN:
            self._hiding -= 1
        if node >= 0:
            self._nodes[node][1] = len(self._nodes) - 1
            self._nodes[node][3] = self._size
            if tag in TEXT_TAGS:
                self._showing -= 1
                self._rate -= self._weights.pop() if tag == "td" else 1
            elif tag == "tr":
                self._rows -= 1
        return tag

    def _close(self, tag: str) -> None:
        self._end_run()
        if self._count[tag]:
            while self._pop() != tag:
                pass

    def handle_starttag(self, tag, attrs, void=True):
        if self._run:
            self._end_run()
        node = -1
        if tag in self._tags:
            nodes, size = self._nodes, self._size
            node = len(nodes)
            nodes.append([tag, node, size, size, {k: v or "" for k, v in attrs if k in self._attributes} if attrs else {}])
            if tag in TEXT_TAGS:
                self._showing += 1
                if tag == "td":
                    self._weights.append(self._rows)
                    self._rate += self._rows
                    self._cost += 3 * self._rows
                    if self._cost > self._limit:
                        self._check()
                else:
                    self._rate += 1
            elif tag == "tr":
                self._rows += 1
        if tag in HIDDEN:
            self._hiding += 1
        self._open.append((tag, node))
        self._count[tag] += 1
        if void and tag in VOID:
            self._close(tag)
            self._closed_void[tag] += 1

    def handle_endtag(self, tag):
        if self._closed_void[tag]:
            self._closed_void[tag] -= 1
        else:
            self._close(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, void=False)
        self.handle_endtag(tag)

    def handle_data(self, data):
        self._run.append(data)

    def handle_entityref(self, name):
        self._run.append(_named(name))

    def handle_charref(self, name):
        self._run.append(_numbered(name))

    def _skip(self, data):
        self._end_run()

    handle_comment = handle_decl = handle_pi = _skip

    def unknown_decl(self, data):
        self._end_run()
        if data.upper().startswith("CDATA["):
            hidden, self._hiding = self._hiding, 0
            self._run.append(data[len("CDATA["):])
            self._end_run()
            self._hiding = hidden


def _attributes(text: str) -> list[tuple[str, str]]:
    return [
        (name.lower(), unescape(double or single or bare))
        for name, double, single, bare in _ATTRIBUTE.findall(text)
    ]


class _Batch:
    """Column buffers of finished pages, turned into one Arrow batch."""

    def __init__(self) -> None:
        self.bytes = 0
        self.ids, self.urls, self.bodies, self.errors, self.warnings = [], [], [], [], []
        self.made, self.failed, self.wanted = [], [], []
        self.offsets, self.attr_offsets = [0], [0]
        self.tags, self.last, self.t0, self.t1, self.keys, self.values = [], [], [], [], [], []

    def add(self, page_id, url, warnings, body: bytes, nodes: Iterable[list], error: str | None) -> None:
        self.ids.append(page_id)
        self.warnings.append(warnings)
        self.urls.append(url)
        self.bodies.append(body)
        self.errors.append(error)
        for tag, last, t0, t1, attrs in nodes:
            self.tags.append(tag)
            self.last.append(last)
            self.t0.append(t0)
            self.t1.append(t1)
            for key, value in attrs.items():
                self.keys.append(key)
                self.values.append(value.encode("utf-8", "replace").decode())
                self.bytes += len(value)
            self.attr_offsets.append(len(self.keys))
        self.offsets.append(len(self.tags))
        self.bytes += len(body) + 40 * (self.offsets[-1] - self.offsets[-2])

    @property
    def full(self) -> bool:
        return self.bytes >= _BATCH_BYTES or len(self.ids) >= _BATCH_PAGES

    def to_arrow(self, functions: bool = False) -> pa.RecordBatch:
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_offsets, pa.int32()),
            pa.array(self.keys, pa.string()),
            pa.array(self.values, pa.string()),
        )
        nodes = pa.StructArray.from_arrays(
            [
                pa.array(self.tags, pa.string()),
                pa.array(self.last, pa.int32()),
                pa.array(self.t0, pa.int32()),
                pa.array(self.t1, pa.int32()),
                attrs,
            ],
            fields=list(_NODE),
        )
        columns = {
            "page_id": pa.array(self.ids, pa.int64()),
            "url": pa.array(self.urls, pa.string()),
            "body": pa.array(self.bodies, pa.binary()),
            "nodes": pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), nodes),
            "error": pa.array(self.errors, pa.string()),
            "warnings": pa.array(self.warnings, pa.list_(pa.string())),
            "wanted": pa.array(self.wanted, pa.int32()),
        }
        if functions:
            columns["made"] = pa.array(self.made, _MADE)
            columns["failed"] = pa.array(self.failed, _FAILED)
        return pa.RecordBatch.from_pydict(columns)


def text_cost(size: int, nodes: list[list]) -> int:
    """Bytes of text that the records of a page with *size* bytes of text come to.

    Elements that are never closed hold all that follows, so a page of n open rows and cells has some
    n³ of it. A row costs the texts of its cells with their separators, other elements their own.
    """
    if len(nodes) ** 2 * (size + 3) <= MAX_PAGE_TEXT:
        return 0  # it can't be much
    cells, total, own = [0], 0, 0
    for tag, _, t0, t1, _ in nodes:
        if tag == "td":
            own += t1 - t0 + 3
        elif tag in TEXT_TAGS:
            total += t1 - t0
        cells.append(own)
    return total + sum(cells[last + 1] - cells[i] for i, (tag, last, *_) in enumerate(nodes) if tag == "tr")


def parse_page(parser: _PageParser, html: str | None, limit: int = MAX_PAGE_TEXT) -> tuple[bytes, list, str | None]:
    """Text, nodes and error of one page; a page that is missing, cannot be parsed or would yield more
    than *limit* bytes of text fails alone."""
    if html is None:
        return b"", [], "page without markup"
    try:
        body, nodes = parser.parse(html, limit)
        too_much = text_cost(len(body), nodes) > limit
    except _TooMuch:
        too_much = True
    except Exception as exc:  # noqa: BLE001 - whatever the markup provokes is the page's warning
        return b"", [], str(exc) or type(exc).__name__
    if too_much:
        return b"", [], f"its records exceed the {limit}-byte limit"
    return body, nodes, None


#: An extractor written in Python: the page's URL and its elements (``tag``, ``attrs``, ``text``) to
#: records (dicts with a ``type`` and any of the other record columns).
PageFunction = Callable[[str, list[dict]], Iterable[dict]]

_MADE_FIELDS = [("type", pa.string()), ("value", pa.string()), ("text", pa.string()), ("level", pa.string()),
                ("table_index", pa.int32()), ("row_index", pa.int32()), ("table_headers", pa.string())]
_MADE = pa.list_(pa.struct([("field", pa.string()), *_MADE_FIELDS]))
_FAILED = pa.list_(pa.struct([("field", pa.string()), ("message", pa.string())]))


def run_functions(
    functions: Mapping[str, tuple[frozenset[str], PageFunction]], url: str, body: bytes, nodes: list[list]
) -> tuple[list[dict], list[dict]]:
    """Records of the Python extractors, and a message for each of them that failed on this page.

    A field's records count only if all of them could be made.
    """
    made: list[dict] = []
    failed: list[dict] = []
    for field, (tags, function) in functions.items():
        elements = [{"tag": n[0], "attrs": n[4], "text": body[n[2] : n[3]].decode()} for n in nodes if n[0] in tags]
        try:
            records = [{"field": field, **{k: r.get(k) for k, _ in _MADE_FIELDS}} for r in function(url, elements)]
            pa.array(records, _MADE.value_type)
        except Exception as exc:  # noqa: BLE001 - one extractor's failure is a warning of the page
            failed.append({"field": field, "message": str(exc) or type(exc).__name__})
        else:
            made += records
    return made, failed


def _shred_batches(
    tags: frozenset[str], attributes: frozenset[str], batches: Iterator[pa.RecordBatch],
    functions: Mapping[str, tuple[frozenset[str], PageFunction]] | None = None, tags_of_bit: Mapping[int, frozenset[str]] | None = None,
) -> Iterator[pa.RecordBatch]:
    parsers = {None: _PageParser(tags, attributes)}
    out = _Batch()
    for batch in batches:
        for page_id, url, html, warnings, *mask in zip(*(column.to_pylist() for column in batch.columns)):
            wanted = mask[0] if mask else None
            if wanted not in parsers:
                parsers[wanted] = _PageParser(frozenset().union(*(t for bit, t in tags_of_bit.items() if wanted & bit)), attributes)
            body, nodes, error = parse_page(parsers[wanted], html)
            out.add(page_id, url, warnings, body, nodes, error)
            out.wanted.append(wanted)
            if functions:
                made, failed = run_functions(functions, url, body, nodes) if error is None else ([], [])
                out.made.append(made)
                out.failed.append(failed)
            if out.full:
                yield out.to_arrow(bool(functions))
                out = _Batch()
    if out.ids:
        yield out.to_arrow(bool(functions))


def shred(
    pages: DataFrame,
    tags: Iterable[str] = ALL_TAGS,
    attributes: Iterable[str] = ATTRIBUTES,
    functions: Mapping[str, tuple[frozenset[str], PageFunction]] | None = None,
    tags_of_bit: Mapping[int, frozenset[str]] | None = None,
) -> DataFrame:
    """One row per page (``LEAF_SCHEMA``): its text and the wanted elements in document order.

    ``nodes[i].last`` is the index of the last element inside ``nodes[i]``; ``t0``/``t1`` are
    byte offsets of its text in ``body``. Works on static and streaming DataFrames. Filter
    pages first: nothing is pushed down through it. Pages may bring ``warnings`` (strings) along.
    *functions* (field to tags and extractor) are run on each page while it is at hand, each by itself;
    their outcome is in two more columns (``MADE_SCHEMA``). Pages may bring a bit mask ``wanted`` along if
    *tags_of_bit* is given: of such a page only the tags of its bits are collected.
    """
    run = partial(_shred_batches, frozenset(tags), frozenset(attributes), functions=dict(functions or {}), tags_of_bit=tags_of_bit)
    warnings = F.col("warnings") if "warnings" in pages.columns else F.lit(None)
    schema = f"{LEAF_SCHEMA}, {MADE_SCHEMA}" if functions else LEAF_SCHEMA
    mask = [F.col("wanted").cast("int").alias("wanted")] if tags_of_bit else []
    return pages.select("page_id", "url", "html", warnings.cast("array<string>").alias("warnings"), *mask).mapInArrow(run, schema)


def cut_sql(body: str, start: str, stop: str) -> str:
    """The text of a byte range of the page's text, as an SQL expression."""
    return f"cast(substring({body}, {start} + 1, {stop} - {start}) AS string)"


def nodes(pages: DataFrame, tags: Iterable[str] = ALL_TAGS, attributes: Iterable[str] = ATTRIBUTES) -> DataFrame:
    """One row per element (``NODE_SCHEMA``), in document order within ``page_id``."""
    return (
        shred(pages, tags, attributes)
        .select("page_id", "url", "body", F.posexplode("nodes").alias("node_id", "n"))
        .select(
            "page_id",
            "url",
            "node_id",
            F.col("n.last").alias("end_id"),
            F.col("n.tag").alias("tag"),
            F.col("n.attrs").alias("attrs"),
            F.expr(cut_sql("body", "n.t0", "n.t1")).alias("text"),
        )
    )
