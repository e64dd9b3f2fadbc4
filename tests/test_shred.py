"""The token reader against the standard parser, page by page and on made-up markup."""

import random

import pyarrow.parquet as pq
import pytest

from pagemill.operators import shred as sh


class Standard(sh._PageParser):
    def _read(self, html):
        return False


def both(html, tags=sh.ALL_TAGS):
    return (
        sh.parse_page(sh._PageParser(tags, sh.ATTRIBUTES), html),
        sh.parse_page(Standard(tags, sh.ATTRIBUTES), html),
    )


def test_same_on_every_page():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    read = sh._PageParser(sh.ALL_TAGS, sh.ATTRIBUTES)
    taken = 0
    for html in pages:
        fast, standard = both(html)
        assert fast == standard
        read._start_page()
        taken += read._read(html)
    assert taken > 0.9 * len(pages)


PIECES = [
    "<p>", "</p>", "<P CLASS='x'>", "<b>", "</b>", "<br>", "<br/>", "</br>", "<br />", "<a href=\"/x?a=1&amp;b=2\">", "</a>",
    "<a href=/u/>", "<a href=/u?x=1>", "<a name=t>", "<a href='q' href=\"r\">", "<img src=a.png alt='&lt;'/>", "<img src=\"b\" alt>",
    "<table>", "<tr>", "<td>", "<th>", "</td>", "</tr>", "</table>", "<script>", "</script>", "<SCRIPT>x</p>", "</script >",
    "</ script>", "<style>p{}</style>", "<template>", "</template>", "<ruby>", "<rt>", "</rt>", "<!-- c -->", "<!---->", "<!-->",
    "<!-- a--b -->", "<!--", "-->", "<!DOCTYPE html>", "<!doctype", "<?php x ?>", "<![CDATA[raw]]>", "<!x>", "<", "< ", "<3", "</>",
    "</ p>", "<p", "<a href=\"x", "<a b=c\"d>", "<a =x>", "<a href = 'sp'>", "<a href=''>", "<p/>", "<p />", "<x-y:z>", "</x-y:z>",
    "text", " ", "\n", " ", "é", "日本", "&amp;", "&amp", "&am", "&", "& ", "&&", "&copy;", "&nosuch;", "&#65;", "&#x41;", "&#151;",
    "&#129;", "&#", "&#;", "&#x;", "&#12a;", "&#0;", "&#1114112;", "&#xD800;", "&lt;p&gt;", "&#" + "9" * 5000 + ";", "&a.b-c;", "&notit;", "&hellip", "a=b", "'", '"', ">",
    "<title>", "</title>", "<h1>", "</h1>", "<h2 id=x>", "</h2>", "<base href='/b/'>", "<meta name=description content='d'>",
    "<link rel='canonical' href=/c>", "<div x>", "<div\x0bx>", "<div\x0cx='1'>", "<a\thref='t'\n>", "<a :href.x='1' @y #z [q]=w href=ok>", "<a href=a=b>", "<a href= \"sp\" >", "<a href\x0b=1>", "<a\xa0href=1>",
    "<!-- a --->", "<!-- - - -->", "<a href=/x/ >", "<a href='a>b'>", "<a href=\"a\nb\">", "<br / >", "<img src=x/>", "<a href=>", "<a href='x' =>", "x < y", "<é>", "<1>", "<a href='1'href='2'>", "<br></br>",
]


@pytest.mark.parametrize("seed", range(8))
def test_same_on_made_up_markup(seed):
    rng = random.Random(seed)
    for _ in range(2500):
        html = "".join(rng.choices(PIECES, k=rng.randint(1, 14)))
        fast, standard = both(html)
        assert fast == standard, html


def test_batches_are_cut_by_size():
    import pyarrow as pa

    html = "<p>" + "x" * 1_000_000 + "</p>"
    rows = pa.RecordBatch.from_pydict({"page_id": list(range(40)), "url": ["u"] * 40, "html": [html] * 40, "warnings": [None] * 40})
    out = list(sh._shred_batches(sh.ALL_TAGS, sh.ATTRIBUTES, iter([rows])))
    assert len(out) > 1 and sum(b.num_rows for b in out) == 40


def test_a_page_of_too_much_text_is_not_read_to_its_end():
    for parser in (sh._PageParser(sh.ALL_TAGS, sh.ATTRIBUTES), Standard(sh.ALL_TAGS, sh.ATTRIBUTES)):
        body, nodes, error = sh.parse_page(parser, "<table>" + "<tr><td>1" * 60_000)
        assert (body, nodes, error) == (b"", [], "its records exceed the 67108864-byte limit")
        assert len(parser._nodes) < 2_500
        assert sh.parse_page(parser, "<p>next")[0] == b"next"
        assert sh.parse_page(parser, "<table>" + "<tr><td>1" * 2_000 + "&#" + "9" * 5000 + ";")[2] != error


@pytest.mark.parametrize("seed", range(4))
def test_stopping_early_changes_no_outcome(seed, monkeypatch):
    monkeypatch.setattr(sh, "MAX_PAGE_TEXT", 0)
    rng, stopped = random.Random(seed), 0
    for _ in range(2500):
        html = "".join(rng.choices(PIECES + ["<td>", "<tr>", "text"] * 10, k=rng.randint(1, 40)))
        limit = rng.choice((10, 60, 400))
        for reader in (sh._PageParser, Standard):
            parser, whole = reader(sh.ALL_TAGS, sh.ATTRIBUTES), reader(sh.ALL_TAGS, sh.ATTRIBUTES)
            try:
                body, nodes = whole.parse(html)
                expected = (body, nodes, None) if sh.text_cost(len(body), nodes) <= limit else (b"", [], f"its records exceed the {limit}-byte limit")
            except Exception as exc:  # noqa: BLE001
                expected = (b"", [], str(exc))
            assert sh.parse_page(parser, html, limit) == expected, html
            if expected[2] is None:
                assert parser._cost == sh.text_cost(len(body), nodes)
            stopped += len(parser._nodes) < len(whole._nodes)
    assert stopped > 100
