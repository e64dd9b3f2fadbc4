"""Extractors on small pages, case by case."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import extract as ex
from pagemill.operators.shred import nodes
from pagemill.schemas import FIELDS, RECORD_COLUMNS

SITE = "https://garden.test"
PAGE = f"{SITE}/beds/roses.html"
SOWING = (
    "<table><caption>Sowing</caption><thead><tr><th>Crop</th><th>Row cm</th></tr></thead><tbody>"
    "<tr><td>Beet</td><td>30</td></tr><tr><td>Leek &amp; kin</td><td>25<br>35</td></tr></tbody></table>"
)
LEAFLET = (
    "<!doctype html><title>Roses</title><meta name=keywords content='prune, feed'><h3>In spring</h3><h2>Pruning</h2>"
    "<p>Cut <em>above</em> a bud.</p><p>Burn what is ill, <a href='tools.html#saw'>with care</a>.</p>" + SOWING
)


def record(kind, value, text=None, level=None):
    return (kind, value, text, level)


# (field, html, records)
CASES = [
    ("title", "<title>\n Old\troses\n</title>", [record("title", "Old\troses")]),
    ("title", "<h1>no title here</h1>", []),
    ("title", "<title> \t</title><title>too late</title>", []),
    ("title", "<title>a &amp; b&#33;&eacute;&copy;&nosuch;x&#151;</title>", [record("title", "a & b!é©&nosuchx—")]),
    ("headings", "<h2>soil</h2><h1>beds</h1><h6>notes</h6><h3>lime</h3><h1>paths</h1>",
     [record("heading", "beds", level="h1"), record("heading", "paths", level="h1"), record("heading", "soil", level="h2"),
      record("heading", "lime", level="h3"), record("heading", "notes", level="h6")]),
    ("headings", "<h4>\n</h4><h5><img src=x></h5><h2><i>one</i> two</h2>", [record("heading", "onetwo", level="h2")]),
    ("paragraphs", "<p>wet</p>dry<p>damp</p>", [record("paragraph", "wet"), record("paragraph", "damp")]),
    ("paragraphs", "<p>\r\n</p><p><br></p><p>left over</p>", [record("paragraph", "left over")]),
    ("paragraphs", "<article><p><b>X<br><p>Y</p></article>z", [record("paragraph", "XY"), record("paragraph", "Y")]),
    ("paragraphs", "<p> a <b> b </b> c<!-- x --> d </p>", [record("paragraph", "abcd")]),
    ("paragraphs", "<p>a<script>var t='</p>';</script>b<style>p{}</style><template>t</template>c</p>", [record("paragraph", "abc")]),
    ("paragraphs", "<p>&nbsp;x&nbsp;</p><p>&nbsp;</p>", [record("paragraph", "x")]),
    ("paragraphs", "<p>cut <b>off", [record("paragraph", "cutoff")]),
    ("paragraphs", "<p>cut <p", [record("paragraph", "cut <p")]),
    ("paragraphs", "</p><p>x</div>y</p>z", [record("paragraph", "xy")]),
    ("paragraphs", "<p/>after<p>in<br/>side</p>", [record("paragraph", "inside")]),
    ("paragraphs", "<p><![CDATA[raw <i>]]></p>", [record("paragraph", "raw <i>")]),
    ("paragraphs", "<p>日本<ruby>漢<rt>kan</rt></ruby>é</p><p>ü</p>", [record("paragraph", "日本漢é"), record("paragraph", "ü")]),
    ("links", "<a href=../tools/>Spades</a>", [record("link", f"{SITE}/tools/", "Spades")]),
    ("links", "<base href=https://seed.test/shop/><a href=peas?n=3>Peas</a>", [record("link", "https://seed.test/shop/peas?n=3", "Peas")]),
    ("links", "<a href='data:,x'>no</a><a href='tel:+1'>no</a><a id=here>no</a><a href=/map>yes</a>", [record("link", f"{SITE}/map", "yes")]),
    ("links", '<a href="#thorns"></a><a href="">e</a><a href=" ">b</a><a href>n</a>',
     [record("link", f"{PAGE}#thorns", ""), record("link", PAGE, "b")]),
    ("links", '<base href="rel/"><a href="x">r</a><a href="https://a.b/c">abs</a>', [record("link", "https://a.b/c", "abs")]),
    ("links", '<a href="/1" href="/2">dup</a>', [record("link", f"{SITE}/2", "dup")]),
    ("links", '<a href="/x?a=1&amp;b=2">q</a>', [record("link", f"{SITE}/x?a=1&b=2", "q")]),
    ("meta", "<meta content='thorns, hips' name=keywords><meta name=description content='When to cut'>",
     [record("meta_description", "When to cut"), record("meta_keywords", "thorns, hips")]),
    ("meta", "<meta name=KEYWORDS content='\n moss '><meta name=author content=me>", [record("meta_keywords", "moss")]),
    ("meta", "<meta name=description><meta name=description content=second>", []),
    ("meta", '<meta name="description" content="  ">', [record("meta_description", "")]),
    ("open_graph", "<meta property=og:type content=leaflet><meta property=og:type content=book>", [record("open_graph", "leaflet", "og:type")]),
    ("open_graph", '<meta property="og:title"><meta property=" OG:Title " content="T"><meta property="fb:x" content="n">',
     [record("open_graph", "T", "og:title")]),
    ("open_graph", "<meta property=og:image content=bud.jpg><meta property=og:url content=/beds>",
     [record("open_graph", f"{SITE}/beds/bud.jpg", "og:image"), record("open_graph", f"{SITE}/beds", "og:url")]),
    ("open_graph", "<base href=https://pics.test/r/><meta property=og:image content=../hip.png><meta property=og:url content=urn:x>",
     [record("open_graph", "https://pics.test/hip.png", "og:image"), record("open_graph", "urn:x", "og:url")]),
    ("canonical_url", "<link href=https://garden.test/r rel=canonical>", [record("canonical_url", "https://garden.test/r")]),
    ("canonical_url", "<base href=https://pics.test/><link rel='me canonical' href=all.html><link rel=canonical href=/none>",
     [record("canonical_url", f"{SITE}/beds/all.html")]),
    ("canonical_url", '<link rel="canonical"><link rel="canonical" href="/2">', []),
    ("canonical_url", "<link rel=canonical href=urn:y>", [record("canonical_url", "urn:y")]),
    ("canonical_url", '<link rel="Canonical" href="/c">', []),
    ("images", "<img alt='A hip' src=hip.webp><img src=?w=9><img src='data:,'><img alt=x>",
     [record("image", f"{SITE}/beds/hip.webp", "A hip"), record("image", f"{PAGE}?w=9", "")]),
    ("images", "<base href=https://pics.test/2/><img src=3.gif alt='\tbud\n'>", [record("image", "https://pics.test/2/3.gif", "bud")]),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, PAGE, html) for i, (_, html, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def by_page(df):
    found = {}
    for row in df.orderBy("page_id", "ord").collect():
        found.setdefault(row.page_id, []).append(row)
    return found


@pytest.mark.parametrize("field", FIELDS)
def test_extractor(spark, pages, field):
    got = by_page(ex.extract_records(pages, [field]))
    for i, (case_field, html, expected) in enumerate(CASES):
        if case_field == field:
            rows = got.get(i, [])
            assert [(r.type, r.value, r.text, r.level) for r in rows] == expected, html
            assert all(r.source_url == PAGE for r in rows)
            assert [r.ord for r in rows] == list(range(len(rows)))


def table_rows(spark, html):
    df = spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")
    return [
        (r.table_index, r.row_index, r.value, r.table_headers)
        for r in ex.extract_tables(df).orderBy("ord").collect()
    ]


def test_tables(spark):
    heads = "Crop | Row cm"
    assert table_rows(spark, SOWING) == [(0, 0, "Beet | 30", heads), (0, 1, "Leek & kin | 2535", heads)]
    assert table_rows(spark, SOWING + "<p>x</p><table><tr><td>dill</table>") == [
        (0, 0, "Beet | 30", heads), (0, 1, "Leek & kin | 2535", heads), (1, 0, "dill", None)]
    assert table_rows(spark, "<table><tr><td>\n<td>&nbsp;</tr><tr><td>kale</td></tr></table>") == [(0, 1, "kale", None)]
    assert table_rows(spark, "<table><tr><td></td><td>x</td></tr></table>") == [(0, 0, " | x", None)]
    assert table_rows(spark, "<p>none</p>") == []


def test_wide_headers_of_a_long_table_are_held_once(spark):
    head = "".join(f"<th>column number {i}</th>" for i in range(2_000))
    html = f"<table><tr>{head}</tr>" + "<tr><td>1</td></tr>" * 20_000 + "</table>"
    df = spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")
    found = ex.extract_tables(df).agg(F.count("*").alias("n"), F.min(F.length("table_headers")).alias("least"), F.max("row_index").alias("last")).first()
    assert (found.n, found.last) == (20_000, 19_999) and found.least > 30_000


def test_nested_and_unclosed_tables(spark):
    nested = "<table><tr><th>H</th><td>o<table><tr><td>i</td></tr></table></td></tr></table>"
    assert table_rows(spark, nested) == [(0, 0, "oi | i", "H"), (0, 1, "i", "H"), (1, 0, "i", None)]
    unclosed = "<table><tr><td>A<td>B<tr><td>C</table>"
    assert table_rows(spark, unclosed) == [(0, 0, "ABC | BC | C", None), (0, 1, "C", None)]


def test_all_fields_in_emission_order(spark):
    df = spark.createDataFrame([(1, PAGE, LEAFLET)], "page_id long, url string, html string")
    out = ex.extract_records(df)
    assert tuple(out.columns) == RECORD_COLUMNS
    got = [(r.ord, r.type, r.value) for r in out.orderBy("ord").collect()]
    assert got == [
        (0, "title", "Roses"), (1, "meta_keywords", "prune, feed"), (2, "heading", "Pruning"), (3, "heading", "In spring"),
        (4, "paragraph", "Cutabovea bud."), (5, "paragraph", "Burn what is ill,with care."),
        (6, "link", f"{SITE}/beds/tools.html#saw"), (7, "table_row", "Beet | 30"), (8, "table_row", "Leek & kin | 2535"),
    ]
    reordered = ex.extract_records(df, ["links", "title", "links"])
    assert [r.type for r in reordered.orderBy("ord").collect()] == ["title", "link"]


def test_field_selection_errors():
    with pytest.raises(ValueError):
        ex.select_fields([])
    with pytest.raises(ValueError):
        ex.select_fields(["title", "nope"])


def test_registered_extractor(spark):
    def bold():
        record = ex.slim_sql(type="'bold'", v0="n.t0", v1="n.t1")
        return f"transform({ex.tagged_sql('b')}, n -> {record})"

    ex.register("bold", ["b", "p"], bold)
    try:
        df = spark.createDataFrame([(1, PAGE, "<p>x<b>y</b></p>")], "page_id long, url string, html string")
        assert [(r.type, r.value) for r in ex.extract_records(df, ["bold", "paragraphs"]).collect()] == [
            ("paragraph", "xy"), ("bold", "y")]
    finally:
        del ex.EXTRACTORS["bold"]


def test_dedupe_inside_the_page(spark):
    long = "L" * 200
    html = (
        "<title>a</title><p>a</p><a href='/x'>1</a><p>a</p><p>b</p><a href='/x'>2</a>"
        f"<p>{long}</p><p>{long}</p><p>{long}x</p><h1>a</h1>"
    )
    df = spark.createDataFrame([(1, PAGE, html), (2, PAGE, html)], "page_id long, url string, html string")
    expected = [("title", "a", None), ("heading", "a", None), ("paragraph", "a", None), ("paragraph", "b", None),
                ("paragraph", long, None), ("paragraph", long + "x", None), ("link", f"{SITE}/x", "1")]
    got = by_page(ex.extract_records(df, dedupe=True))
    for page in (1, 2):
        assert [(r.type, r.value, r.text) for r in got[page]] == expected
        assert [r.ord for r in got[page]] == list(range(len(expected)))


def test_one_bad_page_fails_alone(spark):
    bad = "<p>x</p><![nonsense[<p>y</p>&#" + "9" * 5000 + ";"
    df = spark.createDataFrame([(1, PAGE, bad), (2, PAGE, LEAFLET), (3, PAGE, None)], "page_id long, url string, html string")
    batch = {r.page_id: r for r in ex.extract_batch(df, ["title", "links"], with_data=True).collect()}
    assert not batch[1].success and batch[1].error and batch[1].record_count == 0
    assert batch[2].success and batch[2].record_count == 2 and [d.type for d in batch[2].data] == ["title", "link"]
    assert not batch[3].success and batch[3].record_count == 0 and batch[3].error == "page without markup"
    warnings = ex.extract_warnings(df, ["title", "links"]).collect()
    assert sorted(w.message.split(":")[0] for w in warnings) == ["links", "links", "title", "title"]
    assert all("extraction failed — " in w.message for w in warnings)
    records, messages = ex.flatten_batch(ex.extract_batch(df, ["title", "links"], with_data=True))
    assert [r.type for r in records.orderBy("ord").collect()] == ["title", "link"]
    assert [m.message.startswith(PAGE + ": ") for m in messages.collect()] == [True, True]


def test_warnings_that_pages_bring_along(spark):
    rows = [(1, PAGE, "<title>a</title>", ["first", "second"]), (2, PAGE, None, ["third"]), (3, PAGE, "<p>b</p>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, warnings array<string>")
    batch = ex.extract_batch(df, ["title"], with_data=True)
    assert {r.page_id: (r.success, r.warnings) for r in batch.collect()} == {1: (True, ["first", "second"]), 2: (False, ["third"]), 3: (True, [])}
    _, messages = ex.flatten_batch(batch)
    assert sorted((m.page_id, m.message) for m in messages.collect()) == [
        (1, "first"), (1, "second"), (2, f"{PAGE}: page without markup"), (2, "third")]


def test_nodes_and_containment(spark):
    df = spark.createDataFrame([(1, PAGE, "<p>a<a href='/x'>b</a></p><p>c</p>")], "page_id long, url string, html string")
    got = [(r.node_id, r.end_id, r.tag, r.attrs, r.text) for r in nodes(df).orderBy("node_id").collect()]
    assert got == [(0, 1, "p", {}, "ab"), (1, 1, "a", {"href": "/x"}, "b"), (2, 2, "p", {}, "c")]


def test_deeply_nested_unclosed_paragraphs(spark):
    html = "<p>x" * 3000
    df = spark.createDataFrame([(1, PAGE, html)], "page_id long, url string, html string")
    row = ex.extract_paragraphs(df).agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).first()
    assert (row.n, row.chars) == (3000, 3000 * 3001 // 2)


def test_site_header(spark):
    rows = [(1, "https://User@Sub.Example.com:8080/x", "<title>T</title><title>U</title>"), (2, "nonsense", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.title, r.hostname, r.favicon_url) for r in ex.site_header(df).collect()}
    assert got == {1: ("T", "sub.example.com", "https://sub.example.com/favicon.ico"), 2: (None, "", None)}


def test_page_nodes_in_sql(spark):
    from pagemill.functions.page_nodes import register_page_nodes

    register_page_nodes(spark)
    df = spark.createDataFrame([(1, PAGE, "<h1>a</h1><p>b</p>"), (2, PAGE, None)], "page_id long, url string, html string")
    sql = "SELECT p.page_id, n.tag, n.text, n.error FROM {df} p, LATERAL page_nodes(p.url, p.html%s) n ORDER BY 1, 2"
    every = [tuple(r) for r in spark.sql(sql % "", df=df).collect()]
    assert every == [(1, "h1", "a", None), (1, "p", "b", None), (2, None, None, "page without markup")]
    assert [r.tag for r in spark.sql(sql % ", 'p'", df=df).collect()] == ["p", None]


def test_nested_rows_within_and_over_the_budget(spark):
    """A page of unclosed rows is an error of its own when its records would come to too much text."""
    rows = [(1, "http://a.example/", "<table>" + "<tr><td>1" * 60 + "<p>after"), (2, "http://a.example/", "<table>" + "<tr><td>1" * 60_000),
            (3, "http://a.example/", "<tr><td>" * 20_000), (4, "http://a.example/", "<table>" + "<tr><td>1</td></tr>" * 20_000 + "</table>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    batch = {r.page_id: r for r in ex.extract_batch(pages, ["tables", "paragraphs"]).collect()}
    assert [batch[i].success for i in (1, 2, 3, 4)] == [True, False, False, True]
    assert batch[1].record_count == 61 and batch[4].record_count == 20_000
    found = ex.extract_records(pages.filter("page_id = 1"), ["tables"]).orderBy("row_index").collect()
    assert found[58].value == "11after | 1after" and found[59].value == "1after"
    assert "limit" in batch[2].error and batch[2].record_count == 0


def test_a_failing_extractor_is_one_warning(spark):
    def words(url, elements):
        return [{"type": "words", "value": str(len(e["text"].split())), "row_index": 1 // len(e["text"])} for e in elements]

    ex.register_function("words", ["p"], words)
    ex.register("caption", ["img"], lambda: f"transform({ex.tagged_sql('img')}, n -> {ex.slim_sql(type=repr('alt'), value='n.attrs[' + repr('alt') + ']')})",
                     failure=lambda: f"CASE WHEN exists({ex.tagged_sql('img')}, n -> n.attrs['alt'] IS NULL) THEN 'image without text' END")
    try:
        rows = [(1, "http://a.example/", "<title>A</title><p>one two</p><img alt=x>"), (2, "http://b.example/", "<title>B</title><p></p><p>one</p><img>"), (3, "http://c.example/", None)]
        pages = spark.createDataFrame(rows, "page_id long, url string, html string")
        fields = ["title", "words", "caption"]
        found = {(r.page_id, r.type, r.value) for r in ex.extract_records(pages, fields).collect()}
        assert found == {(1, "title", "A"), (1, "words", "2"), (1, "alt", "x"), (2, "title", "B")}
        said = {(r.page_id, r.message) for r in ex.extract_warnings(pages, fields).collect()}
        second = {(2, "caption: extraction failed — image without text"), (2, "words: extraction failed — integer division or modulo by zero")}
        assert said == second | {(3, f"{f}: extraction failed — page without markup") for f in fields}
        batch = {r.page_id: r for r in ex.extract_batch(pages, fields).collect()}
        assert {(2, w) for w in batch[2].warnings} == second and batch[2].success and batch[1].warnings == [] and not batch[3].success
    finally:
        del ex.EXTRACTORS["words"], ex.EXTRACTORS["caption"]
