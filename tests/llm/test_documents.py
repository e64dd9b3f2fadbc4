"""Main text, secrets, packing, decontamination and the pipeline: brute force and edges."""

import hashlib
import html as markup
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import grammar, packing, resampling, suffixes, tagpaths
from pagemill.llm.queries import QUERIES


def article_of(page):
    """What stands in the article element of the given pages, which is cut off on some."""
    own = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    body = re.sub(r"<[^>]*\Z", "", own[1].split("<footer>")[0])
    blocks = (markup.unescape(b.replace("<b>", "").replace("<br>", " ")) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def test_op3_gives_the_articles(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op3_tagpaths"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.text, r.url, r.n_chars) == (article_of(pages[r.page_id].html), pages[r.page_id].url, len(r.text))


OWN_PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="with-header">
<header id=top><h1>Our site</h1></header><nav><a href=/>start</a></nav>
<div class="cookie-banner">We use cookies, as everybody does; do you mind?</div>
<div id="content"><h1>Kettles &amp; pots</h1><p>A kettle, once filled, takes four
minutes.<p>A pot takes <em>longer</em>;<br>nobody knows why.</p><div class="ad">Buy kettles!</div>
<ul><li>copper<li>steel</ul><table><tr><td>one<td>two</table>
<section class="comments"><p>I disagree, strongly, and at great length, with all that was said above, and below.</p></section></div>
<aside>More pots</aside><form><p>Your name, please.</p><textarea>x</textarea></form><script>var a = "</p>";</script>
<footer>&copy; us</footer></body></html>"""


def test_op3_side_matter_goes():
    want = "Kettles & pots\nA kettle, once filled, takes four minutes.\nA pot takes longer; nobody knows why.\ncopper\nsteel\none\ntwo"
    assert tagpaths.main_text(OWN_PAGE) == want


def div_page(*sections, head="<h1>Kettles</h1>"):
    own = "".join(f"<div class=part>{''.join(f'<p>{p}</p>' for p in s)}</div>" for s in sections)
    return f"<html><body><div class=nav><a href=/>start</a> <a href=/b>more</a></div>{head}<div id=body>{own}</div><div class=footer>us, here.</div></body></html>"


LONG = ["A kettle, once filled, takes four minutes, and nobody, as far as we know, has asked why; so be it."] * 60
SHORT_ONE = ["A pot, which is wider, takes longer than a kettle does, and so it goes, day by day."]
SHORT_TWO = ["A pan, which is flat, takes less than either, as everybody knows; more of that below."]


@pytest.mark.parametrize("sections", [(SHORT_ONE, LONG, SHORT_TWO), (LONG, SHORT_ONE), (SHORT_ONE, SHORT_TWO, LONG), (SHORT_ONE, SHORT_TWO)])
@pytest.mark.parametrize("head", ["<h1>Kettles</h1>", "<div><h1>Kettles</h1><h2>and pots</h2></div>", ""])
def test_op3_div_sections_of_any_length_stay(sections, head):
    want = [x for x in re.split("<[^>]*>", head) if x] + [p for s in sections for p in s]
    assert tagpaths.main_text(div_page(*sections, head=head)) == "\n".join(want)


NOTICE = "By reading on, you agree to all terms, old and new, of this site; we store, share, and sell what you type, say, or think. " * 4
MENU = "<div><a href=/a>start</a> <a href=/b>more of it</a> <a href=/c>even more</a></div>"
TEASERS = "<div><div><a href=/x>Ten pans you need</a></div><div><a href=/y>Pots, again</a></div></div>"
PARAGRAPHS = [f"Kettle {k}, once filled, takes four minutes; nobody asked why." for k in range(9)]


def unnamed_page(kind):
    """(page, its text): no article, no telling names; the longest node is a notice."""
    p = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    halves = "".join(f"<div>{''.join(f'<p>{x}</p>' for x in part)}</div>" for part in (PARAGRAPHS[:2], PARAGRAPHS[2:]))
    text = "\n".join(["Kettles", *PARAGRAPHS])
    body = {
        "one": f"{MENU}<div>{NOTICE}</div><div><h1>Kettles</h1>{p}</div>{TEASERS}<div>us, 2001</div>",
        "after": f"{MENU}<div><h1>Kettles</h1>{p}</div>{TEASERS}<div>{NOTICE}</div>",
        "halves": f"{MENU}<div>{NOTICE}</div><div><h1>Kettles</h1>{halves}</div>{TEASERS}",
        "body": f"{MENU}<div>{NOTICE}</div><h1>Kettles</h1>{halves}{TEASERS}<div>us, 2001</div>",
        "menu inside": f"<div>{NOTICE}</div><div>{MENU}<h1>Kettles</h1>{halves}{TEASERS}</div>",
        "lead": f"{MENU}<div><h1>Kettles</h1><p>{PARAGRAPHS[0]}</p><div>{p.partition('</p>')[2]}</div>{TEASERS}</div><div>{NOTICE}</div>",
    }[kind]
    return f"<html><body>{body}</body></html>", text


@pytest.mark.parametrize("kind", ["one", "after", "halves", "body", "menu inside", "lead"])
def test_op3_selection_decides(kind, monkeypatch):
    page, text = unnamed_page(kind)
    assert tagpaths.main_text(page) == text
    monkeypatch.setattr(tagpaths, "selected", lambda elements, nodes: ([True] * len(nodes), [True] * len(nodes)))
    assert tagpaths.main_text(page) != text

    def longest(elements, nodes):
        own = [len(n.text) == max(len(m.text) for m in nodes) for n in nodes]
        return own, own

    monkeypatch.setattr(tagpaths, "selected", longest)
    assert tagpaths.main_text(page) != text


def test_op3_paths_have_no_depth_limit():
    deep = lambda n, inner: "<div>" * n + inner + "</div>" * n
    p = "".join(f"<p>{x}</p>" for x in PARAGRAPHS)
    menu = "<div><a href=/a>" + "<span>" * 9 + "start here, friends, and go on, if you like" + "</span>" * 9 + "</a></div>"
    assert tagpaths.main_text(deep(90, menu + f"<div>{NOTICE}</div>" + deep(2, p))) == "\n".join(PARAGRAPHS)


def test_op3_heading_beside_one_long_section():
    page = f"<body><div><div class=nav>a b</div><h1>Kettles</h1><div>{''.join(f'<p>{p}</p>' for p in LONG)}</div></div></body>"
    assert tagpaths.main_text(page) == "\n".join(["Kettles", *LONG])


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<!--", "</p>", "<script>x", "<nav>only</nav>", "<p", "<div class='ad'>x</div>"])
def test_op3_nothing_to_find(page):
    assert tagpaths.main_text(page) in ("", "<")


def test_op3_odd_markup_is_linear():
    for page in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "<p>y" * 500, '<a "' * 20_000, "<!--" * 30_000, "<li>" * 50_000 + "z"):
        tagpaths.main_text(page)


def test_op3_edges(spark):
    rows = [(1, None, "u", 3), (1, None, "u", 3), (None, "<p>a</p>", None, 4), (2, "<article><p>a&nbsp; b</p></article>", "u", 5)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text long")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in tagpaths.extracted(pages).collect())
    assert got == [(0, "a", 1), (1, "", 0), (1, "", 0), (2, "a b", 3)]
    assert tagpaths.extracted(pages.limit(0)).count() == 0


def plain_base(text):
    found = []
    for name in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(name[2]) >= 6:
            found.append((name.start(), 0, name.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_op4_base_against_plain_patterns(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_secrets"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert [s for s in r.spans.split(",") if not s.startswith("format")] == (told.split(",") if told else [""]) or r.spans.startswith("format")
    assert sum(r.n_hex for r in rows) > 0


def test_base_spans_of_odd_texts():
    given = random.Random(1)
    pieces = ["PassWord", "paſsword", "api_Key", "apikey", " : ", "='", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "\n", "token", ".-_=", '"']
    for _ in range(3000):
        text = "".join(given.choice(pieces) for _ in range(given.randrange(14)))
        assert grammar.base_spans(text) == plain_base(text)


def test_inferred_formats_find_unlabelled_credentials(spark):
    given = random.Random(2)
    hexes = lambda n: "".join(given.choice("0123456789abcdef") for _ in range(n))
    prose = " ".join("".join(given.choice(["th", "er", "in", "on", "an", "re"]) for _ in range(given.randrange(4, 9))) for _ in range(3000))
    rows = [(i, f"{prose[i * 40 : i * 40 + 300]} token = {hexes(40)} and so on") for i in range(200)]
    key = "".join(given.choice("0123456789abcdef") for _ in range(10)) + "A" + hexes(20)
    rows.append((999, f"see {hexes(11)}-{hexes(11)}_ here, or thereinonanre2therein"))
    formats = grammar.learn(spark.createDataFrame(rows, "doc_id long, text string"))
    _, found = grammar.scan(rows[-1][1], formats.value)
    assert len(found) == 1 and found[0][1].startswith("format_") and found[0][0] == 4
    assert formats.value.best(key)[1] > formats.value.best("thereinonanre2therein")[1]


def test_inferred_automaton_is_a_distribution():
    """Merged states of even-length strings of a and b keep even from odd."""
    given = random.Random(3)
    strings = ["".join(given.choice("ab") for _ in range(2 * given.randrange(1, 5))) for _ in range(3000)]
    made = grammar.inferred(strings)
    assert 1 < len(made) < 60
    assert all(sum(s.out.values()) + s.ends == s.n and s.out.keys() == s.next.keys() for s in made)
    assert grammar.log_likelihood(made, "abab") > grammar.log_likelihood(made, "aba") + 3
    assert grammar.inferred([]) and math.isfinite(grammar.log_likelihood(grammar.inferred(["ab"]), "zzz"))


def test_op4_edges(edges, empty):
    formats = grammar.learn(edges)
    rows = grammar.secrets(edges, formats).collect()
    assert len(rows) == edges.count()
    assert {(r.spans, r.base_sha256) for r in rows if r.doc_id in (3, 4, 5)} == {("", hashlib.sha256(b"").hexdigest())}
    assert grammar.secrets(empty, grammar.learn(empty)).count() == 0


def least_padding(histogram, buckets):
    """The padded size of the best borders, by trying all."""
    lengths, counts = zip(*histogram)
    best = {(0, 0): 0}
    for k in range(1, buckets + 1):
        for j in range(1, len(lengths) + 1):
            found = [best[k - 1, i] + sum(counts[i:j]) * lengths[j - 1] for i in range(j) if (k - 1, i) in best]
            if found:
                best[k, j] = min(found)
    return min(v for (k, j), v in best.items() if j == len(lengths))


@pytest.mark.parametrize("seed", range(40))
def test_borders_are_optimal(seed):
    given = random.Random(seed)
    lengths = sorted(given.sample(range(1, 400), given.randrange(1, 30)))
    histogram = [(n, given.choice([1, 1, 2, 50, 1000])) for n in lengths]
    buckets = given.randrange(1, 8)
    borders = packing.optimal_borders(histogram, buckets)
    assert len(borders) <= buckets and borders == sorted(set(borders)) and borders[-1] == lengths[-1]
    padded = sum(c * next(b for b in borders if b >= n) for n, c in histogram)
    assert padded == least_padding(histogram, buckets)


def packed_well(rows, budget=packing.BUDGET):
    batches = defaultdict(list)
    for r in rows:
        assert 0 <= r.padding == r.bucket_len - r.n_tokens
        batches[r.bucket, r.batch].append(r)
    for own in batches.values():
        length = own[0].bucket_len
        assert len(own) == 1 or len(own) * length <= budget
        assert sorted(r.place for r in own) == list(range(len(own)))
    full = defaultdict(list)
    for (bucket, batch), own in batches.items():
        full[bucket].append((batch, len(own) == max(1, budget // own[0].bucket_len)))
    for found in full.values():
        found.sort()
        assert [b for b, _ in found] == list(range(len(found))) and all(f for _, f in found[:-1])


def test_op5_against_brute_force(spark, sf, documents):
    rows = QUERIES["op5_packing"](spark, sf).collect()
    lengths = {r.doc_id: len([w for w in re.split(r"[ \t-\r]+", r.text) if w]) + 1 for r in documents.collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == lengths
    packed_well(rows)
    histogram = defaultdict(int)
    for n in lengths.values():
        histogram[n] += 1
    if max(histogram) <= packing.EXACT:
        short = [(n, c) for n, c in sorted(histogram.items())]
        assert sum(r.bucket_len for r in rows) <= min(least_padding(short[:60], 16), 1 << 60) + sum(n * c for n, c in short[60:]) + sum(r.padding for r in rows)


def test_op5_edges(edges, empty):
    for slot_rows in (2, 50_000):
        rows = packing.pack(edges, buckets=3, budget=200, slot_rows=slot_rows).collect()
        assert len(rows) == edges.count()
        assert all(r.n_tokens == 1 for r in rows if r.doc_id in (3, 4, 5))
        packed_well(rows, 200)
    assert packing.pack(empty).count() == 0


def test_length_bins_are_close(spark):
    n = [1, 2, 4095, 4096, 4097, 5000, 10**6, 10**9 + 7, 1 << 40]
    rows = spark.createDataFrame([(x,) for x in n], "n long").select("n", packing.length_bin(F.col("n")).alias("b")).collect()
    assert all(r.b == r.n for r in rows if r.n <= 4096) and all(0 <= r.n - r.b <= r.n / 2048 for r in rows)


def test_suffix_array_and_search():
    given = np.random.default_rng(4)
    for n, v, depth in ((1, 1, 1), (60, 2, 40), (300, 3, 7), (500, 90, 64), (400, 1, 100), (300, 1 << 22, 9)):
        codes = given.integers(0, v + 1, n)
        codes[-1] = 0
        order = suffixes.suffix_array(codes, depth)
        assert sorted(order.tolist()) == list(range(n))
        until = [codes[p : p + depth].tolist() for p in order]  # the order behind a border is of no use
        keys = [tuple(k[: k.index(0)]) if 0 in k else tuple(k) for k in until]
        assert keys == sorted(keys)


def plain_contamination(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, own in items:
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


def items_of(rows):
    return [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for i, t in rows if i is not None and t]


@pytest.mark.parametrize("block_words", [suffixes.BLOCK_WORDS, 60])
def test_op10_with_blocks_short_items_and_edges(spark, block_words, edges, empty):
    given = random.Random(6)
    vocabulary = [f"w{k}" for k in range(6)] + ["Été", "X"]
    make = lambda n: " ".join(given.choice(vocabulary) for _ in range(n))
    items = [(k, make(given.choice([3, 9, 10, 11, 25, 60]))) for k in range(30)] + [(90, ""), (91, None), (None, "w1 w2"), (92, "village knew why"), (93, "w1")]
    items += [(94, items[4][1]), (95, items[4][1].upper())]
    docs = [(k, make(given.randrange(0, 300)) + " " + (given.choice(items)[1] or "")) for k in range(40)] + [(None, items[3][1]), (None, items[3][1]), (7, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((k is None, k or 0), *plain_contamination(t, items_of(items))) for k, t in docs)
    rows = suffixes.contamination(frame, bench, block_words).withColumn("n_hit", suffixes.covered("ranges")).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_hit, list(r.items)) for r in rows) == want
    clean = sorted(str(r.text) for r in suffixes.decontaminated(frame, bench, block_words).collect())
    assert clean == sorted(str(t) for k, t in docs if not plain_contamination(t, items_of(items))[1])
    kept = suffixes.decontaminated(edges, bench, block_words)
    assert kept.columns == edges.columns and {r.doc_id for r in kept.collect()} >= {3, 4, 5, 6, 7, 8}
    assert suffixes.contamination(edges, bench.limit(0)).agg(F.sum(suffixes.covered("ranges"))).first()[0] == 0
    assert suffixes.contamination(empty, bench, block_words).count() == 0


@pytest.mark.parametrize("block_words", [suffixes.BLOCK_WORDS, 8])
def test_op10_items_without_id_hit_as_in_sql(spark, tmp_path, block_words, monkeypatch):
    import duckdb

    from pagemill.llm.queries import ORACLES

    passage = " ".join(f"p{k}" for k in range(14))
    items = [(None, passage), (None, "lone words"), (1, "p3 p4 p5"), (2, " ".join(f"q{k}" for k in range(12))), (None, None)]
    docs = [(1, "a b " + passage + " c"), (2, "some lone words here"), (3, "nothing at all"), (4, items[3][1] + " lone words"), (5, None), (None, passage)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(suffixes.contamination, "__defaults__", (block_words, True))
    got = {r.doc_id: tuple(r) for r in QUERIES["op10_decontaminate"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert got == {r[0]: r for r in db.execute(ORACLES["op10_decontaminate"]).fetchall()}
    assert [got[i][-1] for i in (1, 2, 3, 4, 5, None)] == [True, True, False, True, False, True]
    kept = corpus_pipeline.decontaminate(spark, spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5]


def test_longest_matches_and_long_texts(spark):
    given = random.Random(8)
    item = [f"i{k}" for k in range(70)]
    text = [f"d{given.randrange(500)}" for _ in range(5000)]
    text[100:115], text[3000:3061] = item[5:20], item[2:63]
    block = suffixes.TestBlock.of([("a", " ".join(item))])
    short = [b"x", *(w.encode() for w in item[20:31]), b"y"]
    for shard in (300, 1_000_000):
        (ranges, items, longest, at, which, there), none, (_, _, *other) = suffixes.searched([[w.encode() for w in text], [], short], block, shard)
        assert none[0] == [] and other == [11, 1, "a", 20]
        assert [(r["first"], r["past"]) for r in ranges] == [(100, 115), (3000, 3061)]
        assert (items, longest, at, which, there) == (["a"], 61, 3000, "a", 2)


def test_pipeline_stages(spark, sf, documents):
    """Each stage on what the one before kept: its decisions are those of its operator."""
    docs, bench = documents, spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "packing":
            assert sorted(r.doc_id for r in out.collect()) == sorted(before)
            break
        rows = {r.doc_id: r for r in out.collect()}
        assert out.columns == documents.columns and out.dtypes == documents.dtypes and out.count() == len(rows)
        if name == "quality_classifier":
            kept = {r.doc_id for r in resampling.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect() if r.kept}
            assert set(rows) == kept
        elif name == "line_dedup":
            assert set(rows) == set(before) and all(r.n_chars == len(r.text) for r in rows.values())
            seen = [" ".join(x.lower().split()) for r in rows.values() for x in r.text.split("\n") if x.split()]
            assert len(seen) == len(set(seen))
        elif name == "simhash_dedup":
            assert all(before[i] == r.text for i, r in rows.items())
        else:
            items = items_of([(r.item_id, r.text) for r in bench.collect()])
            assert set(rows) == {i for i, t in before.items() if not plain_contamination(t, items)[1]}
        docs = spark.createDataFrame(out.collect(), documents.schema)
    assert corpus_pipeline.run(spark, sf).count() == len(before)


def test_pipeline_on_an_empty_table(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
        if "bucket" in docs.columns:
            break


def test_what_is_broadcast_needs_no_package():
    """Workers without a copy of the package can read it."""
    import subprocess
    import sys
    import tempfile

    import numpy as np
    from pyspark import cloudpickle

    from pagemill.llm import bayes, grammar, resampling, suffixes

    made = [
        bayes.Model(["en"], np.zeros(1), np.zeros((2, 1))), grammar.Formats({}, []), suffixes.TestBlock.of([("a", "some words")]),
        resampling.Labels(np.zeros(1, np.int64), np.zeros(1, bool)), resampling.Ratios(np.zeros(2), np.zeros(2)),
    ]
    with tempfile.NamedTemporaryFile() as f:
        f.write(cloudpickle.dumps(made))
        f.flush()
        read = f"import pickle, sys; x = pickle.load(open({f.name!r}, 'rb')); assert len(x) == 5; assert 'pagemill' not in sys.modules"
        done = subprocess.run([sys.executable, "-c", read], cwd="/tmp", env={"PATH": "/usr/bin"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
