"""Responses, hosts, robots and chains on small tables."""

import random
import urllib.robotparser
from urllib.parse import urlparse

from pyspark.sql import Row

from pagemill.functions.refresh import meta_refresh_target
from pagemill.operators import chains, hosts, responses, robots

FX = "url string, status int, content_type string, location string, body binary"


def test_content_types_sizes_and_charsets(spark):
    rows = [
        ("u8", 200, "text/html; charset=utf-8", None, "<title>Héllo</title>".encode()),
        ("xhtml", 200, "application/xhtml+xml; charset=utf-8", None, b"<title>X</title>"),
        ("pdf", 200, "application/pdf", None, b"%PDF"),
        ("json", 200, "application/json", None, b"{}"),
        ("none", 200, None, None, b"x"),
        ("latin", 200, "text/html; charset=windows-1252", None, "thé €”".encode("cp1252")),
        ("undefined", 200, "text/html; charset=CP1252", None, b"a\x81b"),
        ("iso", 200, "text/html", None, b"<META content=text/xml;charset=iso-8859-1 HTTP-EQUIV=content-type><p>th\xe9\x93"),
        ("meta", 200, " Text/HTML ; x", None, b'<meta charset="windows-1252">th\xe9'),
        ("sniffed", 200, "text/html", None, b"th\xe9"),
        ("plain", 200, "text/html", None, "é ok".encode()),
        ("bad8", 200, "text/html; charset=utf-8", None, b"a\xffb\xe2\x82c\xf0\x9f\x98"),
        ("ascii", 200, "text/html; charset=us-ascii", None, b"a\xe9b"),
        ("sjis", 200, "text/html; charset=shift_jis", None, "日本".encode("shift_jis")),
        ("unknown", 200, "text/html; charset=nope", None, "é".encode()),
        ("exact", 200, "text/html", None, b"a" * 100),
        ("over", 200, "text/html", None, b"a" * 101),
    ]
    df = spark.createDataFrame(rows, FX)
    got = {r.url: (r.html, r.encoding) for r in responses.decode_pages(df, 100).collect()}
    codec = {"u8": "utf-8", "xhtml": "utf-8", "latin": "windows-1252", "undefined": "CP1252", "iso": "iso-8859-1",
             "meta": "windows-1252", "sniffed": "windows-1252", "plain": "utf-8", "bad8": "utf-8", "ascii": "us-ascii",
             "sjis": "shift_jis", "unknown": "utf-8", "exact": "utf-8"}
    bodies = {r[0]: r[4] for r in rows}
    assert got == {u: (bodies[u].decode(c, "replace"), c) for u, c in codec.items()}
    refused = {r.url: r.message for r in responses.not_html(df).collect()}
    assert set(refused) == {"pdf", "json", "none"} and "'application/pdf'" in refused["pdf"]
    assert [r.url for r in responses.too_large(df, 100).collect()] == ["over"]
    left = {r.url: r.code for r in responses.refused_responses(df, 100).collect()}
    assert left == {u: "CONTENT_TYPE_UNSUPPORTED" for u in ("pdf", "json", "none")} | {"over": "RESPONSE_TOO_LARGE"}


def test_retries(spark):
    log = [("a", 0, 503, False), ("a", 1, 200, False), ("b", 0, 404, False), ("c", 0, None, True), ("c", 1, None, True)]
    df = spark.createDataFrame(log, "url string, attempt long, status int, transport_error boolean")
    got = {(r.url, r.attempt): (r.retryable, r.backoff_seconds) for r in responses.may_retry(df).collect()}
    assert got == {("a", 0): (True, 0.0), ("a", 1): (False, 0.5), ("b", 0): (False, 0.0), ("c", 0): (True, 0.0), ("c", 1): (False, 0.5)}
    assert {(r.url, r.attempt, r.status) for r in responses.final_attempt(df).collect()} == {("a", 1, 200), ("b", 0, 404), ("c", 1, None)}


def test_error_codes(spark):
    df = spark.createDataFrame([("ok",), ("blocked",), ("timeout",), ("what",)], "outcome string")
    got = {r.outcome: (r.code, r.http_status) for r in responses.classify_error(df).collect()}
    assert got == {"ok": (None, None), "blocked": ("SSRF_BLOCKED", 400), "timeout": ("TIMEOUT", 504), "what": ("INTERNAL_ERROR", 500)}


def test_meta_refresh_targets(spark):
    base = "https://garden.test/was"
    cases = {
        '<html><head><meta http-equiv="refresh" content="0; url=/moved"></head></html>': "https://garden.test/moved",
        '<meta http-equiv="refresh" content="5; url=https://seed.test/p">': "https://seed.test/p",
        "<META HTTP-EQUIV='Refresh' CONTENT='0;URL=next?x=1'>": "https://garden.test/next?x=1",
        '<html><head><title>stays</title></head></html>': None,
        '<meta http-equiv="refresh" content="0; url=#">': None,
        '<meta http-equiv="refresh" content="30">': None,
        "x" * 8192 + '<meta http-equiv="refresh" content="0; url=/late">': None,
    }
    df = spark.createDataFrame([(h, base) for h in cases], "html string, url string")
    assert {r.html: r.t for r in df.select("html", meta_refresh_target("html", "url").alias("t")).collect()} == cases


def test_blocked_hosts(spark):
    rows = [("pub.example", "198.41.0.4"), ("mixed.example", "8.8.8.8"), ("mixed.example", "10.1.2.3"), ("Odd.example", "?"), ("six.example", "2606:2800::1")]
    addresses = spark.createDataFrame(rows, "host string, ip string")
    assert sorted(r.host for r in hosts.blocked_hosts(addresses).collect()) == ["mixed.example", "odd.example"]
    pages = spark.createDataFrame([(i, f"https://{h}/x") for i, h in enumerate(["pub.example", "mixed.example", "odd.example", "six.example", "unknown.example"])], "page_id long, url string")
    assert sorted(r.page_id for r in hosts.drop_blocked(pages, addresses).collect()) == [0, 3]
    assert sorted(r.page_id for r in hosts.drop_blocked(pages, addresses, unresolved_too=False).collect()) == [0, 3, 4]


def test_redirect_chains(spark):
    h = "https://example.com/"
    rows = [(h + f"r{i}", 302, f"/r{i + 1}") for i in range(1, 5)] + [
        (h + "r5", 200, None), (h + "a", 301, "b"), (h + "b", 308, "https://example.com/c"), (h + "c", 200, None), (h + "stop", 302, ""),
        (h + "in", 301, "http://shed.lan/keys"), ("http://shed.lan/x", 200, None), (h + "gone", 303, "/nowhere"),
        (h + "loop", 307, "/loop"), (h + "ok", 404, "/ignored"), (h + "null", 302, None), (h + "tostop", 302, "/stop")]
    df = spark.createDataFrame(rows, "url string, status int, location string")
    blocked = spark.createDataFrame([("shed.lan",)], "host string")
    got = {r.start_url.replace(h, ""): (r.final_url.replace(h, ""), r.hops, r.outcome) for r in chains.redirect_chain(df, blocked).collect()}
    assert got == {
        "r1": ("r4", 4, "too_many"), "r2": ("r5", 3, "ok"), "r3": ("r5", 2, "ok"), "r4": ("r5", 1, "ok"), "r5": ("r5", 0, "ok"),
        "a": ("c", 2, "ok"), "b": ("c", 1, "ok"), "c": ("c", 0, "ok"), "stop": ("stop", 1, "ok"), "tostop": ("stop", 2, "ok"),
        "in": ("http://shed.lan/keys", 1, "blocked"), "http://shed.lan/x": ("http://shed.lan/x", 0, "blocked"),
        "gone": ("nowhere", 1, "missing"), "loop": ("loop", 4, "too_many"), "ok": ("ok", 0, "ok"), "null": ("null", 1, "ok"),
    }
    unlimited = {r.start_url: r.outcome for r in chains.redirect_chain(df, max_hops=4).collect()}
    assert unlimited[h + "r1"] == "ok" and unlimited[h + "in"] == "missing"
    none = {r.start_url: (r.hops, r.outcome) for r in chains.redirect_chain(df, max_hops=0).collect()}
    assert none[h + "a"] == (1, "too_many") and none[h + "stop"] == (1, "too_many") and none[h + "c"] == (0, "ok")


def test_meta_refresh_chains(spark):
    def page(i, target):
        return (f"https://garden.test/s{i}", f'<meta http-equiv="refresh" content="0; url={target}">' if target else "<p>end</p>")

    rows = [page(i, f"https://garden.test/s{i + 1}") for i in range(5)] + [page(5, None)]
    got = {r.start_url[-1]: (r.final_url[-1], r.outcome) for r in chains.meta_refresh_chain(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {"0": ("3", "too_many"), "1": ("4", "too_many"), "2": ("5", "ok"), "3": ("5", "ok"), "4": ("5", "ok"), "5": ("5", "ok")}


LINES = ["User-agent: *", "User-agent: pagemill", "User-agent: other", "User-agent: mill", "Disallow: /", "Disallow: /a", "Allow: /a/b",
         "Allow: /", "Disallow:", "", "  ", "# c", "Disallow: /a/b # x", "Crawl-delay: 2", "Sitemap: http://x/y", "bad", "Disallow: /p%20q",
         "Disallow: /%zz", "Allow: *", "Disallow: /a?x=1", "User-agent:", "Disallow /a", "Disallow: http://z/a", "User-agent: PAGEmill/2"]
PATHS = ["/", "/a", "/a/b", "/a/b/c", "", "/private/x", "/q?a=1", "/café b", "/p q", "/p%20q/z", "/+x", "/%zz", "/a?x=1#f", "/a;x", "/ab+c?d=e&f"]


def test_robots_agree_with_the_standard_library(spark):
    rng = random.Random(11)
    files = {f"https://r{i}.ex": "\n".join(rng.choices(LINES, k=rng.randint(0, 9))) for i in range(250)}
    urls = [(i * 100 + j, site + path) for i, site in enumerate(files) for j, path in enumerate(PATHS)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    table = spark.createDataFrame([(site, 200, body) for site, body in files.items()], "site string, status int, body string")
    got = {r.page_id: r.allowed for r in robots.robots_verdict(pages, table).collect()}
    for page_id, url in urls:
        parser = urllib.robotparser.RobotFileParser()
        parser.parse(files[f"https://{urlparse(url).netloc}"].splitlines())
        assert got[page_id] == parser.can_fetch(robots.DEFAULT_AGENT, url), (files[f"https://{urlparse(url).netloc}"], url)


def test_robots_newest_usable_copy(spark):
    shut, free = "User-agent: *\nDisallow: /", "User-agent: *\nDisallow:"
    copies = [("https://a", 200, shut, 1), ("https://a", 503, free, 9), ("https://b", 200, free, 2), ("https://b", 200, shut, 1),
              ("https://c", 404, None, 5), ("https://c", 500, None, 6)]
    pages = spark.createDataFrame([(0, "https://a/x"), (1, "https://b/x"), (2, "https://c/x")], "page_id long, url string")
    table = spark.createDataFrame(copies, "site string, status int, body string, fetched_at long")
    got = {r.page_id: (r.allowed, r.warning) for r in robots.robots_verdict(pages, table).collect()}
    assert got[0] == (False, "") and got[1] == (True, "") and got[2][0] and "500" in got[2][1]
    assert [r.allowed for r in robots.robots_verdict(pages.limit(1), table.drop("fetched_at")).collect()] == [False]


def test_robots_fail_open(spark):
    table = spark.createDataFrame([("https://a", 404, "User-agent: *\nDisallow: /"), ("https://b", 500, None), ("https://c", None, None),
                                   ("https://d", 200, "User-agent: *\nDisallow: /shed/")], "site string, status int, body string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(["https://a/x", "https://b/x", "https://c/x", "https://e/x", "https://d/shed/key", "https://d/beds"])], "page_id long, url string")
    got = {r.page_id: (r.allowed, r.warning) for r in robots.robots_verdict(pages, table).collect()}
    assert [got[i][0] for i in range(6)] == [True, True, True, True, False, True]
    assert got[0][1] == "" and "500" in got[1][1] and got[2][1] and got[3][1] and got[4][1] == ""
    assert sorted(r.page_id for r in robots.robots_allowed(pages, table).collect()) == [0, 1, 2, 3, 5]


def test_rows(spark):
    assert responses.size_cap(spark.createDataFrame([Row(url="u", body=bytearray(b"ab"))]), 1).count() == 0
