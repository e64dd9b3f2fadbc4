"""URL functions against the standard library, on generated and hand-picked references."""

import itertools
import random
from urllib.parse import urljoin, urlparse

import pytest

from pagemill.functions import hosts, urls

PAGE = "https://example.com/page"

BASES = [
    "https://e.x/a/./b/c", "https://e.x/a/../b", "http://e.x/a;p/b;q?r", "http://e.x/a?#f", "http://e.x/a?q#f#g", "http://e.x?q", "http://e.x#f", "http://e.x/.a/b",
    PAGE, "https://example.com", "http://h.example/a/b/c.html?q=1#f", "https://cdn.example.com/",
    "HTTP://Up.Example/X/", "https://u:p@h:81/a//b/../c;p/d;q?x#y", "rel/path/", "", "/rooted/x",
    "ftp://files/x/y", "http:///nohost/x", "https://[::1]:80/a", "https://[bad/a", "https://h;x/a",
    "  https://lead.example/a ", "https:foo/bar", "https:foo", "//net.example/x", "mailto:x",
]
REFS = [
    "a/.b", "../.x", "../a/.b", "x/..", "../", "../x?y#z", "x?y=/./", "a/.", "..x", "../..x", "%2e/x", "x//y?//z", "#a b",
    "../a:b", "../../x", "a/./b/", "../x//y", "x/y/z.html?a=1#f", "~u/", "@x", ".../x", "..;/x", "#a#b", "?", "#\x01",
    "", " ", "#section", "/about", "img/logo.png", "javascript:void(0)", "mailto:a@b.com", "tel:1",
    "JavaScript:x", " javascript:x", "https://other.com/page", "http://other.com/a/../b/./c",
    "//cdn.x/y?z", "?q=2", "?", "#", "x?", "x#", "../up", "../../../../up/x", "./here", ".", "..",
    "a/./b/../c", "/a/./b/../c/..", "/a//b", "a//b", "//", "///x", ";p", "x;p", "x;", "a/..;p", ";",
    "https:rel", "http:rel", "https:/rooted", "HTTPS://UP.example/Q", "HtTp://x", "ftp://f/x",
    "data:text/plain,x", "x:y", "1x:y", "a b/c d", "\tta\nb\r", "x\ty", "http://[bad", "http://]x/",
    "http://[::1]/p", "http://[zz]/p", "http://[v1.x]/p", "http://u@h/℀", "http://h℀/x",
    "http://／/x", "café/中", " /nbsp ", "%2e%2e/x", "x?a=b/../c", "x#a/../b",
    "?x;y", "a;b/c;d", "a:b/c", "./a:b", "http://h?x", "http://h#x", "http://h;p", "/;x", "//h;p/x",
    "...", "/...", "a/.../b", ".a", "a.", "/.well-known/x", "\x01http://x/y", "http://x\\y",
    "\x85x", " /y", "x ", "http://h:99999/x", "http://h/a;b;c", "/x;y/..",
]


def expected_resolve(href, base):
    if not href or href.startswith(("javascript:", "mailto:", "tel:")):
        return None
    try:
        joined = urljoin(base, href.strip())
        return joined if urlparse(joined).scheme in ("http", "https") else None
    except ValueError:
        return None


def generated(count):
    rng = random.Random(7)
    atoms = ["a", "b", ".", "..", "/", "//", "?", "#", ";", ":", "x=1", "http:", "https://h", "", " ", "é"]
    return ["".join(rng.choices(atoms, k=rng.randint(1, 7))) for _ in range(count)]


def test_resolve_url_agrees_with_the_standard_library(spark):
    pairs = list(itertools.product(REFS + generated(600), BASES))
    df = spark.createDataFrame(pairs, "href string, base string")
    rows = df.select("href", "base", urls.resolve_url("href", "base").alias("got")).collect()
    wrong = [
        (r.href, r.base, r.got, expected_resolve(r.href, r.base))
        for r in rows
        if r.got != expected_resolve(r.href, r.base)
    ]
    assert len(rows) == len(pairs)
    assert wrong == []


def test_absolute_redirect_keeps_any_scheme(spark):
    cases = [("/n", PAGE), ("ftp://x/y", PAGE), ("", PAGE), ("next?x=1", "http://h/a/b"), ("//o/x", PAGE)]
    df = spark.createDataFrame(cases, "location string, url string")
    got = [r.got for r in df.select(urls.absolute_redirect("location", "url").alias("got")).collect()]
    assert got == [urljoin(url, loc) for loc, url in cases]


def test_url_pieces(spark):
    samples = [u for u in REFS + BASES + generated(300)]
    df = spark.createDataFrame([(u,) for u in samples], "u string")
    rows = df.select(
        "u",
        urls.url_scheme("u").alias("scheme"),
        urls.url_netloc("u").alias("netloc"),
        urls.url_host("u").alias("host"),
        urls.url_site("u").alias("site"),
        urls.robots_url("u").alias("robots"),
    ).collect()
    for row in rows:
        try:
            parsed = urlparse(row.u)
        except ValueError:
            continue
        assert (row.scheme, row.netloc) == (parsed.scheme, parsed.netloc), row.u
        assert row.host == (parsed.hostname or ""), row.u
        assert row.site == f"{parsed.scheme}://{parsed.netloc}"
        assert row.robots == f"{parsed.scheme}://{parsed.netloc}/robots.txt"


def test_validate_url(spark):
    at_limit = "https://example.com/" + "a" * (2048 - len("https://example.com/"))
    cases = {
        "http://example.com": "",
        "https://example.com/path?q=1#anchor": "",
        "HTTPS://sub.domain.example.com/page": "",
        at_limit: "",
        at_limit + "a": "URL exceeds the maximum allowed length of 2048 characters.",
        "ftp://example.com": "URL scheme 'ftp' is not allowed. Only http and https are supported.",
        "file:///etc/passwd": "URL scheme 'file' is not allowed. Only http and https are supported.",
        "javascript:alert(1)": "URL scheme 'javascript' is not allowed. Only http and https are supported.",
        "//example.com": "URL scheme '(none)' is not allowed. Only http and https are supported.",
        "example.com": "URL scheme '(none)' is not allowed. Only http and https are supported.",
        "": "URL scheme '(none)' is not allowed. Only http and https are supported.",
        "https://": "URL is missing a host.",
        "http://[x": "URL could not be parsed.",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    for row in df.select("u", urls.validate_url("u").alias("v"),
                         urls.validate_batch_url("u").alias("b"),
                         urls.looks_like_url("u").alias("q"),
                         urls.is_safe_scheme("u").alias("s")).collect():
        message = cases[row.u]
        assert row.v.error_message == message
        assert row.v.valid == (message == "")
        assert row.v.error_code == ("" if message == "" else "INVALID_URL")
        batch_ok = len(row.u) <= 2048 and row.u.lower().startswith(("http:", "https:"))
        assert (row.b is None) == batch_ok
        assert row.q == (row.u.startswith(("http://", "https://")) and row.u != "https://" and len(row.u) <= 2048)
        assert row.s == row.u.lower().startswith(("http://", "https://"))


@pytest.mark.parametrize("blocked, ips", [
    (True, ["127.0.0.1", "127.0.0.2", "10.0.0.1", "172.16.0.1", "192.168.1.1", "169.254.169.254",
            "169.254.0.1", "0.0.0.1", "100.64.0.1", "::1", "fe80::1", "fc00::1", "fdff::", "febf::9",
            "0:0:0:0:0:0:0:1", "::0.0.0.1", "fe80::1%eth0", "nonsense", "", "1.2.3", "1.2.3.256",
            "01.2.3.4", "1::2::3", "1:2:3:4:5:6:7:8:9", "172.31.255.255", "100.127.0.9"]),
    (False, ["93.184.216.34", "8.8.8.8", "2606:2800:220:1:248:1893:25c8:1946", "172.32.0.0", "::2",
             "fec0::1", "100.128.0.1", "1::", "::ffff:10.0.0.1", "11.0.0.0"]),
])
def test_blocked_addresses(spark, blocked, ips):
    import ipaddress

    df = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    for row in df.select("ip", hosts.is_blocked_ip("ip").alias("b"),
                         hosts.is_ipv6("ip").alias("v6")).collect():
        assert row.b is blocked, row.ip
        try:
            version = ipaddress.ip_address(row.ip).version
        except ValueError:
            version = 0
        assert row.v6 == (version == 6), row.ip
