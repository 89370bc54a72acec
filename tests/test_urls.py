from __future__ import annotations

import random
from urllib.parse import urljoin, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from linkloom.functions import urls

ARTICLE = "https://example.com/blog/article1"

CASES = [
    # base, href, canonical form (None: rejected)
    (ARTICLE, "/about", "https://example.com/about"),
    (ARTICLE, "https://EXAMPLE.COM/page#section", "https://example.com/page"),
    (ARTICLE, "javascript:void(0)", None),
    (ARTICLE, "mailto:test@example.com", None),
    (ARTICLE, "../contact", "https://example.com/contact"),
    (ARTICLE, "", None),
    (ARTICLE, "#top", ARTICLE),
    (ARTICLE, "?", ARTICLE + "?"),
    (ARTICLE, "?q=/../x", ARTICLE + "?q=/../x"),
    (ARTICLE, "//h:443/x", "https://h/x"),
    (ARTICLE, "http://h:80", "http://h"),
    (ARTICLE, "http://h:8080/", "http://h:8080/"),
    (ARTICLE, "http://a:/", "http://a:/"),
    (ARTICLE, "http:foo?x", "http:foo?x"),
    (ARTICLE, "http:/foo", "http:/foo"),
    (ARTICLE, "http:///foo", "http:///foo"),
    (ARTICLE, "ftp://h/x", None),
    (ARTICLE, "JAVASCRIPT:x", None),
    (ARTICLE, "/für,x", "https://example.com/f%C3%BCr,x"),
    (ARTICLE, "/a!ü'(x)", "https://example.com/a%21%C3%BC%27%28x%29"),
    (ARTICLE, "/a!'(x)", "https://example.com/a!'(x)"),
    (ARTICLE, "/a b%2fc%41%ff", "https://example.com/a%20b/cA%FF"),
    (ARTICLE, "/x%2fy%7e", "https://example.com/x%2fy%7e"),
    (ARTICLE, "/bad%zz", None),
    (ARTICLE, "/x#%zz", None),
    (ARTICLE, "/x?%zz", "https://example.com/x?%zz"),
    (ARTICLE, "1a:b", None),
    (ARTICLE, ":x", None),
    (ARTICLE, "./a:b", "https://example.com/blog/a:b"),
    (ARTICLE, "http://u:p@h/", "http://u:p@h/"),
    (ARTICLE, "http://u!:p:q@h/", "http://u%21:p%3Aq@h/"),
    (ARTICLE, "http://u q@h/", None),
    (ARTICLE, "http://[::1]:80/", "http://[::1]/"),
    (ARTICLE, "http://[::1]:81/", "http://[::1]:81/"),
    (ARTICLE, "http://[::1", None),
    (ARTICLE, "http://BÜCHER.de/", "http://b%C3%BCcher.de/"),
    (ARTICLE, "http://a b/", None),
    (ARTICLE, "http://a:x/", None),
    (ARTICLE, "\u00a0/x\u3000", "https://example.com/x"),
    (ARTICLE, "/a\nb", None),
    (ARTICLE, "///x", "https://example.com///x"),
    (ARTICLE, "/a/b/../../../c/.", "https://example.com/c/"),
    (ARTICLE, "/.hidden", "https://example.com/.hidden"),
    ("http://h", "x", "http://h/x"),
    ("http://h", "../x", "http://h/x"),
    ("http://h?q", "", None),
    ("http://h/a?q", "#", "http://h/a?q"),
    ("http://bad host/", "/x", None),
    ("http://bad host/", "https://h/x", None),
    ("HTTP://U@H:80/p", "/%7e", "http://U@h/%7e"),
]

RFC_BASE = "http://a/b/c/d;p?q"
RFC = {
    "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", ".": "http://a/b/c/", "./": "http://a/b/c/",
    "..": "http://a/b/", "../": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/",
    "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "./g/.": "http://a/b/c/g/",
    "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y",
    "g?y/../x": "http://a/b/c/g?y/../x", "g:h": None,
}


def canonical(spark, pairs):
    """Canonical forms by the column and by the array expression, which must agree."""
    rows = [(i, base, href) for i, (base, href) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i INT, base STRING, href STRING")
    out = df.select(
        "i", urls.canonical_url("href", "base").alias("one"), urls.canonical_urls("array(href)", "base").alias("all")
    ).orderBy("i").collect()
    for row in out:
        assert row["all"] == ([] if row["one"] is None else [row["one"]])
    return [row["one"] for row in out]


def test_cases(spark):
    got = canonical(spark, [(base, href) for base, href, _ in CASES])
    assert [(c[1], g) for c, g in zip(CASES, got)] == [(c[1], c[2]) for c in CASES]


def test_rfc_examples(spark):
    got = canonical(spark, [(RFC_BASE, href) for href in RFC])
    assert dict(zip(RFC, got)) == RFC


def model(base: str, href: str) -> str:
    """Canonical form of a clean reference by the standard library."""
    joined = urlsplit(urljoin(base, href))
    host = joined.netloc.lower()
    port = {"http": ":80", "https": ":443"}[joined.scheme]
    # An absolute reference keeps its dot segments in urljoin; joining its path once more removes them.
    path = urlsplit(urljoin("http://h/", joined.path)).path
    return urlunsplit((joined.scheme, host.removesuffix(port), path, joined.query, ""))


def test_random_references_agree_with_the_standard_library(spark):
    pick = random.Random(7)
    segment = lambda: pick.choice(["a", "b-c", "x.html", "..", ".", "d~e", "k=v", "m,n", "..z"])

    def reference() -> str:
        path = "/".join(segment() for _ in range(pick.randint(1, 5)))
        kind = pick.randint(0, 3)
        if kind == 0:
            return "/" + path
        if kind == 1:
            return path if ":" not in path else "./" + path
        if kind == 2:
            return f"{pick.choice(['http', 'https'])}://Host{pick.randint(1, 9)}.example{pick.choice(['', ':80', ':443', ':81'])}/{path}"
        return path + pick.choice(["?q=1", "?a=b&c=d", "#frag", "?q#f"])

    bases = ["http://H.example/a/b/c.html?x=y", "https://h.example/", "https://h.example:443/d/"]
    pairs = [(pick.choice(bases), reference()) for _ in range(800)]
    assert canonical(spark, pairs) == [model(*p) for p in pairs]


def test_canonical_form_is_stable(spark):
    forms = [c[2] for c in CASES if c[2] and "://" in c[2] and "///" not in c[2][7:]]
    df = spark.createDataFrame([(f,) for f in forms], "url STRING")
    assert [r[0] for r in df.select(urls.canonical_self("url")).collect()] == forms


@pytest.mark.parametrize(
    ("url", "hostname", "domain"),
    [
        ("https://User:p@Host.com:8080/x", "Host.com", "User:p@Host.com"),
        ("http://[::1]:81/", "::1", "[::1]"),
        ("http://[::1]/", "::1", "[:"),
        ("http://h?x:y/@z", "h", "h"),
        ("h.com/x", "", "h.com"),
        ("/p", "", ""),
        ("mailto:x@y", "", "mailto"),
    ],
)
def test_hosts(spark, url, hostname, domain):
    row = spark.createDataFrame([(url,)], "url STRING").select(
        urls.url_hostname(F.col("url")), urls.url_domain_text(F.col("url"))
    ).first()
    assert tuple(row) == (hostname, domain)


def test_sql_function(spark):
    urls.register_sql_functions(spark)
    df = spark.createDataFrame([(c[0], c[1]) for c in CASES], "base STRING, href STRING")
    df.createOrReplaceTempView("hrefs")
    got = spark.sql("SELECT canonicalize_url(href, base) AS u FROM hrefs").collect()
    assert [r["u"] for r in got] == [c[2] for c in CASES]
    called = df.select(F.call_function("canonicalize_url", "href", "base").alias("u")).collect()
    assert called == got


def test_staged_form_equals_the_expression(spark):
    hrefs = [
        "/a", "../b", "?q=1", "#f", "", " //H.org:80/x ", "HTTP://U:p@h.com:80/%7Eé/./..", "mailto:x", "javascript:1", "https://a.org/clean",
        "a:b", "%zz", "http://[::1]:80/", "//", "x//y", "HTTPS://é.com:443", "/p q/../r?x y#z", "http:opaque", "ftp://x/y", None, "..", "https://h:bad/",
    ]
    bases = ["https://Shop.Example.com:8443/a/b/c?v=2#z", "http://u@h.com", "nonsense", "", None, "https://x.org/%"]
    rows = spark.createDataFrame([(h, b, 7) for h in hrefs for b in bases], "href STRING, base STRING, url INT")
    got = urls.with_canonical_url(rows, "href", "base", "canonical").withColumn("expected", urls.canonical_url("href", "base"))
    assert got.columns == ["href", "base", "url", "canonical", "expected"]
    assert got.filter("NOT (canonical <=> expected)").collect() == [] and got.filter("canonical IS NOT NULL").count() > 30
