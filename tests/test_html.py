from __future__ import annotations

import random
from html.parser import HTMLParser

import pytest

from linkloom.functions import html

CASES = [
    ("<A HREF=/x>", ["/x"]),
    ("<a class=b href='/y&amp;z=1&copy=2&lt;&#233;&#x80;&notit;&eacute'>", ["/y&z=1&copy=2<é€&notit;é"]),
    ("<a href='&#0;&#xD800;&#x110000;&#65;&bogus;&'>", ["\ufffd\ufffd\ufffdA&bogus;&"]),
    ('<a title="a>b" href="/q">', ["/q"]),
    ('<!-- <a href="/no"> --><a href="/yes"/>', ["/yes"]),
    ('<script>"<a href=/no>"</script><a href=/s>', ["/s"]),
    ("<style><a href=/no></style >x<a href=/s2>", ["/s2"]),
    ("<textarea><a href=/no></textarea><TITLE><a href=/no></title>", []),
    ("<iframe><a href=/no></iframe><xmp><a href=/no></xmp><noscript><a href=/in>", ["/in"]),
    ("<script><a href=/n>", []),
    ("<a href=/1 href=/2>", ["/1", "/2"]),
    ('<a data-href="/no" title="href=/no">', []),
    ('<abbr href=/no><area href=/no><a\nhref = "/ok">', ["/ok"]),
    ('<a href="/unclosed><a href=/x', []),
    ("<a href><a href=''>", [""]),
    ('<base href="/b"><a href="c">', ["c"]),
    ("<!-->< a href=/no><a href=/v>", ["/v"]),
    ("<a =href=/n href=/m>", ["/m"]),
    ("<plaintext><a href=/no>", []),
    ("</a href=/no><a/href=/w>", ["/w"]),
    ('<!doctype "x><a href=/no>"><a href=/d>', ["/no", "/d"]),
    ("x < y <a href=/z><a href=/z>", ["/z"]),
    ("<a href=/a?b=c&d=e>", ["/a?b=c&d=e"]),
    ("plain text", []),
]


def hrefs(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i INT, html STRING")
    rows = df.select("i", html.extract_hrefs("html").alias("h")).orderBy("i").collect()
    return [r["h"] for r in rows]


def test_cases(spark):
    got = hrefs(spark, [page for page, _ in CASES])
    # An empty value is no link; it may be kept here and is dropped with the rejected links.
    assert [[h for h in g if h] for g in got] == [[h for h in want if h] for _, want in CASES]


class Model(HTMLParser):
    """Independent reader of the same pages."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v]


def test_random_pages_agree_with_the_standard_library(spark):
    pick = random.Random(3)
    parts = [
        '<a href="/{0}">t</a>', "<A class='x' HREF='/{0}?a=1&amp;b={0}'>", "<a href=/{0} id=q>", "<p title='<a href=/no>'>",
        "<!-- <a href=/c{0}> -->", "<script>var s='<a href=/s{0}>';</script>", "<style>a{{}}<a href=/t></style>", "text &lt; {0} ",
        "<br/>", "<a name=x>", "<div data-x=\"<a href='/n'>\">", '<a href="../{0}/é">', "</p>", "<a\n href\n=\n'/{0}'\n>",
    ]
    pages = ["".join(pick.choice(parts).format(pick.randint(0, 30)) for _ in range(pick.randint(1, 40))) for _ in range(200)]

    def want(page):
        model = Model()
        model.feed(page)
        model.close()
        return list(dict.fromkeys(model.found))

    assert hrefs(spark, pages) == [want(p) for p in pages]


def test_given_pages_agree_with_the_standard_library(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for page, got in zip(pages, hrefs(spark, pages)):
        model = Model()
        model.feed(page)
        assert set(got) == set(model.found)


def test_links_are_canonical_and_distinct(spark):
    page = "<a href=/a><a href='https://H.example/a#x'><a href=mailto:x><a href='b c'>"
    df = spark.createDataFrame([(page, "https://h.example/d/e"), (page, "http://bad host")], "html STRING, url STRING")
    got = [r[0] for r in df.select(html.extract_links("html", "url")).collect()]
    assert got == [["https://h.example/a", "https://h.example/d/b%20c"], []]


@pytest.mark.parametrize("filler", ['x="1" ', "<p>", "<!--" + "-" * 50 + "-->"])
def test_long_pages(spark, filler):
    page = "<a " + 'y=2 ' * 20000 + 'href="/big">' + filler * 50000 + "<a href=/end>"
    assert hrefs(spark, [page])[0][0] == "/big"
