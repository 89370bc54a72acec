from __future__ import annotations

import pytest

from linkloom.operators import robots
from linkloom.plans import crawl

LINKS = {
    # a cycle, a self-loop, a diamond (d at two depths), a dead link, an orphan
    "https://h/a": ["https://h/b", "https://h/c", "https://h/a"], "https://h/b": ["https://h/d", "https://h/a"],
    "https://h/c": ["https://h/b", "https://h/gone", "https://h/err"], "https://h/d": ["https://h/e"],
    "https://h/err": ["https://h/secret"], "https://h/orphan": ["https://h/a"], "https://h/e": [], "https://h/empty": ["https://h/x"],
}


def run(spark, seeds, hosts=None, small=crawl.SMALL_LEVEL_BYTES):
    captured = spark.createDataFrame(
        [(u, 500 if u.endswith("err") else 200, "", not u.endswith("empty")) for u in LINKS],
        "url STRING, status_code INT, error STRING, has_body BOOLEAN",
    )
    links = spark.createDataFrame([(s, d) for s, ds in LINKS.items() for d in ds], "src_url STRING, dst_url STRING")
    start = spark.createDataFrame(seeds, "url STRING, max_depth INT")
    return {r["url"][10:]: (r["depth"], r["outcome"]) for r in crawl.crawl(start, captured, links, hosts, small).collect()}


@pytest.mark.parametrize("small", [crawl.SMALL_LEVEL_BYTES, 0])
def test_least_depth(spark, small):
    assert run(spark, [("https://h/a", 9)], small=small) == {
        "a": (1, "200"), "b": (2, "200"), "c": (2, "200"), "d": (3, "200"), "gone": (3, "ERROR"), "err": (3, "ERROR"), "e": (4, "200")
    }


def test_depth_limits(spark):
    assert run(spark, [("https://h/a", 0)]) == {"a": (1, "SKIPPED")}
    assert run(spark, [("https://h/a", 1)]) == {"a": (1, "200")}
    assert run(spark, [("https://h/a", 2)]) == {"a": (1, "200"), "b": (2, "200"), "c": (2, "200")}
    # Each seed has its own limit; a URL seeded twice keeps the larger one.
    assert run(spark, [("https://h/d", 1), ("https://h/c", 1), ("https://h/c", 2)]) == {
        "c": (1, "200"), "d": (1, "200"), "b": (2, "200"), "gone": (2, "ERROR"), "err": (2, "ERROR")
    }


def test_a_seed_takes_no_results_from_another(spark):
    # a (limit 2) reaches b before d (limit 5) does, and must not stop it there
    links = {"https://h/a": ["https://h/x"], "https://h/b": ["https://h/y"], "https://h/y": ["https://h/x"], "https://h/x": ["https://h/z"], "https://h/z": []}
    captured = spark.createDataFrame([(u, 200, "", True, 7) for u in links], "url STRING, status_code INT, error STRING, has_body BOOLEAN, n_bytes INT")
    edges = spark.createDataFrame([(s, d) for s, ds in links.items() for d in ds], "src_url STRING, dst_url STRING")
    seeds = spark.createDataFrame([("https://h/a", 2), ("https://h/b", 5)], "url STRING, max_depth INT")
    for small in (crawl.SMALL_LEVEL_BYTES, 0):
        got = {r["url"][10:]: (r["depth"], r["status_code"], r["n_bytes"]) for r in crawl.crawl(seeds, captured, edges, None, small).collect()}
        assert got == {"a": (1, 200, 7), "b": (1, 200, 7), "x": (2, 200, 7), "y": (2, 200, 7), "z": (4, 200, 7)}


def test_a_skipped_seed_can_be_reached(spark):
    assert run(spark, [("https://h/b", 0), ("https://h/a", 2)])["b"] == (2, "200")


def test_pages_without_body_are_not_followed(spark):
    assert run(spark, [("https://h/empty", 5)]) == {"empty": (1, "200")}


def test_no_seeds(spark):
    assert run(spark, []) == {}


def test_robots_stop_the_walk(spark):
    texts = spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /b")], "domain STRING, status_code INT, body STRING")
    hosts = robots.rules_by_host(robots.parse_robots(texts, "bot"))
    got = run(spark, [("https://h/a", 9)], hosts)
    assert got["b"] == (2, "BLOCKED") and "d" not in got


def test_page_links(spark):
    pages = spark.createDataFrame([("https://h/a", "<a href=b><a href=/c#x><a href=mailto:x>"), ("https://h/n", "")], "url STRING, html STRING")
    assert {tuple(r) for r in crawl.page_links(pages).collect()} == {("https://h/a", "https://h/b"), ("https://h/a", "https://h/c")}


def chain(spark):
    links = spark.createDataFrame([("hub", f"p{i}") for i in range(300)] + [(f"p{i}", f"q{i}") for i in range(300)] + [(None, "x")], "src_url STRING, dst_url STRING")
    urls = ["hub", *[f"p{i}" for i in range(300)], *[f"q{i}" for i in range(200)]]
    captured = spark.createDataFrame([(u, 200, "", True) for u in urls], "url STRING, status_code INT, error STRING, has_body BOOLEAN")
    return spark.createDataFrame([("hub", 3)], "url STRING, max_depth INT"), captured, links


@pytest.mark.parametrize("rows_per_task", [10, 5_000_000])
def test_large_levels_with_a_hub(spark, rows_per_task):
    before = {t.name for t in spark.catalog.listTables()}
    found = crawl.crawl(*chain(spark), small_level_bytes=0, rows_per_task=rows_per_task)
    plain = crawl.crawl(*chain(spark))
    assert found.count() == 601 and found.exceptAll(plain).count() == 0
    assert found.filter("outcome = 'ERROR'").count() == 100
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_large_level_shuffles_only_itself(spark):
    _, captured, links = chain(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    made = crawl.Buckets()
    try:
        edges = crawl.Edges(links, made)
        sources = captured.select(captured["url"].alias("src_url"))
        found = edges.followed(sources)
        assert found.count() == 600
        text = found._jdf.queryExecution().executedPlan().toString()
        final = text.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in final
        assert made.of(links, "src_url").count() == 600  # the link without a source leads nowhere
    finally:
        made.close()
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_level_with_a_filter_needs_no_buckets(spark, monkeypatch):
    plain = crawl.crawl(*chain(spark))
    filtered = []
    candidates = crawl._candidates
    monkeypatch.setattr(crawl, "_candidates", lambda *a: filtered.append(a) or candidates(*a))
    monkeypatch.setattr(crawl.Buckets, "of", lambda *a: pytest.fail("buckets"))
    found = crawl.crawl(*chain(spark), small_level_bytes=8000)
    assert found.count() == plain.count() == 601 and found.exceptAll(plain).count() == 0
    assert len(filtered) == 3  # the pages and the links of the second level, the pages of the last
    for rows, key, urls, size in filtered:
        left = candidates(rows, key, urls, size)
        exact = rows.join(urls.select(urls["url"].alias(key)).distinct(), key, "left_semi")
        assert exact.exceptAll(left).count() == 0 and left.count() <= exact.count() + 20
    # a large last level is followed by nothing
    seeds, captured, links = chain(spark)
    last = crawl.crawl(seeds.withColumn("max_depth", seeds["max_depth"] - 2), captured, links, small_level_bytes=0)
    assert [tuple(r) for r in last.select("url", "depth", "outcome").collect()] == [("hub", 1, "200")]


@pytest.mark.parametrize("groups", [1, 1 << 16])
def test_hubs_are_exact_in_any_group(spark, monkeypatch, groups):
    monkeypatch.setattr(crawl, "SOURCE_GROUPS", groups)
    _, captured, links = chain(spark)
    made = crawl.Buckets()
    try:
        edges = crawl.Edges(links, made, rows_per_task=10)
        assert [r["src_url"] for r in edges.hubs.collect()] == ["hub"]
        assert edges.followed(captured.select(captured["url"].alias("src_url"))).count() == 600
    finally:
        made.close()
