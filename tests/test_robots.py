from __future__ import annotations

import pytest

from linkloom.operators import robots

SIMPLE = "\n\t\tUser-agent: *\n\t\tDisallow: /admin/\n\t\tDisallow: /private/\n\t\tCrawl-delay: 2\n\t\t"
RICH = (
    "User-agent: otherbot\r\nDisallow: /\r\n\r\n"
    "Sitemap: https://h/s.xml\r\nUSER-AGENT: crawl\r\nUser-agent: third\r\n"
    "Allow: /same\r\nDisallow: /same\r\nDisallow: /a*b/c*d$\r\nDisallow: /*.pdf$ # files\r\n"
    "Disallow: /dir/\r\nAllow: /dir/open\r\nDisallow:\r\nDisallow: /f%C3%BCr\r\nCrawl-delay: 0.5\r\n"
    "User-agent: crawler\rDisallow: /only-longer-name\r"
    "User-agent: *\nDisallow: /star\n"
)


def verdicts(spark, body, agent, paths, status=200):
    texts = spark.createDataFrame([("h.com", status, body)], "domain STRING, status_code INT, body STRING")
    hosts = robots.rules_by_host(robots.parse_robots(texts, agent))
    urls = spark.createDataFrame([(i, f"https://H.com:8080{p}") for i, p in enumerate(paths)], "i INT, url STRING")
    rows = robots.check_urls(urls, hosts).orderBy("i").collect()
    return [r["allowed"] for r in rows], {r["crawl_delay"] for r in rows}


def test_fallback_group(spark):
    assert verdicts(spark, SIMPLE, "AnyBot", ["/admin/dashboard", "/blog/article", "/admin", ""]) == (
        [False, True, True, True], {2.0}
    )


def test_own_group_and_precedence(spark):
    paths = {
        "/same": True, "/a1b/c2d": False, "/ab/cd": False, "/a1b/c2d/e": True, "/ab/c": True, "/x/y.pdf": False,
        "/x/y.pdf?q": False, "/x/y.pdfs": True, "/dir/x": False, "/dir/open/x": True, "/f%c3%bcr/x": False,
        "/für": False, "/star": True, "/only-longer-name": True, "/": True, "/?q=/dir/": True,
    }
    allowed, delay = verdicts(spark, RICH, "CRAWL/1.0", list(paths))
    assert dict(zip(paths, allowed)) == paths
    assert delay == {0.5}


def test_longest_agent_name_wins(spark):
    assert verdicts(spark, RICH, "crawlerX", ["/only-longer-name", "/dir/x"])[0] == [False, True]
    assert verdicts(spark, RICH, "unknown", ["/star", "/dir/x"])[0] == [False, True]


@pytest.mark.parametrize("status", [404, 500, 301])
def test_no_rules_without_a_good_response(spark, status):
    assert verdicts(spark, SIMPLE, "AnyBot", ["/admin/x"], status) == ([True], {0.0})


def test_other_hosts_and_bad_urls_are_allowed(spark):
    texts = spark.createDataFrame([("h.com", 200, SIMPLE)], "domain STRING, status_code INT, body STRING")
    hosts = robots.rules_by_host(robots.parse_robots(texts, "x"))
    urls = spark.createDataFrame([("https://other/admin/",), ("/admin/x",), ("",)], "url STRING")
    assert {r["allowed"] for r in robots.check_urls(urls, hosts).collect()} == {True}


def test_group_without_rules_keeps_its_delay(spark):
    assert verdicts(spark, "User-agent: *\nDisallow:\nCrawl-delay: 3", "x", ["/a"]) == ([True], {3.0})


def test_long_text_is_read_whole(spark):
    long = "User-agent: *\n" + "#" * (2 << 20) + "\nDisallow: /last\n"
    assert verdicts(spark, long, "x", ["/last/x", "/other"])[0] == [False, True]
    texts = spark.createDataFrame([("h", 200, long)], "domain STRING, status_code INT, body STRING")
    assert robots.parse_robots(texts, "x", max_bytes=1 << 20).count() == 0


def test_malformed_urls_are_allowed(spark):
    texts = spark.createDataFrame([("h.com", 200, "User-agent: *\nDisallow: /admin/\nCrawl-delay: 2")], "domain STRING, status_code INT, body STRING")
    hosts = robots.rules_by_host(robots.parse_robots(texts, "x"))
    urls = spark.createDataFrame([("https://h.com/admin/%zz",), ("https://h.com:x/admin/a",), ("https://h.com/admin/a",)], "url STRING")
    got = [(r["allowed"], r["crawl_delay"]) for r in robots.check_urls(urls, hosts).collect()]
    assert sorted(got) == [(False, 2.0), (True, 0.0), (True, 0.0)]


def test_many_stars_stay_fast(spark):
    body = "User-agent: *\nDisallow: /" + "*a" * 40 + "*b$"
    assert verdicts(spark, body, "x", ["/" + "a" * 3000, "/" + "a" * 3000 + "b"])[0] == [True, False]


def test_a_hot_host_is_split(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in settings if k != "spark.sql.adaptive.autoBroadcastJoinThreshold"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        urls = spark.range(0, 40_000, 1, 8).selectExpr(
            "concat('https://', if(id % 2 = 0, 'hot', concat('h', id)), '.com/admin/', id, uuid()) AS url"
        )
        texts = spark.createDataFrame([("hot.com", 200, SIMPLE)], "domain STRING, status_code INT, body STRING")
        tested = robots.check_urls(urls, robots.rules_by_host(robots.parse_robots(texts, "x")))
        counted = tested.selectExpr("allowed", "crawl_delay")
        rows = counted.collect()
        assert sum(not r["allowed"] for r in rows) == 20_000 and len(rows) == 40_000
        assert "skew=true" in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
