"""The queries of the check tool: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions import html, urls
from linkloom.operators import (
    archive,
    bloom,
    dedup,
    fetch,
    frontier,
    politeness,
    robots,
    telemetry,
)
from linkloom.operators.rows import per_element
from linkloom.plans import crawl, overview, tables
from linkloom.session import materialized, scratch_path
from linkloom.sources import listing, seeds, stores, warc, warc_format

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AGENT = "linkbot/1.0"
SIX_HOURS_US = 6 * 3600 * 1_000_000


def _on(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a query over one table under the name of its function."""

    def register(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[build.__name__] = lambda spark, sf_dir: build(tables.table(spark, sf_dir, name))
        return build

    return register


def _timed(rows: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as microseconds, which compare exactly."""
    for c in columns:
        rows = rows.withColumn(c, F.unix_micros(c))
    return rows


# --- pages: links and URLs ---------------------------------------------------------------------


@_on("pages")
def extract_links(pages: DataFrame) -> DataFrame:
    return tables.page_links(pages)


@_on("pages")
def page_link_counts(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.size(html.extract_links("html", "url")).cast("bigint").alias("links"))


@_on("pages")
def distinct_links(pages: DataFrame) -> DataFrame:
    return tables.page_links(pages).select("link").distinct()


@_on("pages")
def domain_counts(pages: DataFrame) -> DataFrame:
    return frontier.domain_counts(tables.page_links(pages).select(F.col("link").alias("url")).distinct())


@_on("pages")
def resolve_reference(pages: DataFrame) -> DataFrame:
    hrefs = per_element(pages, ["page_id", "url"], html.extract_hrefs("html"), "href", "pos")
    form = F.col("pos") % 5
    ref = (
        F.when(form == 0, F.col("href"))
        .when(form == 1, F.concat(F.lit(".."), "href"))
        .when(form == 2, F.concat(F.lit("."), "href"))
        .when(form == 3, F.concat(F.lit("../.."), "href"))
        .otherwise(F.expr("substr(href, 2)"))
    )
    refs = hrefs.withColumn("ref", ref)
    return refs.select("page_id", "pos", "ref", urls.resolved_path("ref", "url").alias("path"))


@_on("lineitem")
def canonicalize_url(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber")
    href = (
        F.when(n == 1, F.concat(F.lit("../p/"), "l_partkey"))
        .when(n == 2, F.concat(F.lit(" //CDN.Example.org:443/s/"), "l_suppkey", F.lit("?x=1#f ")))
        .when(n == 3, F.concat(F.lit("?page="), "l_partkey"))
        .when(n == 4, F.lit("#top"))
        .when(n == 5, F.concat(F.lit("HTTP://h.example.com:80/é/"), "l_partkey"))
        .when(n == 6, F.concat(F.lit("mailto:s"), "l_suppkey", F.lit("@example.com")))
        .otherwise(F.concat(F.lit("/p q/./x/../"), "l_partkey", F.lit("/..")))
    )
    base = F.concat(F.lit("https://Shop.Example.com:8443/a/b/"), "l_orderkey", F.lit("?v=2#z"))
    pairs = lineitem.select("l_orderkey", "l_linenumber", href.alias("href"), base.alias("base"))
    return urls.with_canonical_url(pairs, "href", "base", "url").select("l_orderkey", "l_linenumber", "url")


@_on("lineitem")
def href_filter(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber")
    href = (
        F.when(n == 1, F.concat(F.lit("javascript:go("), "l_partkey", F.lit(")")))
        .when(n == 2, F.concat(F.lit(" mailto:s"), "l_suppkey", F.lit("@example.com")))
        .when(n == 3, F.lit("  \t"))
        .when(n == 4, F.concat(F.lit("tel:"), "l_orderkey"))
        .when(n == 5, F.concat(F.lit("JAVASCRIPT:"), "l_partkey"))
        .when(n == 6, F.concat(F.lit("/p/"), "l_partkey"))
        .otherwise(F.lit("data:text/plain,x"))
    )
    rows = lineitem.select("l_orderkey", "l_linenumber", href.alias("href"))
    return rows.select("l_orderkey", "l_linenumber", urls.navigational("href").alias("navigational"))


def _host_variants(lineitem: DataFrame) -> DataFrame:
    n = F.col("l_linenumber")
    url = (
        F.when(n == 1, F.concat(F.lit("http://S"), "l_suppkey", F.lit(".Example.COM:80/X")))
        .when(n == 2, F.concat(F.lit("https://S"), "l_suppkey", F.lit(".Example.COM:443")))
        .when(n == 3, F.concat(F.lit("https://User:Pw@S"), "l_suppkey", F.lit(".Example.COM:8080/X?y#z")))
        .when(n == 4, F.concat(F.lit("http://S"), "l_suppkey", F.lit(".Example.COM:443?q")))
        .when(n == 5, F.concat(F.lit("http://S"), "l_suppkey", F.lit(".Example.COM#f")))
        .when(n == 6, F.concat(F.lit("https://[2001:DB8::"), F.col("l_suppkey") % 10, F.lit("]:443/X")))
        .otherwise(F.lit("/only/a/path"))
    )
    return lineitem.select("l_orderkey", "l_linenumber", url.alias("url"))


@_on("lineitem")
def normalize_host(lineitem: DataFrame) -> DataFrame:
    rows = _host_variants(lineitem)
    return rows.select("l_orderkey", "l_linenumber", urls.normalized_host("url").alias("host"))


@_on("lineitem")
def url_hostname(lineitem: DataFrame) -> DataFrame:
    rows = _host_variants(lineitem)
    return rows.select("l_orderkey", "l_linenumber", urls.url_hostname(F.col("url")).alias("hostname"))


@_on("lineitem")
def url_domain_text(lineitem: DataFrame) -> DataFrame:
    rows = _host_variants(lineitem)
    return rows.select("l_orderkey", "l_linenumber", urls.url_domain_text(F.col("url")).alias("domain"))


@_on("orders")
def seed_normalize(orders: DataFrame) -> DataFrame:
    form = F.col("o_orderkey") % 6
    url = (
        F.when(form == 0, F.concat(F.lit("  shop"), "o_custkey", F.lit(".example.com/o/"), "o_orderkey", F.lit("\t")))
        .when(form == 1, F.concat(F.lit("http://Shop"), "o_custkey", F.lit(".example.com")))
        .when(form == 2, F.lit("https://"))
        .when(form == 3, F.lit("   "))
        .when(form == 4, F.concat(F.lit("https://bad host"), "o_custkey", F.lit("/")))
        .otherwise(F.concat(F.lit("HTTP://x.example.com/"), "o_orderkey"))
    )
    requests = orders.select("o_orderkey", url.alias("url"), (F.col("o_orderkey") % 5 - 1).cast("int").alias("depth"))
    return seeds.normalize(requests).drop("url", "depth")


@_on("orders")
def seed_submit(orders: DataFrame) -> DataFrame:
    host = F.concat(F.lit("shop"), F.col("o_custkey") % 100, F.lit(".example.com/c/"), "o_custkey")
    requests = orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(host).alias("url"), F.lit(2).alias("depth")
    )
    seen = orders.filter("o_orderstatus = 'P'").select(F.concat(F.lit("https://"), host).alias("url"))
    return seeds.submit(requests, seen, "o_orderkey").select("o_orderkey", "accepted", "message", "log_status")


# --- frontier ----------------------------------------------------------------------------------


@_on("pages")
def frontier_dump(pages: DataFrame) -> DataFrame:
    rows = tables.frontier_rows(pages).withColumn("added_at", F.date_format("added_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return frontier.dump(rows)


@_on("pages")
def frontier_scan_status(pages: DataFrame) -> DataFrame:
    return _timed(frontier.scan(tables.frontier_rows(pages), frontier.CRAWLED, limit=500), "added_at")


@_on("pages")
def frontier_scan_domain(pages: DataFrame) -> DataFrame:
    rows = frontier.scan_domain(tables.frontier_rows(pages), "www.cheap-pills.example.com", frontier.QUEUED)
    return _timed(rows, "added_at")


@_on("pages")
def frontier_prefix_scan(pages: DataFrame) -> DataFrame:
    return _timed(frontier.scan_prefix(tables.frontier_rows(pages), "https://blog."), "added_at")


@_on("pages")
def frontier_lookup(pages: DataFrame) -> DataFrame:
    rows = frontier.lookup(pages.select("url"), tables.frontier_rows(pages))
    return rows.select("url", "found", "depth", "status")


@_on("pages")
def frontier_decode(pages: DataFrame) -> DataFrame:
    page = F.col("url")
    value = (
        F.when(page.contains("?page"), F.concat(F.lit('{"url":"'), "url"))
        .when(page.endswith("#top"), F.concat(F.lit('{"url":"'), "url", F.lit('","depth":"deep"}')))
        .when(page.endswith(".html"), F.concat(F.lit('{"depth":'), F.lit(2), F.lit(',"extra":[1],"url":"'), "url", F.lit('"}')))
        .otherwise(
            F.concat(F.lit('{"url":"'), "url", F.lit('","domain":"d","depth":1,"priority":2,"status":"QUEUED"}'))
        )
    )
    return frontier.decode(pages.select(value.alias("value"))).drop("added_at")


@_on("pages")
def domain_counts_status(pages: DataFrame) -> DataFrame:
    return frontier.domain_counts_with_status(tables.frontier_rows(pages), frontier.CRAWLED)


@_on("pages")
def frontier_upsert(pages: DataFrame) -> DataFrame:
    current = tables.frontier_rows(pages).select("url", "status", "depth", F.lit(0).cast("bigint").alias("version"))
    own = pages.select(urls.canonical_self("url").alias("url"), (F.col("page_id") + 1).alias("version"))
    changes = frontier.completed(own).withColumn("depth", F.lit(1))
    return frontier.upsert(frontier.queued(current), changes)


@_on("pages")
def frontier_buckets(pages: DataFrame) -> DataFrame:
    """The changes of ``frontier_upsert`` applied to a stored frontier, those of feed pages by an update of their own."""
    spark, path = pages.sparkSession, scratch_path(pages.sparkSession, "frontier")
    current = tables.frontier_rows(pages).select("url", "status", "depth", F.lit(0).cast("bigint").alias("version"))
    stores.create_frontier(frontier.queued(current), path)
    own = pages.select(urls.canonical_self("url").alias("url"), (F.col("page_id") + 1).alias("version"))
    changes = frontier.completed(own).withColumn("depth", F.lit(1))
    feeds = F.col("url").contains("utm_source")
    stores.update_frontier(spark, path, changes.filter(~feeds))
    stores.update_frontier(spark, path, changes.filter(feeds))
    return stores.read_frontier(spark, path).drop("bucket")


@_on("pages")
def frontier_push(pages: DataFrame) -> DataFrame:
    own = pages.select(urls.canonical_self("url").alias("url"))
    items = materialized(tables.frontier_items(pages).select("url", "seq", "depth"))
    blank = items.filter("depth = 2").select(F.lit("").alias("url"), "seq", "depth")
    spam = own.filter(F.col("url").contains("spam-farm"))
    return dedup.flag_pushed(items.unionByName(blank.distinct()), spam, ["url"], "seq")


@_on("lineitem")
def dedup_against_seen(lineitem: DataFrame) -> DataFrame:
    shop = tables.shop_urls(lineitem)
    fresh = shop.filter("l_returnflag <> 'R'").select("url").distinct()
    return dedup.not_seen(fresh, shop.filter("l_returnflag = 'R'"), ["url"])


@_on("events")
def session_dedup(events: DataFrame) -> DataFrame:
    """The first fetch of each URL in each session of its crawl; a session ends where the crawl is first found idle."""
    ticks = tables.ticks(events).withColumn("at_us", F.unix_micros("ts"))
    edges = telemetry.completions(ticks, "crawl", "at_us", "event_id", keep=["event_id"])
    log = tables.fetch_log(events).withColumn("crawl", F.concat(F.lit("crawl"), F.regexp_extract("domain", "^u([0-9]+)", 1)))
    placed = telemetry.with_session(log.select("crawl", "at_us", "event_id", "url"), edges, "crawl", "at_us", "event_id")
    first = dedup.first_per_key(placed, ["crawl", "session_start_us", "url"], ["at_us", "event_id"])
    return first.select("crawl", F.coalesce("session_start_us", F.lit(0)).alias("session_start_us"), "url", "event_id")


# --- robots, fetch, traversal ------------------------------------------------------------------


@_on("pages")
def robots_parse(pages: DataFrame) -> DataFrame:
    return robots.parse_robots(tables.robots_texts(pages), AGENT)


def _tested(pages: DataFrame) -> DataFrame:
    hosts = robots.rules_by_host(robots.parse_robots(tables.robots_texts(pages), AGENT))
    return robots.check_urls(tables.frontier_rows(pages).select("url", "domain", "depth"), hosts)


@_on("pages")
def robots_allowed(pages: DataFrame) -> DataFrame:
    return _tested(pages).select("url", "allowed", "crawl_delay")


@_on("pages")
def fetch_snapshot(pages: DataFrame) -> DataFrame:
    results = fetch.fetch(tables.frontier_rows(pages), tables.snapshot(pages))
    return results.select(
        "url", "depth", "status_code", "content_type", "n_bytes", "fetch_time_ns", "error",
    )


@_on("pages")
def fetch_outcome(pages: DataFrame) -> DataFrame:
    results = fetch.fetch(_tested(pages), tables.snapshot(pages))
    return results.select("url", "depth", fetch.outcome(2).alias("outcome"))


@_on("pages")
def robots_blocked(pages: DataFrame) -> DataFrame:
    blocked = _tested(pages).select(F.when(~F.col("allowed"), "BLOCKED").otherwise("").alias("outcome"))
    return telemetry.robots_blocked(blocked)


def _crawl_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl(*tables.site(spark, sf_dir)).select("url", "domain", "depth", "outcome")


QUERIES["crawl_reachable"] = _crawl_reachable


def _crawl_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site from a different seed limit for each region, and from its nations with another."""
    seeds, captured, links = tables.site(spark, sf_dir)
    region = F.regexp_extract("url", "([0-9]+)$", 1).cast("int")
    own = seeds.select("url", (region % 4 + 1).alias("max_depth"))
    nation = captured.filter(F.col("url").startswith("https://nation."))
    more = nation.select("url", (F.regexp_extract("url", "([0-9]+)$", 1).cast("int") % 3 + 1).alias("max_depth"))
    return crawl.crawl(own.unionByName(more), captured, links).select("url", "domain", "depth", "outcome")


QUERIES["crawl_limits"] = _crawl_limits


@_on("pages")
def crawl_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages from the first URL of each host, three levels deep, with robots and links from HTML."""
    own = pages.select(urls.canonical_self("url").alias("url"), "html")
    captured = tables.snapshot(pages).select(
        "url", "status_code", F.lit("").alias("error"), (F.col("n_bytes") > 0).alias("has_body"), "n_bytes", "fetch_time_ns"
    )
    seeds_ = own.groupBy(urls.url_hostname(F.col("url"))).agg(F.min("url").alias("url")).select("url", F.lit(3).alias("max_depth"))
    hosts = robots.rules_by_host(robots.parse_robots(tables.robots_texts(pages), AGENT))
    visited = crawl.crawl(seeds_, materialized(captured), materialized(crawl.page_links(own).distinct()), hosts)
    return visited.select("url", "domain", "depth", "outcome", "status_code", "error", "n_bytes")


@_on("pages")
def crawl_log(pages: DataFrame) -> DataFrame:
    """The log of ``crawl_pages``: each host is asked politely, and the crawl succeeds at the first tick after its last fetch."""
    visited = materialized(crawl_pages(pages))
    asked = politeness.plan(visited.filter("outcome <> 'BLOCKED'").withColumn("arrival_us", F.lit(0).cast("bigint")), "domain", "arrival_us", "url")
    done_us = F.col("release_us") + F.coalesce(F.col("n_bytes"), F.lit(0))
    start = F.unix_micros(F.expr(tables.EPOCH))
    rows = asked.withColumn("us", start + done_us).drop("arrival_us", "release_us").unionByName(
        visited.filter("outcome = 'BLOCKED'").withColumn("us", start)
    )
    rows = materialized(rows.withColumn("at", F.timestamp_micros("us")))
    tick = rows.agg(F.max("us").alias("last")).filter("last IS NOT NULL")
    done = tick.select(F.timestamp_micros(F.expr("(last div 500000 + 1) * 500000")).alias("at"))
    return telemetry.log_events(telemetry.crawl_log(rows, done), "at")


# --- archive -----------------------------------------------------------------------------------


def _results(pages: DataFrame) -> DataFrame:
    captured = pages.select(
        "page_id", "url", urls.url_hostname(F.col("url")).alias("domain"), F.lit(1).alias("depth"),
        F.when(F.col("url").contains("utm_source"), 404).when(F.col("url").endswith("#top"), 0).otherwise(200)
        .alias("status_code"),
        F.lit("text/html").alias("content_type"), F.col("html").cast("binary").alias("body"),
        F.lit("").alias("error"), tables.seconds_after_epoch("page_id").alias("at"),
    )
    return captured


@_on("pages")
def bytes_fetched(pages: DataFrame) -> DataFrame:
    return telemetry.bytes_fetched(pages, "html")


@_on("pages")
def archive_sizes(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", archive.size_text(F.octet_length("html")).alias("size_mb"))


@_on("pages")
def archive_select(pages: DataFrame) -> DataFrame:
    kept = fetch.archivable(_results(pages))
    return kept.select("page_id", "url", "status_code", F.octet_length("body").cast("bigint").alias("n_bytes"))


@_on("pages")
def warc_record_format(pages: DataFrame) -> DataFrame:
    return archive.with_record_text(fetch.archivable(_results(pages)), "at").select("page_id", "header", "http")


@_on("pages")
def publish_plan(pages: DataFrame) -> DataFrame:
    host = urls.url_hostname(F.col("url"))
    second = F.date_format(tables.seconds_after_epoch("page_id div 2"), "yyyyMMdd_HHmmss")
    path = F.concat(F.lit("/archive/"), host, F.lit("/crawl_"), second, F.lit(".warc.gz"))
    return archive.publish_plan(pages.select(path.alias("path"), host.alias("domain")), "web-archive")


@_on("documents")
def archive_line_range(documents: DataFrame) -> DataFrame:
    start, end = archive.line_span(from_=2, lines=3)
    lines = archive.text_lines(documents, "doc_id", "text", start, end)
    return lines.withColumn("line_no", F.col("line_no").cast("bigint"))


def _warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(_results(tables.table(spark, sf_dir, "pages")), path, "at")
    return warc.read_warc(spark, path).select(
        "domain", "target_uri", "http_status", F.octet_length("payload").cast("bigint").alias("n_bytes"),
        F.md5("payload").alias("digest"), F.unix_micros("warc_date").alias("date_us"),
    )


QUERIES["warc_roundtrip"] = _warc_roundtrip


def _warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of the pages, read back by format name."""
    warc_format.register(spark)
    rows = spark.read.format("warc").load(_archived(spark, sf_dir))
    return rows.select(
        "domain", "target_uri", "http_status", F.octet_length("payload").cast("bigint").alias("n_bytes"),
        F.md5("payload").alias("digest"), F.unix_micros("warc_date").alias("date_us"),
    )


def _archive_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an indexed archive of the pages, the records of each domain's first URL, by reads of their bytes alone."""
    path = scratch_path(spark, "indexed")
    warc.write_indexed(_results(tables.table(spark, sf_dir, "pages")), path, "at")
    places = warc.read_index(spark, path)
    first = places.groupBy("domain").agg(F.min("url").alias("url"))
    return warc.fetch_records(places, first).select(
        "domain", "target_uri", "http_status", F.octet_length("payload").cast("bigint").alias("n_bytes"),
        F.md5("payload").alias("digest"), F.unix_micros("warc_date").alias("date_us"),
        (F.col("bytes_read") <= F.col("content_length") + 1024).alias("own_bytes_only"),
    )


def _archived(spark: SparkSession, sf_dir: str) -> str:
    """An archive of the pages in the shared folder."""
    path = scratch_path(spark, "warc")
    warc.write_warc(_results(tables.table(spark, sf_dir, "pages")), path, "at")
    return path


def _archive_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = warc.preview(spark, _archived(spark, sf_dir), 1, 3)
    return lines.select(F.regexp_extract("path", "/domain=([^/]+)/", 1).alias("domain"), "line_no", "line")


def _archive_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.record_counts(spark, _archived(spark, sf_dir))


def _archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.list_archive(spark, _archived(spark, sf_dir)).select("domain", (F.size("files") > 0).alias("has_files"))


def _archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the archive of the pages by the listing, with what the manifest counts in it."""
    path = _archived(spark, sf_dir)
    counted = warc.manifest(spark, path, with_records=True).select(
        "domain", F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("bytes").alias("read"), "records", "content_bytes"
    )
    files = listing.list_files(spark, path).join(counted, ["domain", "name"], "left")
    return files.select(
        "domain", F.col("name").rlike(r"^part-.*\.gz$").alias("is_part"), (F.col("bytes") == F.col("read")).alias("same_size"),
        (F.col("size_mb") == archive.size_text(F.col("read"))).alias("same_text"), "records", "content_bytes",
    )


def _store_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the frontier and of the archive of the pages, each entry as JSON."""
    stored = listing.list_files(spark, _archived(spark, sf_dir)).groupBy("domain").agg(F.count("name").alias("files"))
    return overview.overview(tables.frontier_rows(tables.table(spark, sf_dir, "pages")), stored)


QUERIES |= {"warc_source": _warc_source, "archive_fetch": _archive_fetch}
QUERIES |= {"archive_files": _archive_files, "store_overview": _store_overview}
QUERIES |= {"archive_preview": _archive_preview, "archive_manifest": _archive_manifest, "archive_listing": _archive_listing}


@_on("lineitem")
def header_map(lineitem: DataFrame) -> DataFrame:
    """Each order's lines as headers: later lines of a name win."""
    name = F.concat("l_returnflag", F.lit("-"), "l_linestatus")
    line = F.struct("l_linenumber", name.alias("name"), F.col("l_partkey").cast("string").alias("value"))
    lines = lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    entries = F.array_sort(F.map_entries(fetch.headers_map(F.col("lines"))))
    return lines.select("l_orderkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("headers"))


# --- fetch log: records, telemetry, politeness --------------------------------------------------


@_on("events")
def crawl_records(events: DataFrame) -> DataFrame:
    return fetch.crawl_records(tables.fetch_log(events))


@_on("events")
def pages_by_status(events: DataFrame) -> DataFrame:
    return telemetry.pages_by_status(tables.fetch_log(events))


@_on("events")
def status_label(events: DataFrame) -> DataFrame:
    return tables.fetch_log(events).select("event_id", fetch.status_label(F.col("status_code")).alias("label"))


@_on("events")
def latency_histogram(events: DataFrame) -> DataFrame:
    rows = telemetry.latency_histogram(tables.fetch_log(events), F.col("fetch_time_ns") / 1e9)
    return rows.withColumn("sum_seconds", F.round("sum_seconds", 6))


@_on("events")
def crawl_stats(events: DataFrame) -> DataFrame:
    totals = telemetry.crawl_totals(tables.fetch_log(events))
    return totals.withColumn("pages_per_sec", F.round("pages_per_sec", 9))


@_on("events")
def gauge_last(events: DataFrame) -> DataFrame:
    last = telemetry.gauge_last(tables.ticks(events), "ts", "1 hour", ["active_workers", "queue_length"], "event_id")
    return _timed(last, "window_start")


@_on("events")
def stats_tumbling(events: DataFrame) -> DataFrame:
    return _timed(telemetry.stats_per_window(tables.fetch_log(events), "ts", "1 hour"), "window_start")


@_on("events")
def stats_ticks(events: DataFrame) -> DataFrame:
    """Totals and gauges of each crawl at every tick of six hours, idle ones included."""
    log = tables.ticks(events).withColumns({"at_us": F.unix_micros("ts"), "pages": F.lit(1)})
    gauges = ["active_workers", "queue_length"]
    return telemetry.stats_ticks(log, "crawl", "at_us", SIX_HOURS_US, ["pages", "in_flight"], gauges, "event_id")


@_on("events")
def crawl_records_stored(events: DataFrame) -> DataFrame:
    """The stored and compacted crawl records of the hosts whose names begin with u1, counted per domain."""
    spark, path = events.sparkSession, scratch_path(events.sparkSession, "records")
    stores.append_crawl_records(tables.fetch_log(events), path)
    stores.compact_crawl_records(spark, path, f"{path}-compact")
    rows = spark.read.parquet(f"{path}-compact").filter(F.col("domain").startswith("u1"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("records"), F.sum("fetch_time_ms").alias("fetch_ms"))


@_on("events")
def idle_sessions(events: DataFrame) -> DataFrame:
    return telemetry.idle_sessions(tables.fetch_log(events), "domain", "at_us", SIX_HOURS_US)


@_on("events")
def completion_events(events: DataFrame) -> DataFrame:
    return _timed(telemetry.completions(tables.ticks(events), "crawl", "ts", "event_id"), "ts")


@_on("events")
def politeness_plan(events: DataFrame) -> DataFrame:
    log = tables.fetch_log(events).select("event_id", "domain", "at_us")
    return politeness.plan(log, "domain", "at_us", "event_id", SIX_HOURS_US)


@_on("events")
def politeness_violations(events: DataFrame) -> DataFrame:
    log = tables.fetch_log(events).select("event_id", "domain", "at_us")
    return politeness.violations(log, "domain", "at_us", "event_id", SIX_HOURS_US)


@_on("events")
def log_events(events: DataFrame) -> DataFrame:
    return telemetry.log_events(tables.fetch_log(events))


@_on("events")
def stats_events(events: DataFrame) -> DataFrame:
    hours = telemetry.stats_per_window(tables.fetch_log(events), "ts", "1 hour")
    snapshots = hours.select(
        F.lit(0).alias("active_workers"), F.col("pages").alias("total_crawled"),
        (F.col("bytes") - F.col("pages")).alias("total_queued"), F.col("errors").alias("total_errors"),
    )
    return telemetry.stats_events(snapshots)


# --- Bloom filter ------------------------------------------------------------------------------


def _bloom_size(lineitem: DataFrame) -> bloom.BloomSize:
    return bloom.BloomSize.of(lineitem.count(), 0.01)


@_on("lineitem")
def bloom_build(lineitem: DataFrame) -> DataFrame:
    built = bloom.build(tables.shop_urls(lineitem), _bloom_size(lineitem))
    return built.select("block", "added", F.bitmap_count("bitmap").alias("bits_set"))


@_on("lineitem")
def bloom_might_contain(lineitem: DataFrame) -> DataFrame:
    size, shop = _bloom_size(lineitem), tables.shop_urls(lineitem)
    probed = bloom.might_contain(shop.select("url"), bloom.build(shop, size), size)
    return probed.groupBy("maybe").agg(F.count(F.lit(1)).alias("urls"))


@_on("lineitem")
def bloom_dedup(lineitem: DataFrame) -> DataFrame:
    shop = tables.shop_urls(lineitem)
    fresh, seen = shop.filter("l_returnflag <> 'R'"), shop.filter("l_returnflag = 'R'")
    return bloom.dedup(fresh, seen, _bloom_size(lineitem))
