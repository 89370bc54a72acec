"""Crawl tables derived from the given tables, whole and at their own scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.html import extract_links
from linkloom.functions.urls import canonical_self, url_hostname
from linkloom.operators import frontier
from linkloom.operators.dedup import first_per_key
from linkloom.operators.rows import per_element

EPOCH = "timestamp'2024-01-01 00:00:00'"
LINK_SEQ = 1_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds_after_epoch(seconds: str) -> Column:
    return F.expr(f"{EPOCH} + make_interval(0, 0, 0, 0, 0, 0, {seconds})")


def page_links(pages: DataFrame) -> DataFrame:
    """``(page_id, url, link)``: the distinct canonical links of each page."""
    return per_element(pages, ["page_id", "url"], extract_links("html", "url"), "link")


def frontier_items(pages: DataFrame) -> DataFrame:
    """Frontier items of a crawl of the pages: each page at depth 1, its links at depth 2.

    Items of pages fetched in plain http are still queued, the others crawled.
    """
    plain = F.col("url").startswith("http://").alias("plain")
    own = pages.select("page_id", canonical_self("url").alias("url"), F.lit(1).alias("depth"), plain)
    linked = page_links(pages).select("page_id", F.col("link").alias("url"), F.lit(2).alias("depth"), plain)
    items = own.unionByName(linked)
    return items.select(
        "url",
        url_hostname(F.col("url")).alias("domain"),
        "depth",
        F.col("depth").alias("priority"),
        F.lit(0).alias("retry_count"),
        F.when(F.col("plain"), frontier.QUEUED).otherwise(frontier.CRAWLED).alias("status"),
        seconds_after_epoch("page_id").alias("added_at"),
        (F.col("page_id") + (F.col("depth") - 1) * F.lit(LINK_SEQ)).alias("seq"),
    )


def frontier_rows(pages: DataFrame) -> DataFrame:
    """The frontier: one row per URL, the first item of each."""
    return first_per_key(frontier_items(pages), ["url"], ["seq"]).drop("seq")


def snapshot(pages: DataFrame) -> DataFrame:
    """Captured responses without bodies: one per canonical page URL, feed links a 404, fetch time from its size."""
    captured = pages.select(
        "page_id",
        canonical_self("url").alias("url"),
        F.when(F.col("url").contains("utm_source"), 404).otherwise(200).alias("status_code"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        F.octet_length("html").cast("bigint").alias("n_bytes"),
        (F.octet_length("html").cast("bigint") * 1000 + 999_999).alias("fetch_time_ns"),
    )
    return first_per_key(captured, ["url"], ["page_id"])


def robots_texts(pages: DataFrame) -> DataFrame:
    """A robots text per host; hosts differ in groups, delay and status."""
    hosts = pages.select(F.lower(url_hostname(F.col("url"))).alias("domain")).distinct()
    shared = "User-Agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*.html$  # pages\n"
    own = "\nuser-agent: otherbot\nUser-agent: linkbot\nDisallow: /en/*5\nDisallow:\nCrawl-delay: 2\n"
    body = F.when(F.length("domain") % 2 == 0, shared + own).otherwise(shared + "Crawl-delay: 1.5\n")
    status = F.when(F.length("domain") % 7 == 0, 404).otherwise(200)
    return hosts.select("domain", status.alias("status_code"), body.alias("body"))


def fetch_log(events: DataFrame) -> DataFrame:
    """Fetch log: one host per user, the fetch time in the event value, errors by event type."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"),
        F.concat(F.lit("u"), "user_id", F.lit(".example.com")).alias("domain"),
        F.concat(F.lit("https://u"), "user_id", F.lit(".example.com/"), kind).alias("url"),
        (F.col("user_id") % 3 + 1).cast("int").alias("depth"),
        F.when(kind == "error", 500).when(kind == "signup", 0).otherwise(200).alias("status_code"),
        F.when(kind == "signup", "fetch error: timeout").otherwise("").alias("error"),
        (F.round(F.col("value") * 1000).cast("bigint") * 1000 + 7).alias("fetch_time_ns"),
        F.length("props").alias("bytes"),
        F.when(kind == "purchase", frontier.QUEUED).otherwise(frontier.CRAWLED).alias("status"),
    )


def ticks(events: DataFrame) -> DataFrame:
    """Gauge ticks per crawl, one crawl per user."""
    kind = F.col("event_type")
    return events.select(
        "event_id",
        F.concat(F.lit("crawl"), "user_id").alias("crawl"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "view", 2).when(kind == "click", 1).otherwise(0).alias("active_workers"),
        F.when(kind == "signup", 3).otherwise(0).alias("queue_length"),
        F.when((kind == "error") & (F.col("value") > 50), 1).otherwise(0).alias("in_flight"),
    )


def shop_urls(lineitem: DataFrame) -> DataFrame:
    """Product URLs of all line items, with a sequence number and the return flag."""
    return lineitem.select(
        F.concat(
            F.lit("https://shop.example.com/supplier/"), "l_suppkey", F.lit("/part/"), "l_partkey"
        ).alias("url"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        "l_returnflag",
    )


def site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A web site over the star schema: seeds (regions), captured pages and links, down to parts and back up."""

    def page(kind: str, key: str) -> Column:
        return F.concat(F.lit(f"https://{kind}.example.com/"), key)

    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    orders, lineitem, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    gone = F.when(F.col("o_orderstatus") == "F", 410).otherwise(200)
    rows = [
        region.select(page("region", "r_regionkey").alias("url"), F.lit(200).alias("status_code")),
        nation.select(page("nation", "n_nationkey").alias("url"), F.lit(200).alias("status_code")),
        customer.select(page("customer", "c_custkey").alias("url"), F.lit(200).alias("status_code")),
        orders.select(page("order", "o_orderkey").alias("url"), gone.alias("status_code")),
        part.select(page("part", "p_partkey").alias("url"), F.lit(200).alias("status_code")),
    ]
    captured = rows[0]
    for more in rows[1:]:
        captured = captured.unionByName(more)
    captured = captured.select("url", "status_code", F.lit("").alias("error"), F.lit(True).alias("has_body"))

    def link(df: DataFrame, src: Column, dst: Column) -> DataFrame:
        return df.select(src.alias("src_url"), dst.alias("dst_url"))

    up_down = [
        link(nation, page("region", "n_regionkey"), page("nation", "n_nationkey")),
        link(nation, page("nation", "n_nationkey"), page("region", "n_regionkey")),
        link(customer, page("nation", "c_nationkey"), page("customer", "c_custkey")),
        link(orders, page("customer", "o_custkey"), page("order", "o_orderkey")),
        link(orders, page("order", "o_orderkey"), page("customer", "o_custkey")),
        link(lineitem, page("order", "l_orderkey"), page("part", "l_partkey")),
    ]
    links = up_down[0]
    for more in up_down[1:]:
        links = links.unionByName(more)
    seeds = region.select(page("region", "r_regionkey").alias("url"), F.lit(5).alias("max_depth"))
    return seeds, captured, links
