"""Depth-bounded traversal of captured pages, one level per job."""

from __future__ import annotations

import uuid
from contextlib import closing
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.html import extract_links
from linkloom.functions.urls import url_hostname
from linkloom.operators import bloom
from linkloom.operators.dedup import first_per_key
from linkloom.operators.fetch import NOT_CAPTURED, is_error, outcome
from linkloom.operators.ordered import ROWS_PER_TASK
from linkloom.operators.robots import check_urls
from linkloom.operators.rows import per_element
from linkloom.session import materialized, scratch_path

SMALL_LEVEL_BYTES = 32 << 20
SOURCE_GROUPS = 1 << 16


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Edges ``(src_url, dst_url)``: the distinct canonical links of each page, found without a shuffle."""
    named = pages.select(F.col(url).alias("src_url"), F.col(html).alias("html"))
    return per_element(named, ["src_url"], extract_links("html", "src_url"), "dst_url")


def _candidates(rows: DataFrame, key: str, urls: DataFrame, size: bloom.BloomSize) -> DataFrame:
    """The rows whose key may be among ``urls``, by a broadcast filter: few others are left for the join."""
    found = bloom.might_contain(rows, bloom.build(urls, size), size, key)
    return found.filter("maybe").drop("maybe")


def _with_outcome(
    level: DataFrame, captured: DataFrame, hosts: DataFrame | None, small: bool, size: bloom.BloomSize | None = None
) -> DataFrame:
    # A small level first cuts the captured pages down by a broadcast, so they need no shuffle; a filter cuts down its shuffle.
    near = captured
    if small:
        near = captured.join(F.broadcast(level.select("url")), "url", "left_semi")
    elif size is not None:
        near = _candidates(captured, "url", level.select("url"), size)
    known = level.join(near, "url", "left").withColumn("status_code", F.coalesce("status_code", F.lit(0))).withColumn(
        "error", F.when(F.col("has_body").isNull(), NOT_CAPTURED).otherwise(F.coalesce("error", F.lit("")))
    )
    tested = known.withColumn("allowed", F.lit(True)) if hosts is None else check_urls(known, hosts)
    return tested.withColumn("outcome", outcome(F.col("max_depth")))


class Buckets:
    """Tables in hash buckets of a column, so that joins on it shuffle the other side alone.

    Their files are in the shared folder; ``close`` takes the names from the catalog.
    """

    def __init__(self) -> None:
        self.names: list[tuple[DataFrame, str]] = []

    def of(self, df: DataFrame, key: str) -> DataFrame:
        """The rows with a key, a file to a bucket; rows without one join with nothing."""
        spark, name = df.sparkSession, f"linkloom_{uuid.uuid4().hex}"
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.filter(F.col(key).isNotNull()).repartition(n, key).write.bucketBy(n, key).sortBy(key)
        writer.option("path", scratch_path(spark, "buckets")).saveAsTable(name)
        self.names.append((df, name))
        return spark.table(name)

    def close(self) -> None:
        for df, name in self.names:
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


class Edges:
    """Links in buckets of their source.

    A source of more links than a task should take would make its bucket as
    large; the links of such sources stay a table without buckets, and their
    sources, at most one per ``rows_per_task`` links, are broadcast to it.
    """

    def __init__(self, links: DataFrame, made: Buckets, rows_per_task: int = ROWS_PER_TASK) -> None:
        # Only the sources in a large group of sources are counted, so that few sources are shuffled for it.
        group = F.pmod(F.xxhash64("src_url"), F.lit(SOURCE_GROUPS))
        large = links.groupBy(group.alias("_group")).count().filter(F.col("count") > rows_per_task).select("_group")
        in_large = links.withColumn("_group", group).join(F.broadcast(large), "_group", "left_semi")
        counted = in_large.groupBy("src_url").count().filter(F.col("count") > rows_per_task)
        self.hubs = materialized(counted.select("src_url"))
        self.hub_links = None
        if not self.hubs.isEmpty():
            self.hub_links = links.join(F.broadcast(self.hubs), "src_url", "left_semi")
            links = links.join(F.broadcast(self.hubs), "src_url", "left_anti")
        self.links = made.of(links, "src_url")

    def followed(self, sources: DataFrame) -> DataFrame:
        """``sources`` joined with their links."""
        found = self.links.join(sources, "src_url")
        if self.hub_links is None:
            return found
        hubs = sources.join(F.broadcast(self.hubs), "src_url", "left_semi")
        return found.unionByName(self.hub_links.join(F.broadcast(hubs), "src_url"))


def crawl(
    seeds: DataFrame,
    captured: DataFrame,
    links: DataFrame,
    hosts: DataFrame | None = None,
    small_level_bytes: int = SMALL_LEVEL_BYTES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every URL reached from the seeds with its least depth, its outcome, and what was captured of it.

    ``seeds`` has ``url, max_depth``; ``captured`` has ``url, status_code,
    error, has_body`` and any further columns, which are passed on; ``links``
    has ``src_url, dst_url``; ``hosts`` is the robots table. Captured pages and
    links are read once per level, so they should be stored tables. A level that
    is too large to broadcast, but whose Bloom filter takes no more than a
    quarter of that, shuffles only what passes the filter. The first level that
    is larger still, if it may be followed, puts both in buckets of their URLs;
    from there on a level shuffles only itself.

    A URL is followed again when it is reached with more depth left under
    another seed's limit than before, so no seed takes results from another;
    the depth left falls with each level, which ends the loop. A URL that a
    limit skips counts as reached where another limit admits it. Each level is
    checkpointed, which cuts the plan and gives the row count that ends the loop
    and the bytes that allow a broadcast of a small level.
    """
    with closing(Buckets()) as made:
        return _crawl(seeds, captured, links, hosts, small_level_bytes, rows_per_task, made)


def _crawl(
    seeds: DataFrame, captured: DataFrame, links: DataFrame, hosts: DataFrame | None, small_level_bytes: int,
    rows_per_task: int, made: Buckets,
) -> DataFrame:
    hosts = None if hosts is None else materialized(hosts)
    level = (
        seeds.groupBy("url").agg(F.max("max_depth").alias("max_depth")).withColumn("depth", F.lit(1))
    )
    levels: list[DataFrame] = []
    seen: DataFrame | None = None
    edges: Edges | None = None
    while True:
        level = materialized(level)
        rows, url_bytes, most_left = level.agg(
            F.count(F.lit(1)), F.sum(F.octet_length("url").cast("bigint")), F.max(F.col("max_depth") - F.col("depth"))
        ).first()
        if rows == 0:
            break
        small, ends = url_bytes + 32 * rows <= small_level_bytes, most_left is None or most_left <= 0
        size = None if small or edges is not None else bloom.BloomSize.of(rows)
        if size is not None and (4 * size.bits > 8 * small_level_bytes or size.blocks > bloom.BROADCAST_BLOCKS):
            size = None
            if not ends:
                captured, edges = made.of(captured, "url"), Edges(links, made, rows_per_task)
        visited = materialized(_with_outcome(level, captured, hosts, small, size).drop("allowed", "crawl_delay"))
        levels.append(visited)
        if ends:
            break
        left = level.select("url", (F.col("max_depth") - F.col("depth")).alias("left"))
        seen = left if seen is None else materialized(
            seen.unionByName(left).groupBy("url").agg(F.max("left").alias("left"))
        )
        ok = ~F.col("outcome").isin("SKIPPED", "BLOCKED", "ERROR")
        expand = visited.filter(ok & ~is_error() & F.col("has_body") & (F.col("depth") < F.col("max_depth")))
        sources = expand.select(F.col("url").alias("src_url"), "depth", "max_depth")
        if small:
            followed = links.join(F.broadcast(sources), "src_url")
        elif size is not None:
            followed = _candidates(links, "src_url", sources.select(F.col("src_url").alias("url")), size).join(sources, "src_url")
        else:
            followed = edges.followed(sources)
        reached = followed.groupBy(F.col("dst_url").alias("url")).agg(
            F.max("max_depth").alias("max_depth"), (F.max("depth") + 1).alias("depth")
        )
        known = seen.select(F.col("url").alias("_url"), "left")
        covered = (F.col("url") == F.col("_url")) & (F.col("left") >= F.col("max_depth") - F.col("depth"))
        level = reached.join(known, covered, "left_anti").select("url", "max_depth", "depth")
    extra = [c for c in captured.columns if c not in ("url", "status_code", "error", "has_body")]
    columns = ["url", "depth", "outcome", "status_code", "error", *extra]
    if not levels:
        visited = _with_outcome(level, captured, hosts, True).limit(0)
    else:
        every = reduce(DataFrame.unionByName, levels)
        visited = first_per_key(every, ["url"], [F.col("outcome") == "SKIPPED", "depth", F.col("max_depth").desc()])
    host = url_hostname(F.col("url")).alias("domain")
    return visited.select("url", host, *columns[1:])
