"""Queries and updates on the frontier table (one row per URL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.urls import url_domain_text
from linkloom.operators.dedup import last_per_key
from linkloom.operators.ordered import numbered

QUEUED, FETCHING, CRAWLED, FAILED = "QUEUED", "FETCHING", "CRAWLED", "FAILED"

SCHEMA = (
    "url STRING, domain STRING, depth INT, priority INT, retry_count INT, status STRING, added_at TIMESTAMP"
)


def key() -> Column:
    return F.concat(F.lit("url:"), F.col("url"))


def encode(frontier: DataFrame) -> DataFrame:
    """Stored form: key and JSON value."""
    fields = [F.col(f.name) for f in frontier.schema]
    return frontier.select(key().alias("key"), F.to_json(F.struct(*fields)).alias("value"))


def decode(stored: DataFrame, value: str = "value") -> DataFrame:
    """Frontier rows of JSON values; values that do not decode are skipped, absent fields are empty or zero."""
    parsed = F.from_json(value, SCHEMA + ", _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = stored.select(parsed.alias("item")).filter("item IS NOT NULL AND item._bad IS NULL").select("item.*")
    filled = {"url": "", "domain": "", "depth": 0, "priority": 0, "retry_count": 0, "status": ""}
    return rows.drop("_bad").fillna(filled)


def _with_status(frontier: DataFrame, status: str) -> DataFrame:
    return frontier.filter(F.col("status") == status) if status else frontier


def _first(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy("url").limit(limit) if limit > 0 else rows.orderBy("url")


def dump(frontier: DataFrame) -> DataFrame:
    """All keys in byte order, numbered from 1, with the total."""
    return numbered(encode(frontier), ["key"])


def scan(frontier: DataFrame, status: str = "", limit: int = 0) -> DataFrame:
    """Rows in key order; an empty status means all, and no limit all rows."""
    return _first(_with_status(frontier, status), limit)


def scan_domain(frontier: DataFrame, domain: str, status: str = "", limit: int = 0) -> DataFrame:
    """Rows of one domain in key order; all of them without a limit."""
    if not domain:
        raise ValueError("domain is required")
    rows = _with_status(frontier.filter(F.col("domain") == domain), status)
    return _first(rows, limit)


def requested_limit(text: str | None) -> int:
    """Limit of a request: any positive number that it names, else 0 for none."""
    try:
        return max(int(text or ""), 0)
    except ValueError:
        return 0


def scan_prefix(frontier: DataFrame, prefix: str, limit: int = 0) -> DataFrame:
    """Rows whose URL starts with a prefix, in key order; all of them without a limit."""
    return _first(frontier.filter(F.col("url").startswith(prefix)), limit)


def get(frontier: DataFrame, url: str) -> DataFrame:
    """The row of one URL, if stored."""
    return frontier.filter(F.col("url") == url)


def lookup(wanted: DataFrame, frontier: DataFrame) -> DataFrame:
    """A batch of point lookups: each wanted URL with ``found`` and the stored columns.

    A semi-join first cuts the frontier down to what is wanted, so the outer
    join, whose right side can't be pruned, never shuffles the whole of it.
    """
    stored = frontier.join(wanted.select("url"), "url", "left_semi").withColumn("_hit", F.lit(True))
    joined = wanted.join(stored, "url", "left")
    return joined.withColumn("found", F.coalesce("_hit", F.lit(False))).drop("_hit")


def domain_counts(frontier: DataFrame) -> DataFrame:
    """URLs per domain as cut from the URL text, empty domains dropped, in order of domain."""
    counts = frontier.groupBy(url_domain_text(F.col("url")).alias("domain")).count()
    return counts.filter("domain <> ''").orderBy("domain")


def domain_counts_with_status(frontier: DataFrame, status: str) -> DataFrame:
    """URLs with a status per stored domain, in order of domain."""
    return _with_status(frontier, status).groupBy("domain").count().orderBy("domain")


def upsert(current: DataFrame, changes: DataFrame, version: str = "version") -> DataFrame:
    """Current rows with changes applied: the highest version of each URL stays, on a tie the change."""
    both = current.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)))
    rest = [c for c in current.columns if c not in ("url", version)]
    return last_per_key(both, ["url"], version, ["_change", *rest]).drop("_change")


def queued(items: DataFrame) -> DataFrame:
    return items.withColumn("status", F.lit(QUEUED))


def completed(items: DataFrame) -> DataFrame:
    return items.withColumn("status", F.lit(CRAWLED))
