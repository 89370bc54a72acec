"""Crawl telemetry: counters, histogram, gauges, completion edges and event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.fetch import is_error, status_label
from linkloom.operators.ordered import ROWS_PER_TASK, has_hot_key, previous, running_max, running_sums
from linkloom.session import materialized

# Default bounds of a latency histogram, in seconds.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

#: Ticks of an idle stretch that are one array while rows are made of them.
TICKS_PER_ARRAY = 10_000


def pages_by_status(log: DataFrame) -> DataFrame:
    return log.groupBy(status_label(F.col("status_code")).alias("status")).agg(F.count(F.lit(1)).alias("pages"))


def bytes_fetched(log: DataFrame, body: str = "body") -> DataFrame:
    return log.agg(F.coalesce(F.sum(F.octet_length(body).cast("bigint")), F.lit(0)).alias("bytes_fetched"))


def robots_blocked(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count_if(F.col("outcome") == "BLOCKED").alias("robots_blocked"))


def latency_histogram(log: DataFrame, seconds: Column) -> DataFrame:
    """Cumulative counts per upper bound, with sum and count, in one pass."""
    bounds = [*LATENCY_BOUNDS, float("inf")]
    timed = log.select(seconds.alias("s"))
    one_row = timed.agg(
        F.array(*[F.count_if(F.col("s") <= b) for b in bounds]).alias("counts"),
        F.sum("s").alias("sum_seconds"),
        F.count("s").alias("count"),
    )
    labels = F.array(*[F.lit("+Inf" if b == float("inf") else f"{b:g}") for b in bounds])
    rows = one_row.select(F.explode(F.arrays_zip(labels.alias("le"), "counts")).alias("b"), "sum_seconds", "count")
    return rows.select(F.col("b.le").alias("le"), F.col("b.counts").alias("bucket_count"), "sum_seconds", "count")


def crawl_totals(log: DataFrame, at: str = "ts") -> DataFrame:
    """Totals of a crawl from its fetch log, with bytes, rate and up-time."""
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / F.lit(1e6)
    crawled = F.count_if(F.col("status") == "CRAWLED")
    return log.agg(
        crawled.alias("total_crawled"),
        F.count_if(F.col("status") == "QUEUED").alias("total_queued"),
        F.count_if(is_error()).alias("total_errors"),
        F.sum(F.col("bytes").cast("bigint")).alias("bytes_fetched"),
        F.when(seconds > 0, crawled / seconds).alias("pages_per_sec"),
        ((F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) * 1000).alias("uptime_ns"),
    )


def gauge_last(ticks: DataFrame, at: str, every: str, values: list[str], tie: str | None = None) -> DataFrame:
    """The gauges of the last tick per time window; ``tie`` decides between ticks of one time, else the values do."""
    order = F.struct(at, *([tie] if tie else []), *values)
    windows = ticks.groupBy(F.window(at, every).alias("_window")).agg(F.max_by(F.struct(*values), order).alias("_last"))
    return windows.select(F.col("_window.start").alias("window_start"), *[F.col(f"_last.{v}").alias(v) for v in values])


def stats_per_window(log: DataFrame, at: str, every: str) -> DataFrame:
    """Pages, errors and bytes per tumbling window; also a streaming aggregate when ``at`` has a watermark."""
    windows = log.groupBy(F.window(at, every).alias("_window")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(is_error()).alias("errors"),
        F.sum(F.col("bytes").cast("bigint")).alias("bytes"),
    )
    return windows.select(F.col("_window.start").alias("window_start"), "pages", "errors", "bytes")


def stats_ticks(
    log: DataFrame, crawl: str, at_us: str, every_us: int, counters: list[str], gauges: list[str], tie: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """A row for every tick of each crawl from its first to its last, busy or idle.

    ``tick`` numbers ticks of ``every_us`` since the epoch. Counters are totals
    up to the end of the tick, gauges the last values known by then; a tick
    without events, marked ``idle``, repeats those of the tick before. Of gauges
    at one time those with the highest ``tie`` count. Null counters add nothing.

    Rows are merged per tick on the map side first, so a hot crawl is bounded by
    its time span; one of very many busy ticks is worked on in ordered blocks.
    An idle stretch becomes rows in arrays of bounded length.
    """
    order = F.struct(at_us, tie, *gauges)
    busy = log.groupBy(crawl, F.floor(F.col(at_us) / every_us).alias("tick")).agg(
        *[F.sum(F.coalesce(F.col(c).cast("bigint"), F.lit(0))).alias(c) for c in counters],
        F.max_by(F.struct(*gauges), order).alias("_gauges"),
    )
    busy = materialized(busy.withColumn("_back", -F.col("tick")))
    hot = has_hot_key(busy, [crawl], rows_per_task)
    totals = running_sums(busy, [crawl], ["tick"], counters, rows_per_task, hot)
    paired = previous(totals, [crawl], ["_back"], "tick", "_next", rows_per_task, hot)
    last = F.coalesce("_next", F.col("tick") + 1) - F.col("tick") - 1
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(TICKS_PER_ARRAY).cast("bigint")))
    parts = paired.withColumn("_last", last).withColumn("_from", part)
    to = F.least("_last", F.col("_from") + (TICKS_PER_ARRAY - 1))
    rows = parts.withColumn("_after", F.explode(F.sequence("_from", to)))
    return rows.select(
        crawl, (F.col("tick") + F.col("_after")).alias("tick"), *counters,
        *[F.col("_gauges")[g].alias(g) for g in gauges], (F.col("_after") > 0).alias("idle"),
    )


def completions(
    ticks: DataFrame, crawl: str, at: str, tie: str, rows_per_task: int = ROWS_PER_TASK, keep: Sequence[str] = ()
) -> DataFrame:
    """Ticks at which a crawl that was active is first found idle.

    Active: workers or queue above zero. Idle: both zero and nothing in
    flight. Ticks that are neither do not end a crawl and are passed over.
    ``keep`` names further columns of such a tick.
    """
    active = (F.col("active_workers") > 0) | (F.col("queue_length") > 0)
    settled = ticks.withColumn("_active", active).filter(active | (F.col("in_flight") == 0))
    paired = previous(settled, [crawl], [at, tie], "_active", "_was_active", rows_per_task)
    return paired.filter(~F.col("_active") & F.col("_was_active")).select(crawl, at, *keep)


def with_session(
    events: DataFrame, edges: DataFrame, crawl: str, at_us: str, tie: str, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Add ``session_start_us``: the last completion of the crawl before each event, NULL in its first session.

    ``edges`` are completions with the same three columns; an event at the very
    tick that completes a crawl still belongs to the session that ends. Events
    and completions are merged in one order, whose running maximum of completion
    times is the answer, so a crawl of very many events is worked on in blocks.
    """
    marks = edges.select(F.col(crawl).alias("_crawl"), F.col(at_us).alias("_at"), F.col(tie).alias("_tie"), F.lit(1).alias("_edge"))
    rows = events.withColumns({"_crawl": F.col(crawl), "_at": F.col(at_us), "_tie": F.col(tie), "_edge": F.lit(0)})
    merged = rows.unionByName(marks, allowMissingColumns=True)
    completed = F.when(F.col("_edge") == 1, F.col("_at"))
    known = running_max(merged, ["_crawl"], ["_at", "_tie", "_edge"], completed, "session_start_us", rows_per_task)
    return known.filter("_edge = 0").select(*events.columns, "session_start_us")


def idle_sessions(
    log: DataFrame, crawl: str, at_us: str, gap_us: int, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Activity sessions of each crawl: a gap longer than ``gap_us`` ends one.

    Rows are first merged per gap-long slot, inside which no gap can be that
    long. That is a map-side combine, and it bounds the rows of a crawl by its
    time span instead of its traffic. A crawl of very many slots is worked on in
    ordered blocks; a session is known by its start, the latest opening so far.
    """
    slots = log.groupBy(crawl, F.floor(F.col(at_us) / gap_us).alias("slot")).agg(
        F.min(at_us).alias("lo"), F.max(at_us).alias("hi"), F.count(F.lit(1)).alias("n")
    )
    slots = materialized(slots)  # one pass over the log, and one answer for both steps
    hot = has_hot_key(slots, [crawl], rows_per_task)
    paired = previous(slots, [crawl], ["slot"], "hi", "_before", rows_per_task, hot)
    opens = F.when(F.coalesce(F.col("lo") - F.col("_before") > gap_us, F.lit(True)), F.col("lo"))
    opened = paired.withColumn("_opened", opens)
    runs = running_max(opened, [crawl], ["slot"], F.col("_opened"), "start_us", rows_per_task, hot)
    return runs.groupBy(crawl, "start_us").agg(F.max("hi").alias("end_us"), F.sum("n").alias("pages"))


def crawl_log(visited: DataFrame, done: DataFrame, at: str = "at") -> DataFrame:
    """Log rows ``(at, url, status, depth)`` of a crawl.

    ``visited`` has ``url, depth, outcome`` and a time: BLOCKED, ERROR or the
    status code where a page was fetched; URLs beyond the depth limit are not
    logged. Each completion in ``done`` is a SUCCESS row without a URL.
    """
    pages = visited.filter("outcome <> 'SKIPPED'").select(at, "url", F.col("outcome").alias("status"), "depth")
    success = done.select(at, F.lit("").alias("url"), F.lit("SUCCESS").alias("status"), F.lit(0).alias("depth"))
    return pages.unionByName(success)


def log_events(log: DataFrame, at: str = "ts") -> DataFrame:
    """One JSON text per log event."""
    fields = F.struct(
        F.lit("log").alias("type"), F.date_format(at, "HH:mm:ss").alias("time"), "url", "status", "depth"
    )
    return log.select(F.to_json(fields).alias("event"))


def stats_events(stats: DataFrame) -> DataFrame:
    """One JSON text per stats snapshot."""
    fields = F.struct(
        F.lit("stats").alias("type"), "active_workers", "total_crawled", "total_queued", "total_errors"
    )
    return stats.select(F.to_json(fields).alias("event"))
