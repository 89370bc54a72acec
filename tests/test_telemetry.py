from __future__ import annotations

import datetime as dt
import json

import pytest

from pyspark.sql import functions as F

from linkloom.operators import telemetry
from linkloom.operators.fetch import status_label

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_histogram_bounds_are_inclusive(spark):
    values = [0.005, 0.0050001, 0.5, 10.0, 11.0]
    log = spark.createDataFrame([(v,) for v in values], "s DOUBLE")
    rows = {r["le"]: r["bucket_count"] for r in telemetry.latency_histogram(log, F.col("s")).collect()}
    assert rows == {
        "0.005": 1, "0.01": 2, "0.025": 2, "0.05": 2, "0.1": 2, "0.25": 2, "0.5": 3, "1": 3, "2.5": 3, "5": 3, "10": 4, "+Inf": 5
    }
    first = telemetry.latency_histogram(log, F.col("s")).first()
    assert (first["count"], round(first["sum_seconds"], 6)) == (5, 21.5100001.__round__(6))


def test_counters(spark):
    log = spark.createDataFrame(
        [(at(0), 200, "", "CRAWLED", 5), (at(1), 0, "fetch error", "CRAWLED", 0), (at(2), 404, "", "CRAWLED", 3), (at(4), 301, "", "QUEUED", 2)],
        "ts TIMESTAMP, status_code INT, error STRING, status STRING, bytes INT",
    )
    assert {tuple(r) for r in telemetry.pages_by_status(log).collect()} == {("200", 1), ("ERROR", 1), ("404", 1), ("301", 1)}
    total = telemetry.crawl_totals(log).first()
    assert tuple(total) == (3, 1, 2, 10, 0.75, 4_000_000_000)
    windows = {tuple(r) for r in telemetry.stats_per_window(log, "ts", "2 seconds").collect()}
    assert windows == {(at(0), 2, 1, 5), (at(2), 1, 1, 3), (at(4), 1, 0, 2)}
    assert telemetry.bytes_fetched(spark.createDataFrame([("é",), (None,)], "body STRING")).first()[0] == 2
    outcomes = spark.createDataFrame([("BLOCKED",), ("200",), ("BLOCKED",)], "outcome STRING")
    assert telemetry.robots_blocked(outcomes).first()[0] == 2
    assert telemetry.crawl_totals(log.limit(0)).first()["total_crawled"] == 0


def test_gauges_keep_the_last_value(spark):
    ticks = spark.createDataFrame([(at(0), 1, 9), (at(0.4), 3, 2), (at(0.6), 5, 0)], "ts TIMESTAMP, active_workers INT, queue_length INT")
    rows = telemetry.gauge_last(ticks, "ts", "500 milliseconds", ["active_workers", "queue_length"]).orderBy("window_start")
    assert [tuple(r) for r in rows.collect()] == [(at(0), 3, 2), (at(0.5), 5, 0)]


def test_idle_sessions_agree_with_session_windows(spark):
    rows = [("x", s) for s in (0, 5, 9, 19, 20, 29, 40, 41, 1000)] + [("y", 3)]
    log = spark.createDataFrame([(c, at(s)) for c, s in rows], "crawl STRING, ts TIMESTAMP").withColumn("us", F.unix_micros("ts"))
    ours = telemetry.idle_sessions(log, "crawl", "us", 10_000_000)
    theirs = log.groupBy("crawl", F.session_window("ts", "10 seconds")).agg(F.min("us"), F.max("us"), F.count("*"))
    assert {tuple(r) for r in ours.collect()} == {(r[0], *r[2:]) for r in theirs.collect()}
    assert ours.count() == 4


def test_event_texts(spark):
    log = spark.createDataFrame([(at(3), 'https://h/"q"', "BLOCKED", 2)], "ts TIMESTAMP, url STRING, status STRING, depth INT")
    event = json.loads(telemetry.log_events(log).first()[0])
    assert event == {"type": "log", "time": "10:00:03", "url": 'https://h/"q"', "status": "BLOCKED", "depth": 2}
    stats = spark.createDataFrame([(1, 2, 3, 4, 5)], "active_workers INT, total_crawled INT, total_queued INT, total_errors INT, bytes_fetched INT")
    assert json.loads(telemetry.stats_events(stats).first()[0]) == {
        "type": "stats", "active_workers": 1, "total_crawled": 2, "total_queued": 3, "total_errors": 4
    }


def test_status_label(spark):
    rows = spark.createDataFrame([(0,), (200,)], "c INT").select(status_label(F.col("c")))
    assert [r[0] for r in rows.collect()] == ["ERROR", "200"]


def plain_ticks(rows, every):
    """Totals and gauges tick by tick, one crawl after the other."""
    out = []
    for crawl in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == crawl), key=lambda r: (r[1], r[2]))
        busy = {r[1] // every for r in mine}
        for tick in range(min(busy), max(busy) + 1):
            known = [r for r in mine if r[1] // every <= tick]
            out.append((crawl, tick, sum(r[3] or 0 for r in known), known[-1][4], tick not in busy))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_per_task", [5, 5_000_000])
def test_every_tick_has_a_row(spark, rows_per_task, monkeypatch):
    monkeypatch.setattr(telemetry, "TICKS_PER_ARRAY", 3)
    rows = [("hot", (k * k * 7) % 900, k, k % 3 or None, k) for k in range(40)] + [("one", -5, 1, 1, 9), ("two", 3, 1, 1, 1), ("two", 3, 2, 1, 2), ("two", 99, 3, None, None)]
    log = spark.createDataFrame(rows, "crawl STRING, at_us BIGINT, event_id INT, pages INT, workers INT")
    made = telemetry.stats_ticks(log, "crawl", "at_us", 10, ["pages"], ["workers"], "event_id", rows_per_task)
    assert sorted((tuple(r) for r in made.collect()), key=str) == plain_ticks(rows, 10)
    assert telemetry.stats_ticks(log.limit(0), "crawl", "at_us", 10, ["pages"], ["workers"], "event_id").count() == 0
