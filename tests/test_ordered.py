"""Politeness, numbering and completion edges: the plain and the hot-key forms must agree with brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import ordered, politeness, telemetry


@pytest.fixture(scope="module")
def requests(spark):
    pick = random.Random(5)
    hosts = ["hot"] * 400 + ["b"] * 60 + ["c"] * 3 + ["d"]
    rows = [(h, pick.choice([0, 100, 250]) + pick.randint(0, 20_000), i) for i, h in enumerate(hosts)]
    rows += [("hot", 5000, 10_000 + i) for i in range(200)]  # one burst at one time
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "host STRING, at BIGINT, id BIGINT")


@pytest.mark.parametrize("rows_per_task", [10**9, 50])
def test_plan(spark, requests, rows_per_task):
    got = politeness.plan(frame(spark, requests), "host", "at", "id", 70, rows_per_task=rows_per_task)
    want, last = {}, {}
    for host, at, i in sorted(requests, key=lambda r: (r[1], r[2])):
        last[host] = want[i] = max(at, last.get(host, -10**9) + 70)
    assert {r["id"]: r["release_us"] for r in got.collect()} == want


def test_plan_default_and_extra_delay(spark):
    rows = frame(spark, [("h", 0, 1), ("h", 100_000, 2), ("h", 200_000, 3), ("h", 5_000_000, 4)])
    got = politeness.plan(rows, "host", "at", "id").orderBy("id").collect()
    assert [r["release_us"] for r in got] == [0, 500_000, 1_000_000, 5_000_000]
    later = politeness.plan(rows, "host", "at", "id", 0, extra_us=F.lit(2_000_000)).orderBy("id").collect()
    assert [r["release_us"] for r in later] == [2_000_000, 2_500_000, 3_000_000, 7_000_000]


@pytest.mark.parametrize("rows_per_task", [10**9, 50])
def test_violations(spark, requests, rows_per_task):
    got = politeness.violations(frame(spark, requests), "host", "at", "id", 40, rows_per_task)
    want, last = set(), {}
    for host, at, i in sorted(requests, key=lambda r: (r[1], r[2])):
        if host in last and at - last[host] < 40:
            want.add((i, at - last[host]))
        last[host] = at
    assert {(r["id"], r["gap_us"]) for r in got.collect()} == want
    planned = politeness.plan(frame(spark, requests), "host", "at", "id", 40)
    assert politeness.violations(planned, "host", "release_us", "id", 40).count() == 0


def test_numbered(spark):
    rows = spark.range(1000).select((F.lit(999) - F.col("id")).cast("string").alias("key"))
    got = ordered.numbered(rows, ["key"]).collect()
    assert sorted((r["n"], r["key"]) for r in got) == list(enumerate(sorted(map(str, range(1000))), 1))
    assert {r["total"] for r in got} == {1000}
    assert ordered.numbered(rows.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("rows_per_task", [10**9, 20])
def test_completions(spark, rows_per_task):
    pick = random.Random(1)
    ticks, want = [], set()
    for crawl in ("x", "y"):
        was = False
        for t in range(300):
            workers, queue, flight = pick.choice([(1, 0, 1), (0, 2, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)])
            ticks.append((crawl, t, workers, queue, flight))
            active = workers > 0 or queue > 0
            if not active and was and flight == 0:
                want.add((crawl, t))
                was = False
            was = was or active
    df = spark.createDataFrame(ticks, "crawl STRING, at INT, active_workers INT, queue_length INT, in_flight INT")
    got = telemetry.completions(df, "crawl", "at", "in_flight", rows_per_task)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("rows_per_task", [10**9, 30])
def test_sessions_begin_at_completions(spark, rows_per_task):
    pick = random.Random(8)
    events = [("hot" if i % 5 else pick.choice("ab"), pick.randrange(400), i, f"u{pick.randrange(30)}") for i in range(900)]
    # Completions at ticks of their own and at the very time and tie of an event.
    edges = [("hot", pick.randrange(400), 1000 + i) for i in range(12)] + [(c, t, i) for c, t, i, _ in pick.sample(events, 10)] + [("none", 3, 1)]
    got = telemetry.with_session(
        spark.createDataFrame(events, "crawl STRING, at BIGINT, id BIGINT, url STRING"),
        spark.createDataFrame(edges, "crawl STRING, at BIGINT, id BIGINT"), "crawl", "at", "id", rows_per_task,
    )
    want = {
        (c, t, i, u): max((e for k, e, j in edges if k == c and (e, j) < (t, i)), default=None) for c, t, i, u in events
    }
    assert got.columns == ["crawl", "at", "id", "url", "session_start_us"]
    assert {tuple(r)[:4]: r["session_start_us"] for r in got.collect()} == want and got.count() == len(events)
    none = telemetry.with_session(got.drop("session_start_us"), got.limit(0).select("crawl", "at", "id"), "crawl", "at", "id", rows_per_task)
    assert none.filter("session_start_us IS NOT NULL").count() == 0 and none.count() == len(events)


def test_idle_sessions_of_a_hot_crawl_agree(spark):
    pick = random.Random(3)
    rows = [(c, pick.randrange(100_000), 1) for c in ["hot"] * 800 + ["b"] * 50]
    log = spark.createDataFrame(rows, "crawl STRING, at BIGINT, n INT")
    plain, blocks = (telemetry.idle_sessions(log, "crawl", "at", 150, n) for n in (10**9, 20))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, blocks.collect()))


def test_crawl_log_labels(spark):
    visited = spark.createDataFrame(
        [("https://a/", 1, "200", 5), ("https://a/x", 2, "BLOCKED", 1), ("https://a/y", 2, "ERROR", 6), ("https://a/z", 4, "SKIPPED", 7)],
        "url STRING, depth INT, outcome STRING, s INT",
    ).withColumn("at", F.timestamp_seconds("s"))
    done = spark.createDataFrame([(8,)], "s INT").select(F.timestamp_seconds("s").alias("at"))
    rows = telemetry.crawl_log(visited, done)
    assert {(r["url"], r["status"], r["depth"]) for r in rows.collect()} == {
        ("https://a/", "200", 1), ("https://a/x", "BLOCKED", 2), ("https://a/y", "ERROR", 2), ("", "SUCCESS", 0)
    }
    events = [r["event"] for r in telemetry.log_events(rows, "at").collect()]
    assert '{"type":"log","time":"00:00:08","url":"","status":"SUCCESS","depth":0}' in events and len(events) == 4
