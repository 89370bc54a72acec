from __future__ import annotations

import datetime as dt
import json

import pytest


from linkloom.operators import fetch, frontier
from linkloom.plans import overview
from linkloom.sources import seeds, stores

NOW = dt.datetime(2024, 1, 2, 3, 4, 5)
URLS = ["http://a.com/", "https://a.com", "https://a.com-b/", "https://a.com.au/", "https://a.com/x", "https://a.com:8080/"]


@pytest.fixture()
def rows(spark):
    data = [
        (u, d, 1, 1, 0, s, NOW)
        for u, d, s in zip(URLS, ["a.com", "a.com", "a.com-b", "a.com.au", "a.com", "a.com"], ["QUEUED", "CRAWLED"] * 3)
    ]
    return spark.createDataFrame(data, frontier.SCHEMA)


def urls_of(df):
    return [r["url"] for r in df.collect()]


def test_dump_in_byte_order(rows):
    dump = frontier.dump(rows).orderBy("n").collect()
    assert [r["key"] for r in dump] == sorted("url:" + u for u in URLS)
    assert {r["total"] for r in dump} == {6}
    assert json.loads(dump[0]["value"])["domain"] == "a.com"


def test_scans(rows):
    assert urls_of(frontier.scan(rows)) == sorted(URLS)
    assert urls_of(frontier.scan(rows, "QUEUED", 2)) == sorted(URLS[::2])[:2]
    assert urls_of(frontier.scan_prefix(rows, "https://a.com/")) == ["https://a.com/x"]
    # A domain scan finds http rows and rows behind look-alike domains too.
    assert urls_of(frontier.scan_domain(rows, "a.com")) == sorted([URLS[0], URLS[1], URLS[4], URLS[5]])
    assert urls_of(frontier.scan_domain(rows, "a.com", "CRAWLED", 1)) == ["https://a.com"]
    with pytest.raises(ValueError):
        frontier.scan_domain(rows, "")


@pytest.mark.parametrize(("text", "limit"), [(None, 0), ("", 0), ("x", 0), ("0", 0), ("7", 7), ("2000", 2000), ("2001", 2001)])
def test_requested_limit(text, limit):
    assert frontier.requested_limit(text) == limit


def test_no_limit_gives_all_rows(spark):
    many = spark.range(600).selectExpr(
        "concat('https://h/', id) url", "'h' domain", "1 depth", "1 priority", "0 retry_count", "'QUEUED' status", "now() added_at"
    )
    assert frontier.scan(many).count() == frontier.scan_domain(many, "h").count() == 600
    assert frontier.scan_prefix(many, "https://").count() == 600 and frontier.scan(many, limit=500).count() == 500


def test_lookup(spark, rows):
    wanted = spark.createDataFrame([(URLS[0],), ("https://none/",)], "url STRING")
    assert {r["url"]: r["found"] for r in frontier.lookup(wanted, rows).collect()} == {URLS[0]: True, "https://none/": False}
    assert frontier.get(rows, URLS[1]).first()["status"] == "CRAWLED"


def test_codec_skips_bad_values(spark, rows):
    stored = frontier.encode(rows).select("value")
    bad = spark.createDataFrame([("{",), ('{"depth":"deep"}',), ("[1]",), (None,), ('{"url":"https://min/","x":1}',)], "value STRING")
    back = frontier.decode(stored.union(bad))
    assert sorted(urls_of(back)) == sorted([*URLS, "https://min/"])
    least = back.filter("url = 'https://min/'").first()
    assert (least["domain"], least["depth"], least["status"], least["added_at"]) == ("", 0, "", None)
    assert back.filter("url <> 'https://min/'").exceptAll(rows).count() == 0


def test_domain_counts(rows):
    assert [tuple(r) for r in frontier.domain_counts(rows).collect()] == [("a.com", 4), ("a.com-b", 1), ("a.com.au", 1)]
    assert [tuple(r) for r in frontier.domain_counts_with_status(rows, "QUEUED").collect()] == [("a.com", 2), ("a.com-b", 1)]


def test_upsert_and_store(spark, rows, tmp_path):
    versioned = rows.selectExpr("*", "0 AS version")
    done = frontier.completed(rows.filter("url = 'http://a.com/'")).selectExpr("*", "1 AS version")
    first, second = str(tmp_path / "one"), str(tmp_path / "two")
    stores.write_frontier(spark, None, versioned, first)
    stores.write_frontier(spark, first, done, second)
    table = spark.read.parquet(second)
    assert table.count() == 6
    assert table.filter("url = 'http://a.com/'").first()["status"] == "CRAWLED"
    assert {r["status"] for r in frontier.queued(rows).collect()} == {"QUEUED"}


def test_seeds(spark, tmp_path):
    path = tmp_path / "requests.json"
    requests = [
        {"url": " example.com ", "depth": 0}, {"url": "http://h.com/x", "depth": 2, "workers": 4}, {"url": "\t"}, {"depth": 1},
        {"url": "https://"}, {"url": "https://bad host/"}, {"url": "HTTP://h.com"}, {"url": "HTTPS.com/?q#f", "depth": -1},
    ]
    path.write_text("\n".join(map(json.dumps, requests)))
    rows = seeds.normalize(seeds.read_requests(spark, str(path))).collect()
    assert [(r["seed_url"], r["domain"], r["max_depth"], r["reason"]) for r in rows] == [
        ("https://example.com", "example.com", 3, ""),
        ("http://h.com/x", "h.com", 2, ""),
        (None, None, 3, "URL is required"),
        (None, None, 1, "URL is required"),
        (None, None, 3, "Invalid URL format"),
        (None, None, 3, "Invalid URL format"),
        ("https://HTTP://h.com", "HTTP", 3, ""),
        ("https://HTTPS.com/?q#f", "HTTPS.com", 3, ""),
    ]
    items = seeds.seed_items(seeds.normalize(seeds.read_requests(spark, str(path)).selectExpr("*", "now() AS at")), "at")
    assert {(r["url"], r["depth"], r["priority"], r["status"]) for r in items.collect()} >= {
        ("https://https.com/?q", 1, 1, "QUEUED"), ("http://h.com/x", 1, 1, "QUEUED")
    }


def test_fetch(spark):
    wanted = spark.createDataFrame([("u1", "d", 1), ("u2", "d", 2), ("u3", "d", 3), ("u4", "d", 9)], "url STRING, domain STRING, depth INT")
    big = bytearray(12 << 20)
    snapshot = spark.createDataFrame(
        [("u1", 200, "text/html", {"A": "b"}, bytearray(b"x"), 5), ("u2", 200, "t", {}, big, 7), ("u4", 301, "t", {}, bytearray(b""), 1)],
        "url STRING, status_code INT, content_type STRING, headers MAP<STRING,STRING>, body BINARY, fetch_time_ns BIGINT",
    )
    whole = {r["url"]: r for r in fetch.fetch(wanted, snapshot).collect()}
    assert (len(whole["u2"]["body"]), whole["u2"]["n_bytes"], whole["u2"]["error"]) == (12 << 20, 12 << 20, "")
    results = fetch.fetch(wanted, snapshot, max_body_bytes=10 << 20)
    got = {r["url"]: r for r in results.collect()}
    assert (got["u1"]["body"], got["u1"]["headers"], got["u1"]["error"]) == (b"x", {"A": "b"}, "")
    assert (got["u2"]["body"], got["u2"]["headers"], got["u2"]["status_code"]) == (None, None, 200)
    assert (got["u3"]["status_code"], got["u3"]["error"]) == (0, fetch.NOT_CAPTURED)
    checked = results.selectExpr("*", "url <> 'u1' AS allowed").withColumn("outcome", fetch.outcome(3))
    assert {r["url"]: r["outcome"] for r in checked.collect()} == {"u1": "BLOCKED", "u2": "ERROR", "u3": "ERROR", "u4": "SKIPPED"}
    assert {r["url"]: r["outcome"] for r in results.selectExpr("*", "true AS allowed").withColumn("outcome", fetch.outcome(9)).collect()}["u4"] == "301"
    assert urls_of(fetch.archivable(results)) == ["u1"]


def test_records_and_headers(spark, tmp_path):
    rows = spark.createDataFrame([("u", "d", 200, 1, 1_999_999, "")], "url STRING, domain STRING, status_code INT, depth INT, fetch_time_ns BIGINT, error STRING")
    stores.append_crawl_records(rows, str(tmp_path / "records"))
    stores.append_crawl_records(rows, str(tmp_path / "records"))
    saved = spark.read.parquet(str(tmp_path / "records"))
    assert saved.count() == 2 and saved.first()["fetch_time_ms"] == 1 and saved.first()["created_at"] is not None
    entries = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "e ARRAY<STRUCT<name: STRING, value: STRING>>")
    assert entries.select(fetch.headers_map(entries["e"])).first()[0] == {"a": "3", "b": "2"}


def test_submitted_seeds(spark):
    requests = spark.createDataFrame(
        [(1, "h.com/a", 2), (2, "https://h.com/a", 2), (3, "h.com/b", 0), (4, "", 1)], "seq INT, url STRING, depth INT"
    )
    seen = spark.createDataFrame([("https://h.com/b",)], "url STRING")
    rows = seeds.submit(requests, seen, "seq").orderBy("seq").collect()
    assert [(r["accepted"], r["message"], r["log_status"]) for r in rows] == [
        (True, "Seed URL queued: https://h.com/a (Depth: 2)", "QUEUED"),
        (False, "URL already crawled or queued in frontier", "ALREADY IN FRONTIER"),
        (False, "URL already crawled or queued in frontier", "ALREADY IN FRONTIER"),
        (False, "URL is required", None),
    ]


def test_overview(spark, rows):
    archive = spark.createDataFrame([("a.com", [("n", "0.00 MB", "t")]), ("unsorted", [])], "domain STRING, files ARRAY<STRUCT<name: STRING, size_mb: STRING, mod_time: STRING>>")
    entries = {(r["section"], r["entry"]) for r in overview.overview(rows, archive, "QUEUED").collect()}
    assert entries == {
        ("frontier_domains", '{"domain":"a.com","count":2}'), ("frontier_domains", '{"domain":"a.com-b","count":1}'),
        ("warc_domains", '{"domain":"a.com","files":[{"name":"n","size_mb":"0.00 MB","mod_time":"t"}]}'),
        ("warc_domains", '{"domain":"unsorted","files":[]}'),
    }
    assert overview.overview(rows, archive).filter("section = 'frontier_domains'").count() == 3


def test_upsert_ties(spark):
    rows = lambda *r: spark.createDataFrame(r, "url STRING, status STRING, version BIGINT")
    got = frontier.upsert(rows(("u", "QUEUED", 5), ("v", "QUEUED", 9)), rows(("u", "CRAWLED", 5), ("v", "FAILED", 8)))
    assert {(r["url"], r["status"]) for r in got.collect()} == {("u", "CRAWLED"), ("v", "QUEUED")}


def test_submit_compares_what_is_stored(spark):
    requests = spark.createDataFrame([(1, "https://H.com/a#x", 1), (2, "https://n.com", 1), (3, "https://N.com/", 1)], "seq INT, url STRING, depth INT")
    seen = spark.createDataFrame([("https://h.com/a",)], "url STRING")
    got = {r["seq"]: r["accepted"] for r in seeds.submit(requests, seen, "seq").collect()}
    assert got[1] is False and got[2] is True


def test_bodies_stay_out_of_shuffles(spark):
    from linkloom.plans import tables

    pages = tables.table(spark, "/root/testdata/sf0.001", "pages")
    plan = fetch.fetch(tables.frontier_rows(pages).select("url"), tables.snapshot(pages))._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan


def files_of(folder):
    return {str(f.relative_to(folder)): (f.stat().st_mtime_ns, f.read_bytes()) for f in folder.rglob("*.parquet")}


def test_update_writes_only_touched_buckets(spark, rows, tmp_path):
    path = str(tmp_path / "frontier")
    many = spark.range(500).selectExpr("concat('https://h/', id) AS url", "'QUEUED' AS status", "id % 7 AS depth", "0L AS version")
    stores.create_frontier(many.unionByName(many.withColumn("status", many["url"])), path, buckets=16)
    assert stores.read_frontier(spark, path).count() == 500
    before = files_of(tmp_path / "frontier" / "rows")
    done = spark.createDataFrame([(u, "CRAWLED", 1, 5) for u in ("https://h/3", "https://h/new")], "url STRING, status STRING, depth BIGINT, version BIGINT")
    late = spark.createDataFrame([("https://h/3", "FAILED", 1, 4)], done.schema)
    touched = stores.update_frontier(spark, path, done)
    after = files_of(tmp_path / "frontier" / "rows")
    changed = {name.split("/")[0] for name in before.keys() ^ after.keys()}
    assert 1 <= touched <= 2 and len(changed) == touched
    assert all(after[name] == before[name] for name in before if name.split("/")[0] not in changed)
    assert stores.update_frontier(spark, path, late) == 1 and stores.update_frontier(spark, path, done) == touched
    table = stores.read_frontier(spark, path)
    assert table.count() == 501 and table.filter("status = 'CRAWLED'").count() == 2
    one = stores.read_frontier(spark, path, "https://h/3")
    assert [(r["status"], r["version"]) for r in one.collect()] == [("CRAWLED", 5)]
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan and "xxhash64" not in scan
    assert stores.read_frontier(spark, path, "https://h/none").count() == 0


def test_update_with_odd_rows(spark, tmp_path):
    path, columns = str(tmp_path / "odd"), "url STRING, status STRING, version BIGINT"
    stores.create_frontier(spark.createDataFrame([], columns), path, buckets=4)
    assert stores.read_frontier(spark, path).count() == 0
    assert stores.update_frontier(spark, path, spark.createDataFrame([], columns)) == 0
    odd = spark.createDataFrame([(None, "A", 1), (None, "B", 2), ("", None, None), ("u", "A", 1), ("u", "A", 1)], columns)
    stores.update_frontier(spark, path, odd)
    got = {(r["url"], r["status"], r["version"]) for r in stores.read_frontier(spark, path).collect()}
    assert got == {(None, "B", 2), ("", None, None), ("u", "A", 1)}
    with pytest.raises(ValueError, match="positive"):
        stores.create_frontier(odd, str(tmp_path / "none"), buckets=0)


def scanned_rows(df):
    """Rows that the scan of a plan without adaptive execution gave."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_records_of_a_domain_skip_row_groups(spark, tmp_path):
    rows = spark.range(8000).selectExpr(
        "concat('https://d', id % 40, '/', id) AS url", "concat('d', id % 40) AS domain", "200 AS status_code", "1 AS depth",
        "id * 1000000 AS fetch_time_ns", "'' AS error",
    )
    path, whole = str(tmp_path / "records"), str(tmp_path / "compact")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "8k"}
    for name, value in small.items():  # several files, as large data would give
        spark.conf.set(name, value)
    try:
        stores.append_crawl_records(rows.filter("id < 4000"), path)
        stores.append_crawl_records(rows.filter("id >= 4000"), path)
        stores.compact_crawl_records(spark, path, whole)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for place in (path, whole):
            found = stores.domain_records(spark, place, "d7")
            assert found.count() == 200 and found.filter("url NOT LIKE 'https://d7/%'").count() == 0
            assert "EqualTo(domain,d7)" in found._jdf.queryExecution().executedPlan().toString()
            assert 200 <= scanned_rows(stores.domain_records(spark, place, "d7")) < 4001
            assert scanned_rows(stores.domain_records(spark, place, "d7777")) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        for name in small:
            spark.conf.unset(name)
