from __future__ import annotations

import gzip
from pathlib import Path

import pytest

from linkloom.operators import archive
from linkloom.sources import listing, warc

SCHEMA = "url STRING, domain STRING, status_code INT, content_type STRING, body BINARY, error STRING, at TIMESTAMP"
NASTY = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n\r\n\r\n\xff\xfe\x00 end"


@pytest.fixture()
def results(spark):
    import datetime as dt

    at = dt.datetime(2024, 5, 6, 7, 8, 9)
    rows = [
        ("https://a.com/1", "a.com", 200, "text/html", b"<p>one</p>\n\r\n\r\ntwo", "", at),
        ("https://a.com/2", "a.com", 301, "text/plain; charset=utf-8", "grün €".encode(), "", at),
        ("https://b.com/ü?x", "b.com:80", 200, "a/b", NASTY, "", at),
        ("https://c.com/", "", 200, "", b"\r\n\r\n", "", at),
        ("https://a.com/empty", "a.com", 200, "x", b"", "", at),
        ("https://a.com/zero", "a.com", 0, "x", b"x", "", at),
        ("https://a.com/gone", "a.com", 404, "x", b"x", "", at),
        ("https://a.com/failed", "a.com", 200, "x", b"x", "fetch error", at),
    ]
    return spark.createDataFrame([(*r[:4], bytearray(r[4]), *r[5:]) for r in rows], SCHEMA)


def kept(results):
    return {(r["domain"] or "unsorted", r["url"], r["status_code"], r["content_type"], bytes(r["body"])) for r in results.collect()[:4]}


def read(spark, path):
    return {
        (r["domain"], r["target_uri"], r["http_status"], r["http_content_type"], bytes(r["payload"]))
        for r in warc.read_warc(spark, path).collect()
    }


def test_round_trip(spark, results, tmp_path):
    warc.write_warc(results, str(tmp_path), "at")
    assert read(spark, str(tmp_path)) == kept(results)
    row = warc.read_warc(spark, str(tmp_path)).filter("target_uri = 'https://a.com/1'").first()
    assert row["warc_type"] == "response" and str(row["warc_date"]) == "2024-05-06 07:08:09"
    assert len(row["record_id"]) == 36


def test_files_are_plain_gzip(spark, results, tmp_path):
    warc.write_warc(results, str(tmp_path), "at", "20240506_070809")
    files = sorted(Path(tmp_path).rglob("*.gz"))
    assert len(files) == 3 and all("run=20240506_070809" in str(f) for f in files)
    text = gzip.decompress(next(f for f in files if "domain=a.com" in str(f)).read_bytes())
    assert text.startswith(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:")
    assert b"\r\nContent-Type: text/html\r\nContent-Length: 18\r\n\r\n<p>one</p>" in text
    assert text.endswith(b"\r\n\r\n")


def test_other_writers_files(spark, tmp_path):
    record = (
        b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n"
        b"WARC-Target-URI: https://x/\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n"
    )
    http = b"HTTP/1.1 200 OK\r\nContent-Type: t\r\n\r\nbody"
    one = record % (len(http), http)
    (tmp_path / "x.com").mkdir()
    (tmp_path / "x.com" / "crawl_1.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(one))
    (tmp_path / "x.com" / "crawl_2.warc.gz").write_bytes(gzip.compress(one + one[:90]))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_warc(spark, str(tmp_path)).collect()
    rows = warc.read_warc(spark, str(tmp_path), strict=False).collect()
    assert [(r["domain"], r["payload"], r["content_length"]) for r in rows] == [("x.com", b"body", len(http))] * 3


def test_plain_files_are_refused(spark, tmp_path):
    (tmp_path / "x.com").mkdir()
    (tmp_path / "x.com" / "a.warc").write_bytes(b"WARC/1.0\r\nContent-Length: 1\r\n\r\nx\r\n\r\n" * 200)
    for read in (lambda: warc.read_warc(spark, str(tmp_path)), lambda: warc.preview(spark, str(tmp_path), 1, 3)):
        with pytest.raises(Exception, match="not a gzip archive"):
            read().collect()


def test_record_without_length_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx\r\n\r\n"))
    with pytest.raises(Exception, match="without a length"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_many_captures_of_one_url_make_several_files(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "'https://hot/' AS url", "'hot' AS domain", "200 AS status_code", "'t' AS content_type",
        "CAST(concat(id, repeat(sha2(string(id), 256), 20)) AS BINARY) AS body", "'' AS error", "timestamp'2024-01-01' AS at",
    ).repartition(8)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        warc.write_warc(rows, str(tmp_path), "at")
    finally:
        spark.conf.unset(size)
    assert len(list(Path(tmp_path).rglob("*.gz"))) > 1
    assert warc.read_warc(spark, str(tmp_path)).select("payload").distinct().count() == 3000


def test_domain_below_a_root_that_recurs(spark, tmp_path):
    root = tmp_path / "w"
    (root / "a" / "w").mkdir(parents=True)
    (root / "a" / "w" / "b.gz").write_bytes(gzip.compress(b"x"))
    assert [r["domain"] for r in warc.manifest(spark, str(root)).collect()] == ["a"]


def test_truncated_gzip_is_an_error(spark, tmp_path):
    data = gzip.compress(bytes(range(256)) * 50)
    (tmp_path / "t.gz").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="(?i)unexpected end|EOF"):
        warc.read_warc(spark, str(tmp_path)).collect()


def test_listing_and_manifest(spark, results, tmp_path):
    warc.write_warc(results.filter("domain <> ''"), str(tmp_path), "at")
    listed = {r["domain"]: r["files"] for r in warc.list_archive(spark, str(tmp_path)).collect()}
    assert set(listed) == {"a.com", "b.com:80", "unsorted"}
    assert listed["unsorted"] == [] and listed["a.com"][0]["size_mb"] == "0.00 MB"
    assert listed["a.com"][0]["name"].endswith(".gz") and len(listed["a.com"][0]["mod_time"]) == 19
    files = warc.manifest(spark, str(tmp_path))
    assert files.count() == 2
    plan = archive.publish_plan(files, "bucket").collect()
    assert all(p["uri"] == f"r2://bucket/warc/{p['domain']}/" + p["path"].rsplit("/", 1)[1] for p in plan)


def test_listing_with_unsorted(spark, results, tmp_path):
    warc.write_warc(results, str(tmp_path), "at")
    listed = [r["domain"] for r in warc.list_archive(spark, str(tmp_path)).collect()]
    assert sorted(listed) == ["a.com", "b.com:80", "unsorted"]


def test_listing_does_not_read_contents(spark, results, tmp_path):
    warc.write_warc(results, str(tmp_path), "at")
    plan = warc.list_archive(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split(">")[0]


def test_colliding_names(spark):
    files = spark.createDataFrame([("/w/a/n.gz", "a"), ("/w/b/n.gz", "b"), ("/w/b/m.gz", "b")], "path STRING, domain STRING")
    assert {r["path"]: r["collides"] for r in archive.publish_plan(files, "x").collect()} == {
        "/w/a/n.gz": True, "/w/b/n.gz": True, "/w/b/m.gz": False
    }


@pytest.mark.parametrize(
    ("args", "span"),
    [({}, (1, 100)), ({"from_": 0, "lines": 0}, (1, 100)), ({"from_": 5, "lines": 10}, (5, 14)), ({"from_": 5, "to": 7}, (5, 7)),
     ({"from_": 5, "to": 4}, (5, 104)), ({"to": 9999}, (1, 9999)), ({"lines": 2001}, (1, 2001)), ({"lines": 2000}, (1, 2000))],
)
def test_line_span(args, span):
    assert archive.line_span(**args) == span


def test_preview(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("one", "two"):
        text = "".join(f"{name} {i}\r\n" for i in range(1, 30_001))
        (tmp_path / "d" / f"{name}.warc.gz").write_bytes(gzip.compress(text.encode() + b"\xff\n"))
    got = warc.preview(spark, str(tmp_path), 29_999, 30_002).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["line_no"], r["line"]) for r in got} == {
        (f"{n}.warc.gz", i, f"{n} {i}" if i <= 30_000 else "�") for n in ("one", "two") for i in range(29_999, 30_002)
    }


def test_text_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\n\nd\n"), (2, ""), (3, "x")], "id INT, text STRING")
    got = archive.text_lines(df, "id", "text", 2, 3).collect()
    assert {tuple(r) for r in got} == {(1, 2, "b"), (1, 3, "")}


def test_archive_file():
    assert warc.archive_file("/w/", "../a.com", "../../x.gz") == "/w/a.com/x.gz"
    assert warc.archive_file("/w", "", "x.gz") == "/w/x.gz"
    with pytest.raises(ValueError):
        warc.archive_file("/w", "a.com", "")


def test_listing_passes_over_files_at_the_root(spark, results, tmp_path):
    warc.write_warc(results.filter("domain = 'a.com'"), str(tmp_path / "batch=0"), "at")
    (tmp_path / "stray.gz").write_bytes(gzip.compress(b"x"))
    assert sorted(r["domain"] for r in warc.list_archive(spark, str(tmp_path)).collect()) == ["a.com", "unsorted"]


def test_no_results(spark, results, tmp_path):
    warc.write_warc(results.limit(0), str(tmp_path / "none"), "at")
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_record_dates_are_utc_in_any_session(spark, results):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = spark.sql("SELECT timestamp'2024-05-06 03:08:09' AS at")
        one = results.limit(1).drop("at").join(at)
        assert "WARC-Date: 2024-05-06T07:08:09Z" in archive.with_record_text(one, "at").first()["header"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_files_with_empty_folders(spark, tmp_path):
    for folder in ("a.com", "domain=b%3A80/run=1", "domain=b%3A80/run=2", "domain=b%3A80/notes", "empty", "_temporary", ".hidden", "unsorted"):
        (tmp_path / folder).mkdir(parents=True)
    sizes = {"a.com/x.gz": 0, "domain=b%3A80/run=1/y.gz": 1 << 20, "domain=b%3A80/run=2/y.gz": 3, "domain=b%3A80/notes/n.txt": 9, "a.com/_SUCCESS": 0, "root.gz": 5}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(b"x" * size)
    rows = listing.list_files(spark, str(tmp_path))
    got = {(r["domain"], r["run"], r["name"], r["bytes"], r["size_mb"]) for r in rows.collect()}
    assert got == {
        ("a.com", None, "x.gz", 0, "0.00 MB"), ("b:80", "1", "y.gz", 1 << 20, "1.00 MB"), ("b:80", "2", "y.gz", 3, "0.00 MB"),
        ("empty", None, None, None, None), ("unsorted", None, None, None, None),
    }
    assert rows.count() == 5 and len(rows.filter("bytes = 3").first()["mod_time"]) == 19
    (tmp_path / "empty" / "nothing").mkdir()
    assert [tuple(r)[:3] for r in listing.list_files(spark, f"file:{tmp_path}/empty").collect()] in (
        [("nothing", None, None), ("unsorted", None, None)], [("unsorted", None, None), ("nothing", None, None)]
    )
