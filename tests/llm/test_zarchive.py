from __future__ import annotations

import hashlib
import random
import struct
from pathlib import Path

import pytest
import zstandard
from pyspark.errors import PySparkException

from linkloom.llm import zarchive

SCHEMA = "page_id BIGINT, url STRING, html STRING, digest STRING, first BIGINT"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def html(seed, words=400):
    rng = random.Random(seed)
    return "<html>" + " ".join(f"<p>{rng.choice(['the', 'ñandú', 'page'])} {rng.randrange(50)}</p>" for _ in range(words)) + "\r\n\r\n</html>"


def plain(rows):
    """Digest, size, type and first page of every row, by the rule alone."""
    out = []
    for page, _, text in rows:
        body = (text or "").encode()
        same = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        first = min(same, default=None)
        again = len(body) >= 100 and first is not None and page != first
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def read_back(spark, path):
    rows = zarchive.read_archive(spark, path).select(
        zarchive.key_of("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "warc_type",
        zarchive.key_of("refers_to").cast("long").alias("refers_to"),
    )
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def some_pages():
    rows = [(i, f"http://a.org/{i}?q=ü x\r\ny", html(i)) for i in range(60)]
    rows += [(100 + i, "http://b.org/", html(7)) for i in range(50)]  # copies of page 7
    rows += [(-5, "http://c.org/", html(9)), (200, None, None), (201, "u", ""), (202, "u", "x" * 99), (203, "u", "x" * 99)]
    rows += [(204, "u", "é" * 50), (205, "u", "é" * 50), (206, "u", "WARC/1.1\r\n\r\n" * 50), (None, "u", html(7)), (207, "u", html(1, 200_000))]
    return [*rows, rows[3], (300, "u", "only null"), (None, "u", "n" * 200), (None, "u", "n" * 200)]


def test_round_trip_equals_the_rule(spark, tmp_path):
    rows = some_pages()
    zarchive.write_archive(pages_of(spark, rows).repartition(4), str(tmp_path / "a"))
    assert read_back(spark, str(tmp_path / "a")) == plain(rows)
    got = {r["record_id"]: r for r in zarchive.read_archive(spark, str(tmp_path / "a")).collect()}
    assert bytes(got["urn:page:1"]["payload"]).decode() == html(1)
    assert got["urn:page:1"]["target_uri"] == "http://a.org/1?q=ü x%0D%0Ay" and got["urn:page:200"]["target_uri"] is None
    assert got["urn:page:100"]["payload"] is None and got["urn:page:100"]["refers_to"] == "urn:page:7"
    assert got["urn:page:206"]["http_status"] == 200


def test_files_begin_with_the_dictionary_and_hold_a_frame_per_record(spark, tmp_path):
    rows = [(i, "u", html(i)) for i in range(200)]
    zarchive.write_archive(pages_of(spark, rows).repartition(3), str(tmp_path / "a"))
    files = [f for f in (tmp_path / "a").glob("part-*") if f.stat().st_size]
    seen = 0
    for file in files:
        raw = file.read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        with file.open("rb") as stream:
            for offset, text in zarchive.frames(stream):
                assert unpack.decompressobj().decompress(raw[offset:]) == text
                zarchive.parse(text)
                seen += 1
    assert seen == 200


def test_empty_table_and_small_tables(spark, tmp_path):
    for n, rows in enumerate([[], [(1, "u", "a")], [(1, "u", None), (2, None, None)]]):
        zarchive.write_archive(pages_of(spark, rows), str(tmp_path / f"{n}"))
        assert read_back(spark, str(tmp_path / f"{n}")) == plain(rows)


def texts(n):
    return [zarchive.record(i, f"http://x/{i}", html(i).encode(), hashlib.sha256(html(i).encode()).hexdigest(), None, "2024-05-01T00:00:00Z", False) for i in range(n)]


def skippable(kind, content):
    return struct.pack("<II", kind, len(content)) + content


def test_archives_of_other_writers(spark, tmp_path):
    raw = zstandard.train_dictionary(4096, [t for t in texts(60)]).as_bytes()
    known = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    plainly = zstandard.ZstdCompressor()
    cases = {
        "packed": skippable(0x184D2A5D, plainly.compress(raw)) + b"".join(map(known.compress, texts(5))),
        "raw": skippable(0x184D2A5D, raw) + skippable(0x184D2A53, b"skip me" * 99) + b"".join(map(known.compress, texts(5))),
        "without": b"".join(map(plainly.compress, texts(5))),
        "info": plainly.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2024-05-01T00:00:00Z\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"),
    }
    for name, content in cases.items():
        (tmp_path / f"{name}.warc.zst").write_bytes(content)
        got = zarchive.read_archive(spark, str(tmp_path / f"{name}.warc.zst")).collect()
        if name == "info":
            assert [(r["warc_type"], bytes(r["payload"])) for r in got] == [("warcinfo", b"hi")]
        else:
            assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(html(i) for i in range(5))


def broken():
    pack = zstandard.ZstdCompressor(write_checksum=True).compress
    good = texts(3)
    longer = good[1].replace(b"Content-Length: ", b"Content-Length: 1", 1)
    return {
        "cut": (b"".join(map(pack, good))[:-5], 2),
        "length": (pack(good[0]) + pack(longer) + pack(good[2]), 2),
        "digest": (pack(good[0]) + pack(good[1].replace(b"sha256:", b"sha256:0")) + pack(good[2]), 2),
        "payload": (pack(good[0]) + pack(good[1].replace(b"<p>", b"<q>", 1)) + pack(good[2]), 2),
        "version": (pack(good[0]) + pack(good[1].replace(b"WARC/1.1", b"WARC/9.9", 1)) + pack(good[2]), 2),
        "no id": (pack(good[0]) + pack(good[1].replace(b"WARC-Record-ID", b"X-Record", 1)) + pack(good[2]), 2),
        "two in a frame": (pack(good[0]) + pack(good[1] + good[2]), 1),
        "not zstd": (pack(good[0]) + b"plain text", 1),
        "half a dictionary": (skippable(0x184D2A5D, b"abcdef")[:-2], 0),
    }


@pytest.mark.parametrize("name", list(broken()))
def test_broken_archives_fail_unless_told_otherwise(spark, tmp_path, name):
    content, left = broken()[name]
    path = Path(tmp_path) / "x.warc.zst"
    path.write_bytes(content)
    with pytest.raises(PySparkException, match="ArchiveError"):
        zarchive.read_archive(spark, str(path)).collect()
    assert zarchive.read_archive(spark, str(path), strict=False).count() == left
