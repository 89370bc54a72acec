"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.urls import decoded
from linkloom.llm.common import stored
from linkloom.sources.files import opened

# Fixed values of the formats.
FRAME = 0xFD2FB528
SKIPPABLE, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
DICTIONARY = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

#: Ends every record in a file: an empty skippable frame, which readers pass over. It is text, so Spark's writer can put it.
SEPARATOR = struct.pack("<II", SKIPPABLE, 0).decode()
#: Payloads below this size are always written whole.
MIN_BYTES = 100
#: Pages that the dictionary is trained on, their largest size, and the size of the dictionary.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 32 << 10, 110 << 10
#: A digest with more than this share of all pages is looked up by broadcast; there can be no more than its inverse.
HOT_SHARE = 1e-4
CHUNK = 256 << 10

RECORD_SCHEMA = (
    "path string, offset bigint, warc_type string, record_id string, target_uri string, warc_date string, "
    "refers_to string, payload_digest string, payload_bytes bigint, http_status int, payload binary"
)


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(pages: DataFrame, payload: str, key: str, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of payloads, those of the least hashes of keys; empty where it is too small to train on.

    It changes the size of archives, never what is read from them.
    """
    some = pages.filter(F.octet_length(payload).between(1, SAMPLE_BYTES))
    rows = some.count()
    share = min(1.0, SAMPLE_PAGES / max(1, rows))
    place = F.pmod(F.xxhash64(key), F.lit(1 << 20))
    chosen = some.filter(place <= F.lit(int(share * (1 << 20)))).select(F.col(payload).alias("p")).limit(2 * SAMPLE_PAGES)
    samples = [bytes(r["p"]) for r in chosen.collect()]
    if sum(map(len, samples)) < 8 * size or len(samples) < 8:
        size = sum(map(len, samples)) // 8
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if size >= 256 and len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _line(text: str) -> str:
    """A header value on one line: line ends are written as in a URL."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_uri(key: object) -> str:
    return f"urn:page:{'' if key is None else quote(str(key), safe='')}"


def key_of(uri: str) -> Column:
    """The key that a record's URI was made of, null where there is none."""
    key = decoded(F.regexp_extract(uri, r"^urn:page:(.+)$", 1))
    return F.when(key != "", key)


def record(key: object, url: str | None, payload: bytes, digest: str, first: object, date: str, is_revisit: bool) -> bytes:
    """Text of a response record, or of a revisit, which has the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{record_uri(key)}>",
        f"WARC-Date: {date}", *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <{record_uri(first)}>", f"WARC-Profile: {PROFILE}"] if is_revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}", "", "",
    ]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, digest, first)`` of rows ``(page_id, n_bytes, digest)`` whose payload a page of smaller id has.

    Digests that hold a large share of all rows meet their first page by a
    broadcast of at most ``1 / HOT_SHARE`` rows, others in a shuffle; payloads
    are not touched.
    """
    large = pages.filter(F.col("n_bytes") >= min_bytes)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = groups.filter((F.col("n") > 1) & F.col("first").isNotNull())
    edge = int(large.count() * HOT_SHARE)
    hot = F.broadcast(shared.filter(F.col("n") > edge).select("digest", F.col("first").alias("hot_first")))
    spread = large.join(hot, "digest", "left")
    known = spread.filter("hot_first IS NOT NULL").select("page_id", "digest", F.col("hot_first").alias("first"))
    rest = spread.filter("hot_first IS NULL").select("page_id", "digest")
    found = known.unionByName(rest.join(shared.filter(F.col("n") <= edge).select("digest", "first"), "digest"))
    return found.filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()


def write_archive(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
    at: datetime | None = None, min_bytes: int = MIN_BYTES, level: int = 3,
) -> None:
    """Write a WARC record per page below ``path``, which is new; one file per task, through Spark's commit protocol.

    Of the pages of equal payloads of at least ``min_bytes`` bytes the one with
    the smallest key is a response and the others are revisits of it; a row that
    repeats key and payload of the response is a response too. A null payload
    is empty; a null key is never the smallest unless all are null, when all are
    responses; a null URL leaves its header out. An empty table gives an archive
    without records. Other columns are ignored, whatever their names.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    dictionary = train_dictionary(rows, "payload", "page_id")
    again = revisits(stored(rows.select("page_id", "n_bytes", "digest"), "digests"), min_bytes)
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    same = rows["page_id"].eqNullSafe(F.col("_id")) & (rows["digest"] == F.col("_digest"))
    marked = rows.join(again, same, "left").select("page_id", "url", "payload", "digest", "first")
    date = (at or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def work(batches):
        options = {"level": level, "write_checksum": True}
        if dictionary:
            options["dict_data"] = zstandard.ZstdCompressionDict(dictionary)
            options["dict_data"].precompute_compress(level=level)
        packer, leading = zstandard.ZstdCompressor(**options), b""
        if dictionary:
            leading = struct.pack("<II", DICTIONARY, len(dictionary)) + dictionary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                frames = []
                for row in batch.slice(at, 256).to_pylist():
                    text = record(
                        row["page_id"], row["url"], row["payload"], row["digest"], row["first"], date, row["first"] is not None
                    )
                    frames.append(leading + packer.compress(text))
                    leading = b""
                yield pa.record_batch({"frame": pa.array(frames, pa.binary())})

    frames = marked.mapInArrow(work, "frame binary").select(F.col("frame").cast("string").alias("value"))
    # One file per task: its first row brings the dictionary.
    frames.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).text(path)


class _Bytes:
    """Bytes of a file in order, read in chunks."""

    def __init__(self, file):
        self.file, self.at, self.rest = file, 0, b""

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left of the file."""
        parts, have = [], 0
        while have < n:
            if not self.rest:
                self.rest = self.file.read(max(CHUNK, n - have))
                if not self.rest:
                    break
            parts.append(self.rest[: n - have])
            self.rest = self.rest[n - have :]
            have += len(parts[-1])
        self.at += have
        return b"".join(parts)

    def chunk(self) -> bytes:
        return self.take(len(self.rest) or CHUNK)

    def give_back(self, data: bytes) -> None:
        self.at -= len(data)
        self.rest = data + self.rest


def frames(file) -> Iterator[tuple[int, bytes]]:
    """``(offset, text)`` of every Zstandard frame of a file, decoded with the dictionary of its leading frame.

    The dictionary may itself be a Zstandard frame. Other skippable frames are
    passed over. Memory holds one frame at a time.
    """
    stream, dictionary = _Bytes(file), None
    while True:
        offset, magic = stream.at, stream.take(4)
        if not magic:
            return
        number = struct.unpack("<I", magic)[0] if len(magic) == 4 else 0
        if number & SKIPPABLE_MASK == SKIPPABLE:
            size = stream.take(4)
            if len(size) < 4:
                raise ArchiveError(f"ends inside a frame at byte {offset}")
            left = struct.unpack("<I", size)[0]
            if offset == 0 and number == DICTIONARY:
                content = stream.take(left)
                left -= len(content)
                if content[:4] == struct.pack("<I", FRAME):
                    content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
                dictionary = zstandard.ZstdCompressionDict(content)
            while left and (part := stream.take(min(left, CHUNK))):
                left -= len(part)
            if left:
                raise ArchiveError(f"ends inside a frame at byte {offset}")
        elif number == FRAME:
            stream.give_back(magic)
            unpack, parts = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(), []
            while not unpack.eof:
                part = stream.chunk()
                if not part:
                    raise ArchiveError(f"ends inside a frame at byte {offset}")
                try:
                    parts.append(unpack.decompress(part))
                except zstandard.ZstdError as error:
                    raise ArchiveError(f"broken frame at byte {offset}: {error}") from error
            stream.give_back(unpack.unused_data)
            yield offset, b"".join(parts)
        else:
            raise ArchiveError(f"no frame at byte {offset}")


def headers(head: bytes) -> dict[str, str]:
    """Names, lower-case, and values of the lines after the first; a line without a colon is an error."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"header line without a name: {line[:80]!r}")
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def _length(head: dict[str, str], name: str = "content-length") -> int:
    if not re.fullmatch(r"[0-9]+", head.get(name, "")):
        raise ArchiveError(f"{name} is {head.get(name)!r}")
    return int(head[name])


def parse(text: bytes) -> tuple[dict[str, str], dict[str, str], int, bytes]:
    """WARC headers, HTTP headers, HTTP status and payload of the one record in a frame; an error where they do not agree."""
    head, ended, rest = text.partition(b"\r\n\r\n")
    if not ended or head.split(b"\r\n", 1)[0] not in VERSIONS:
        raise ArchiveError(f"no record: {text[:40]!r}")
    warc = headers(head)
    missing = [name for name in REQUIRED if not warc.get(name)]
    if missing:
        raise ArchiveError(f"record without {', '.join(missing)}")
    if len(rest) != _length(warc) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError(f"block of {len(rest) - 4} bytes where {warc['content-length']} are announced")
    block = rest[:-4]
    if not warc.get("content-type", "").startswith("application/http"):
        return warc, {}, 0, block
    http_head, ended, payload = block.partition(b"\r\n\r\n")
    status = http_head.split(b"\r\n", 1)[0].split(b" ", 2)
    if not ended or len(status) < 2 or not status[1].isdigit():
        raise ArchiveError(f"no HTTP head: {block[:40]!r}")
    http = headers(http_head)
    if warc["warc-type"] == "response":
        if "content-length" in http and len(payload) != _length(http):
            raise ArchiveError(f"payload of {len(payload)} bytes where {http['content-length']} are announced")
    elif payload:
        raise ArchiveError(f"{warc['warc-type']} record with a payload")
    return warc, http, int(status[1]), payload


def _uri(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">") if value else None


def _row(path: str, offset: int, text: bytes) -> dict:
    warc, http, status, payload = parse(text)
    kind, digest, written = warc["warc-type"], None, warc.get("warc-payload-digest", "")
    if kind == "revisit":
        digest, size, payload = written.removeprefix("sha256:") or None, None, None
        if "content-length" in http:
            size = _length(http)
    else:
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        if written.startswith("sha256:") and written != f"sha256:{digest}":
            raise ArchiveError(f"payload digest {digest} where {written} is announced")
    return {
        "path": path, "offset": offset, "warc_type": kind, "record_id": _uri(warc["warc-record-id"]),
        "target_uri": warc.get("warc-target-uri"), "warc_date": warc["warc-date"], "refers_to": _uri(warc.get("warc-refers-to")),
        "payload_digest": digest, "payload_bytes": size, "http_status": status, "payload": payload,
    }


_ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()),
    ("target_uri", pa.string()), ("warc_date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("http_status", pa.int32()), ("payload", pa.binary()),
])


def _records(path: str, strict: bool) -> Iterator[dict]:
    with opened(path) as file:
        found = frames(file)
        while True:
            try:
                offset, text = next(found)
            except StopIteration:
                return
            except ArchiveError as error:  # beyond a broken frame there is no next one
                if strict:
                    raise ArchiveError(f"{path}: {error}") from error
                return
            try:
                row = _row(path, offset, text)
            except ArchiveError as error:
                if strict:
                    raise ArchiveError(f"{path}, record at byte {offset}: {error}") from error
                continue
            yield row


def read_archive(spark: SparkSession, path: str, strict: bool = True, with_payload: bool = True) -> DataFrame:
    """Records of all archive files below ``path``, a row each; see ``RECORD_SCHEMA``.

    Digest and size are those of the full payload: computed from what was read,
    and for revisits, which have no payload, those that the record states. A
    broken frame, header, length or digest fails the read; with
    ``strict=False`` the record is passed over, and a file's rest where no next
    frame can be found. Spark lists and deals out the files; a task streams
    them, one frame in memory at a time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")

    def work(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                for row in _records(file, strict):
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return files.mapInArrow(work, RECORD_SCHEMA)
