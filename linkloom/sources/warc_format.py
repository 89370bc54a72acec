"""The ``warc`` data source: ``spark.read.format("warc").load(path)``, in SQL ``USING warc OPTIONS (path '...')``, and as a stream."""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from linkloom.operators.archive import UNSORTED
from linkloom.sources.files import opened, store_of
from linkloom.sources.members import Record, Unzipped, records

SCHEMA = (
    "domain STRING, warc_type STRING, record_id STRING, warc_date TIMESTAMP, target_uri STRING, content_length BIGINT, "
    "http_status INT, http_content_type STRING, payload BINARY, path STRING, offset BIGINT, length BIGINT"
)
BATCH_BYTES = 4 << 20
#: How long a stream remembers a file, counted from the newest one; older files that turn up are passed over.
MAX_FILE_AGE = "604800"

ARROW = pa.schema([
    ("domain", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("warc_date", pa.timestamp("us", "UTC")),
    ("target_uri", pa.string()), ("content_length", pa.int64()), ("http_status", pa.int32()), ("http_content_type", pa.string()),
    ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


@dataclass
class File(InputPartition):
    """One archive file."""

    path: str
    domain: str
    changed: float = 0.0
    value: int = 0


def domain_of(path: str, root: str) -> str:
    """Domain of a file below the root: its ``domain=`` folder, else its first folder, else ``unsorted``."""
    inside = path.removeprefix(root.rstrip("/") + "/")
    named = re.search(r"(?:^|/)domain=([^/]*)/", inside)
    first = inside.split("/", 1)[0] if "/" in inside else ""
    return unquote(named[1] if named and named[1] else first) or UNSORTED


def files_below(path: str) -> list[File]:
    """Archive files below a folder, or the file itself; names that begin with ``_`` or ``.`` are not data."""
    store, inside, prefix = store_of(path)
    infos = [store.get_file_info(inside)]
    if infos[0].type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = inside if infos[0].type == fs.FileType.Directory else inside.rsplit("/", 1)[0]
    if infos[0].type == fs.FileType.Directory:
        infos = store.get_file_info(fs.FileSelector(inside, recursive=True))
    hidden = lambda p: any(part[:1] in ("_", ".") for part in p[len(root) :].strip("/").split("/"))
    found = [i for i in infos if i.type == fs.FileType.File and i.size and not hidden(i.path)]
    return [File(prefix + i.path, domain_of(i.path, root), i.mtime.timestamp()) for i in sorted(found, key=lambda i: i.path)]


def moment(text: str | None) -> datetime | None:
    """Time of a record's date, None where it is none."""
    try:
        at = datetime.fromisoformat((text or "").replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def as_row(file: File, record: Record, at: datetime | None) -> dict:
    named = re.fullmatch(r"<urn:uuid:(.*)>", record.record_id)
    return {
        "domain": file.domain, "warc_type": record.warc_type, "record_id": named[1] if named else "", "warc_date": at,
        "target_uri": record.target_uri, "content_length": record.content_length, "http_status": record.http_status,
        "http_content_type": record.http_content_type, "payload": record.payload, "path": file.path, "offset": record.offset,
        "length": record.length,
    }


def _aware(value: datetime) -> datetime:
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def read_file(file: File, strict: bool = True, dates: Sequence[tuple] = ()) -> Iterator[pa.RecordBatch]:
    """The records of one file, streamed; those whose date a comparison refuses are passed over."""
    with opened(file.path) as data:
        rows, held = [], 0
        for record in records(Unzipped(data, file.path), strict):
            at = moment(record.warc_date)
            if not all(at is not None and compare(at, value) for compare, value in dates):
                continue
            rows.append(as_row(file, record, at))
            held += len(record.payload) + 500
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        if not self.path:
            raise ValueError("the warc source needs a path")
        self.within = options.get("within", "")
        self.strict = options.get("strict", "true").lower() != "false"
        self.domains: set[str] | None = None
        self.dates: list[tuple] = []

    def read(self, file: File | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if file is None else read_file(file, self.strict, self.dates)  # None: no file is wanted


class WarcReader(_Reader, DataSourceReader):
    """A partition per file; a filter on the domain leaves out files, one on the date records."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute == ("domain",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.domains = wanted if self.domains is None else self.domains & wanted
                continue  # a file has one domain, so nothing is left to test
            if f.attribute == ("warc_date",) and type(f) in _COMPARED and isinstance(f.value, datetime):
                self.dates.append((_COMPARED[type(f)], _aware(f.value)))
                continue
            yield f

    def partitions(self) -> list[File]:
        wanted = lambda f: self.within in f.path and (self.domains is None or f.domain in self.domains)
        return [f for f in files_below(self.path) if wanted(f)]


class WarcStreamReader(_Reader, DataSourceStreamReader):
    """Files as they appear below the path. An offset holds the files that still count as recent, by hash.

    A file that turns up with a time more than ``maxFileAge`` seconds before the
    newest one is passed over; all others are read once, in whatever order they appear.
    """

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.age = float(options.get("maxFileAge", MAX_FILE_AGE))

    @staticmethod
    def _name(file: File) -> str:
        return hashlib.sha256(file.path.encode()).hexdigest()[:20]

    def initialOffset(self) -> dict:
        return {"newest": 0.0, "seen": []}

    def latestOffset(self) -> dict:
        files = files_below(self.path)
        newest = max((f.changed for f in files), default=0.0)
        return {"newest": newest, "seen": sorted(self._name(f) for f in files if f.changed >= newest - self.age)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        before, now = set(start["seen"]), set(end["seen"])
        late = start["newest"] - self.age
        return [f for f in files_below(self.path) if (n := self._name(f)) in now and n not in before and f.changed >= late]

    def commit(self, end: dict) -> None:
        pass


class WarcDataSource(DataSource):
    """Archives of gzip members below ``path``; ``strict`` as in ``read_warc``; ``within`` is a part of the paths wanted."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def streamReader(self, schema) -> WarcStreamReader:
        return WarcStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
