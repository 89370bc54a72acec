"""Gzip archives read as streams: records one after the other, and where in the file each can be found again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO, NamedTuple

CHUNK = 256 << 10
CRLF2 = b"\r\n\r\n"


class Unzipped:
    """Bytes behind a file of gzip members, read in order; memory holds what was asked for and a chunk.

    ``starts`` has the place of every member that began since it was last
    emptied, in the unzipped bytes and in the file.
    """

    def __init__(self, file: BinaryIO, path: str):
        self.file, self.path = file, path
        self.position = 0  # unzipped bytes handed out
        self.bytes_read = 0  # bytes of the file
        self.starts: list[tuple[int, int]] = []
        self._raw, self._raw_at = b"", 0
        self._held = bytearray()
        self._member: Any = None

    def _more(self) -> bool:
        """Unzip some more; False at the end of the file."""
        if not self._raw:
            self._raw = self.file.read(CHUNK)
            self.bytes_read += len(self._raw)
            if not self._raw:
                if self._member is not None:
                    raise EOFError(f"{self.path}: unexpected end of a gzip member")
                return False
        if self._member is None:
            if not b"\x1f\x8b".startswith(self._raw[:2]):
                raise ValueError(f"not a gzip archive: {self.path}")
            self.starts.append((self.position + len(self._held), self._raw_at))
            self._member = zlib.decompressobj(31)
        before = len(self._raw)
        self._held += self._member.decompress(self._raw, 4 * CHUNK)
        self._raw = self._member.unused_data if self._member.eof else self._member.unconsumed_tail
        self._raw_at += before - len(self._raw)
        if self._member.eof:
            self._member = None
        return True

    def _take(self, n: int) -> bytes:
        out = bytes(self._held[:n])
        del self._held[:n]
        self.position += len(out)
        return out

    def read(self, n: int) -> bytes:
        """The next ``n`` bytes, or what is left."""
        while len(self._held) < n and self._more():
            pass
        return self._take(n)

    def until(self, end: bytes) -> bytes | None:
        """The bytes up to and with the next ``end``; None if there is none."""
        looked = 0
        while True:
            at = self._held.find(end, looked)
            if at >= 0:
                return self._take(at + len(end))
            looked = max(0, len(self._held) - len(end) + 1)
            if not self._more():
                return None

    def rest(self) -> bytes:
        while self._more():
            pass
        return self._take(len(self._held))

    def at_member(self) -> int | None:
        """Where in the file a member starts that begins here, if one does; of several the last, as others are empty."""
        while not self._held and self._more():
            pass
        here = [offset for place, offset in self.starts if place == self.position]
        self.starts = [s for s in self.starts if s[0] > self.position]
        return here[-1] if here else None

    def file_position(self) -> int:
        return self._raw_at


class Record(NamedTuple):
    """One archive record; ``offset`` and ``length`` are its place in the file where members begin and end with it."""

    offset: int | None
    length: int | None
    warc_type: str
    record_id: str
    warc_date: str | None
    target_uri: str
    content_length: int
    http_status: int
    http_content_type: str
    payload: bytes


def headers(block: bytes) -> dict[str, str]:
    """Names, lower-case, and values of the lines after the first."""
    pairs = (line.partition(b":") for line in block.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def record_of(head: bytes, block: bytes, offset: int | None = None, length: int | None = None) -> Record:
    warc = headers(head)
    http, _, payload = block.partition(CRLF2)
    status = http.split(b" ", 2)[1:2]
    return Record(
        offset, length, warc.get("warc-type", ""), warc.get("warc-record-id", ""), warc.get("warc-date"),
        warc.get("warc-target-uri", ""), len(block), int(status[0]) if status and status[0].isdigit() else 0,
        headers(http).get("content-type", ""), payload,
    )


def records(stream: Unzipped, strict: bool = True) -> Iterator[Record]:
    """Records of a stream, cut by their Content-Length, one in memory at a time.

    A file that ends inside a record, or has one without a length, is an error;
    with ``strict=False`` its rest is passed over.
    """
    while True:
        start = stream.at_member()
        head = stream.until(CRLF2)
        if head is None:
            left = stream.rest()
            if strict and left.strip():
                raise ValueError(f"{stream.path} ends inside a record: {left[:200]!r}")
            return
        head = head[head.find(b"WARC/") :] if b"WARC/" in head else b""
        size = headers(head).get("content-length", "")
        if not head or not size.isdigit():
            if strict:
                raise ValueError(f"{stream.path} has a record without a length: {head[:200]!r}")
            return
        block = stream.read(int(size))
        end = stream.read(len(CRLF2))
        if len(block) < int(size) or end != CRLF2:
            if strict:
                raise ValueError(f"{stream.path} ends inside a record: {head[:200]!r}")
            return
        whole = start is not None and not stream._held and stream._member is None
        yield record_of(head, block, start, stream.file_position() - start if whole else None)


def lines(stream: Unzipped, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines ``start`` to ``end`` with their numbers, from 1; nothing behind the last of them is read."""
    for number in range(1, end + 1):
        line = stream.until(b"\n")
        if line is None:
            line = stream.rest()
            if line and number >= start:
                yield number, line
            return
        if number >= start:
            yield number, line[:-1]
