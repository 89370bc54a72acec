"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Bytes become printable characters one to one, every ranked byte string is a
piece with the score ``-rank``, and normalisation is the identity, so the best
scored merge of sentencepiece is the lowest ranked merge of the rank file.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import struct
from functools import lru_cache
from itertools import chain
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.common import ENTRY_BYTES, map_slices, strings

#: Bytes of the chunks of text, and as many of pre-tokens, whose ids a worker remembers during a task; beyond them a memory starts anew.
CACHE_BYTES = 96 << 20
#: Text bytes encoded at a time.
SLICE_BYTES = 4 << 20

# Field numbers and kinds of the sentencepiece model format.
_PIECES, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _BPE = 1, 2, 2


def _byte_chars() -> list[str]:
    """A printable character for each byte: itself where it prints, else one above U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


#: A space after white space that more white space or the end follows: no pre-token ends before it.
_INSIDE = re.compile(r" (?<=\s )(?=\s|\Z)")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
BYTE_CHARS = _byte_chars()
_TO_CHARS = str.maketrans(dict(enumerate(BYTE_CHARS)))


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in order of rank."""
    with open(path, "rb") as lines:
        rows = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in rows)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _piece(text: str, score: float, kind: int) -> bytes:
    body = _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind)
    return _block(_PIECES, body)


def model_bytes(tokens: list[bytes]) -> bytes:
    """Serialised sentencepiece BPE model of ranked byte strings; the id of a piece is its rank."""
    pieces = [_piece(t.decode("latin-1").translate(_TO_CHARS), -rank, _NORMAL) for rank, t in enumerate(tokens)]
    pieces.append(_piece("", 0, _UNKNOWN))
    trainer = _number(3, _BPE) + _number(4, len(pieces)) + _number(40, len(tokens))
    trainer += b"".join(_number(field, -1) for field in (41, 42, 43)) + _block(45, "".encode())
    normalizer = _block(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join(pieces) + _block(_TRAINER, trainer) + _block(_NORMALIZER, normalizer)


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.split = regex.compile(pattern).findall
        self.text_of = [str(rank) for rank in range(len(self.tokens))]
        self.merged: dict[str, tuple[int, ...]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.held = [0, 0]

    def forget(self) -> None:
        self.merged.clear()
        self.known.clear()
        self.held = [0, 0]

    def _learn(self, memory: int, token: str, ids: tuple[int, ...]) -> None:
        (self.merged, self.known)[memory][token] = ids
        self.held[memory] += getsizeof(token) + getsizeof(ids) + ENTRY_BYTES

    def _merge(self, tokens: set[str]) -> None:
        """Learn the ids of pre-tokens: one id where the whole is ranked, else the merges of the model."""
        if self.held[0] > CACHE_BYTES:
            self.merged.clear()
            self.held[0] = 0
        rest: list[str] = []
        for token in tokens - self.merged.keys():
            rank = self.whole.get(token.encode())
            if rank is None:
                rest.append(token)
            else:
                self._learn(0, token, (rank,))
        shown = [token.encode().decode("latin-1").translate(_TO_CHARS) for token in rest]
        for token, ids in zip(rest, self.model.encode(shown, num_threads=1), strict=True):
            self._learn(0, token, tuple(ids))

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text.

        The pattern ends a pre-token before every space but those inside or at
        the end of a run of white space, so the stretches between spaces are
        encoded, and remembered, one by one. A text with such a run is cut only
        at spaces that have no white space on either side.
        """
        collecting = gc.isenabled()
        gc.disable()  # millions of tuples come and go here and none in a cycle: looking for cycles costs a sixth
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        cut = [_SINGLE.split(t) if _INSIDE.search(t) else t.split(" ") for t in texts]
        if self.held[1] > CACHE_BYTES:
            self.known.clear()
            self.held[1] = 0
        fresh = {chunk for chunks in cut for chunk in chunks[1:]} - self.known.keys()
        split = {chunk: self.split(" " + chunk) for chunk in fresh}
        heads = [self.split(chunks[0]) for chunks in cut]
        self._merge(set(chain.from_iterable(heads)).union(*split.values()))
        merged, known = self.merged, self.known
        for chunk, tokens in split.items():
            self._learn(1, chunk, tuple(chain.from_iterable(map(merged.__getitem__, tokens))))
        return [
            list(chain(chain.from_iterable(map(merged.__getitem__, head)), chain.from_iterable(map(known.__getitem__, chunks[1:]))))
            for head, chunks in zip(heads, cut, strict=True)
        ]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)`` of every whole text; null and empty texts have no ids. Other columns are ignored."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(path, pattern)
        ids = tool.encode(strings(part.column(1)).to_pylist())
        return pa.record_batch({"doc_id": part.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs, [doc_id, text], work, f"doc_id {kind}, ids array<int>", lambda: codec(path, pattern).forget(), SLICE_BYTES)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes)`` of ``(doc_id, ids)``: the byte strings of the ids, joined."""

    def run(batches):
        tool = codec(path, pattern)
        for batch in batches:
            raw = [tool.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "bytes": pa.array(raw, pa.binary())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def digest(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; per document the token count and digests of ids and decoded bytes.

    Repeated rows give repeated rows, an empty table an empty one; columns of
    the input other than id and text are ignored, whatever their names.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        tool = codec(path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for ids in tool.encode(strings(part.column(1)).to_pylist()):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(map(tool.text_of.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(tool.decode(ids)).hexdigest())
        return pa.record_batch({
            "doc_id": part.column(0), "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string()),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(
        docs, [doc_id, text], work, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        lambda: codec(path, pattern).forget(), SLICE_BYTES,
    )
