"""Best-fit packing of tokenized documents, planned on the histogram of piece lengths."""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.bpe import BYTE_CHARS
from linkloom.llm.common import give_back, slices, strings
from linkloom.session import materialized

CAPACITY = 2048
END_ID = 0
#: Bytes of the chunks of text whose ids a worker remembers during a task; beyond them the memory starts anew.
CACHE_BYTES = 96 << 20
#: What an entry of the memory takes besides its characters and ids.
ENTRY_BYTES = 190
#: Text bytes encoded at a time: the more, the fewer stretches come again in another slice.
SLICE_BYTES = 2 << 20


def _latin(column: pa.Array) -> pa.Array:
    """Whether all characters of each text are below U+0100, whose lower case depends on nothing else."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    beyond = np.concatenate([[0], np.cumsum(raw[ends[0] : ends[-1]] >= 0xC4)])  # first bytes of longer characters
    return pa.array(beyond[ends[1:] - ends[0]] == beyond[ends[:-1] - ends[0]])


#: Characters that the vocabulary has for bytes.
_TO_CHARS = str.maketrans(dict(enumerate(BYTE_CHARS)))


class Encoder:
    """Ids of texts, remembered by stretches between single spaces and line ends.

    The tokenizer drops white space between its words, so a text's ids are those
    of its stretches in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads would keep memory of their own
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def _fresh(self, chunks: list[str]) -> None:
        """Learn chunks. A word of lower-case Latin letters is one word of the tokenizer as it stands, so its model alone cuts it."""
        known, cut, others = self.known, self.model.tokenize, []
        for chunk in chunks:
            shown = chunk
            if not chunk.isascii():
                raw = chunk.encode()
                shown = raw.decode("latin-1").translate(_TO_CHARS) if max(raw) < 0xC4 else ""
            if shown and chunk.islower() and chunk.isalpha():
                known[chunk] = array("I", [token.id for token in cut(shown)]).tobytes()
            else:
                others.append(chunk)
        for chunk, encoding in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False), strict=True):
            known[chunk] = array("I", encoding.ids).tobytes()
        self._count(chunks)

    def _count(self, chunks: list[str]) -> None:
        sizes = sum(map(len, chunks)) + sum(map(len, map(self.known.__getitem__, chunks)))
        self.held += sizes + ENTRY_BYTES * len(chunks)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each text's."""
        if self.held > CACHE_BYTES:
            self.forget()
        # The tokenizer lower-cases anyway; where that is plain, doing it first makes stretches recur.
        text = pc.replace_substring(pc.if_else(_latin(column), pc.utf8_lower(column), column), "\n", " ")
        cut = pc.split_pattern(text, " ")
        chunks = cut.flatten().dictionary_encode()
        distinct, known = chunks.dictionary.to_pylist(), self.known
        missing = {c for c in distinct if c not in known}
        # A word before one final stop or comma is a word of the tokenizer of its own. The tokenizer
        # composes first (NFC), which leaves some letters as letter and mark: marks go with the stop.
        split = {c for c in missing if len(c) > 1 and c[-1] in ".," and unicodedata.normalize("NFC", c[:-1]).lower().isalpha()}
        self._fresh([c for c in missing - split | {c[:-1] for c in split} | {".", ","} if c not in known])
        for chunk in split:
            known[chunk] = known[chunk[:-1]] + known[chunk[-1]]
        self._count(list(split))
        found = list(map(known.__getitem__, distinct))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, start = np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size
        at = chunks.indices.to_numpy().astype(np.int64)
        long = size[at]
        done = np.concatenate([[0], np.cumsum(long)])
        ends = np.cumsum(cut.value_lengths().to_numpy())
        out = flat[np.repeat(start[at] - done[:-1], long) + np.arange(int(done[-1]))]
        return out, np.diff(np.concatenate([[0], done[ends]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes."""
        ids, sizes = self.ids(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[b - n : b].astype("<u4").tobytes() for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: ids of every whole text and an end id, cut at ``capacity``.

    A null or empty text is the end id alone. Columns other than id and text are ignored.
    """
    def cut(names: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        whole = np.full(len(ids) + len(sizes), END_ID, "<u4")
        ends = np.cumsum(sizes + 1)
        own = np.ones(len(whole), bool)
        own[ends - 1] = False
        whole[own] = ids
        pieces = -(-(sizes + 1) // capacity)
        row = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, (sizes + 1)[row] - start)
        place = (ends - sizes - 1)[row] + start
        raw = memoryview(whole.tobytes())
        sums = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
        return pa.record_batch({
            "doc_id": names.take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start),
            "length": pa.array(length), "ids_crc32": pa.array(sums, pa.int64()),
        })

    def work(batches):
        tool = encoder(path)
        try:
            for part in slices(batches, text, SLICE_BYTES):
                yield cut(part.column(0), *tool.ids(strings(part.column(1))))
        finally:
            tool = None
            encoder.cache_clear()  # the worker outlives the task; the model is read again in less than a tenth of a second
            give_back()

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(
        work, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit over counts: ``(copies, [(length, offset), ...])`` per kind of sequence.

    Lengths come in falling order. All pieces of a length go, as many at once as
    there are, into open sequences with the least room that holds them, else
    into new ones. Alike sequences are one entry, so the work depends on the
    number of lengths and not of pieces.
    """
    rooms: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity) if rooms.get(r)), None)
            if room is None:
                per = capacity // length
                for copies, each in ((left // per, per), (1 if left % per else 0, left % per)):
                    if copies:
                        rooms.setdefault(capacity - length * each, []).append((copies, (length,) * each))
                break
            copies, inside = rooms[room].pop()
            each = min(room // length, max(1, left // copies))
            used = min(copies, left // each)
            if used < copies:
                rooms[room].append((copies - used, inside))
            rooms.setdefault(room - length * each, []).append((used, inside + (length,) * each))
            left -= used * each
    out = []
    for group in rooms.values():
        for copies, inside in group:
            starts = np.cumsum([0, *inside[:-1]]).tolist()
            out.append((copies, list(zip(inside, starts, strict=True))))
    return out


def slots(planned: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int]]:
    """Slots by rank: ``(length, first rank, copies, first sequence, offset)``; ranks of a length run without gaps."""
    out, next_rank, sequence = [], {}, 0
    for copies, inside in planned:
        for length, offset in inside:
            first = next_rank.get(length, 0)
            out.append((length, first, copies, sequence, offset))
            next_rank[length] = first + copies
        sequence += copies
    return out


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents; a row per piece with its sequence and its place there.

    Repeated rows are packed as often as they come; an empty table gives no
    rows. The driver sees one row per length. Ranks within a length are counted
    per block of documents first, so a length that very many pieces share is
    numbered in many tasks. Slots are found by a join on length and rank block;
    their number depends on ``capacity`` alone.
    """
    spark = docs.sparkSession
    blocks = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = materialized(
        pieces(docs, path, capacity, doc_id, text)
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    )
    sizes = rows.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = slots(plan(counts, capacity))
    schema = "length bigint, first bigint, copies bigint, first_sequence bigint, offset bigint"
    slot = spark.createDataFrame(places or [(0, 0, 0, 0, 0)], schema)
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), "n")
    nth = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = rows.withColumn("nth", nth - 1)
    # The slots that a (length, block) can need, as an array on its row: a range join of two small tables.
    overlap = (F.col("s.first") < F.col("c.before") + F.col("c.n")) & (F.col("s.first") + F.col("s.copies") > F.col("c.before"))
    needed = (
        before.alias("c").join(F.broadcast(slot).alias("s"), (F.col("s.length") == F.col("c.length")) & overlap)
        .groupBy(F.col("c.length").alias("length"), F.col("c.block").alias("block"))
        .agg(F.first("c.before").alias("before"), F.collect_list(F.struct("s.first", "s.copies", "s.first_sequence", "s.offset")).alias("near"))
    )
    rank = F.col("before") + F.col("nth")
    mine = F.filter("near", lambda s: (rank >= s["first"]) & (rank < s["first"] + s["copies"]))[0]
    placed = ranked.join(needed, ["length", "block"]).withColumn("slot", mine).withColumn("rank", rank)
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first")).alias("sequence_id"),
        F.col("slot.offset").alias("offset"),
    )
