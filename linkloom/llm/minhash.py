"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles, weight
``(1 + ln tf) * idf``, the idf counted over distinct documents. Two documents share a consistent weighted sample with the
probability of their weighted Jaccard similarity (sum of minima over sum of
maxima). Samples are banded, documents that share a band are candidates, and a
candidate pair is a link if its exact similarity reaches the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Words, components, map_slices, mix, random_words, slices, stored
from linkloom.session import materialized

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: Share of documents below which a shingle counts as rare: rarer ones all get the largest idf.
RARE = 0.01
#: Documents counted together when frequent shingles are looked for.
CHUNK_DOCUMENTS = 4096
CHUNK_BYTES = 16 << 20
#: Parts that the candidates of one document are spread over.
SALTS = 32
#: Documents of a bucket that are held while the others stream past.
BLOCK_DOCUMENTS = 256

_BITS = np.uint64(44)
_MASK = np.uint64((1 << 44) - 1)


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle (44 bits) and count of the distinct shingles of each text, in order of text and shingle.

    A text of fewer than five words, but at least one, is one shingle.
    """
    words = Words(column)
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    left = words.first[words.row] + words.count[words.row] - np.arange(n)  # words from here to the end of the text
    for k in range(WIDTH):
        part = np.zeros(n, np.uint64)
        part[: n - k] = words.hash[k:]
        value = value * np.uint64(0x9E3779B97F4A7C15) + np.where(left > k, part, np.uint64(0))
    whole = (left >= WIDTH) | ((words.count[words.row] < WIDTH) & (left == words.count[words.row]))
    key = words.row[whole].astype(np.uint64) << _BITS | mix(value[whole]) >> np.uint64(20)
    key.sort()
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(start, len(key)))
    return (key[start] >> _BITS).astype(np.int64), key[start] & _MASK, count


def _starts(row: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)


@dataclass
class Idf:
    """Document counts of the frequent shingles, copies counted once; all others are rare."""

    shingle: np.ndarray
    count: np.ndarray
    documents: int

    def weights(self, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
        documents = np.full(len(shingle), max(RARE * self.documents, 1.0))
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, shingle), len(self.shingle) - 1)
            documents = np.where(self.shingle[at] == shingle, np.maximum(self.count[at], documents), documents)
        return (1 + np.log(count)) * np.log1p(self.documents / documents)


def _keys(shingle: np.ndarray, count: np.ndarray, start: np.ndarray) -> list[pa.Array]:
    """Two keys of the shingle counts of each text."""
    keys = (np.add.reduceat(mix(shingle * np.uint64(2 * k + 3) + count.astype(np.uint64)), start) for k in range(2))
    return [pa.array(k.view(np.int64)) for k in keys]


def _keyed(docs: DataFrame, column: str, text: str = "text") -> DataFrame:
    """The column, and two keys of the shingle counts, of every text that has words."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        row, shingle, count = shingles(part.column(part.num_columns - 1))
        start = _starts(row)
        if not len(start):
            return None
        k0, k1 = _keys(shingle, count, start)
        return pa.record_batch({column: part.column(0).take(pa.array(row[start])), "k0": k0, "k1": k1})

    columns = [column] if column == text else [column, text]
    return map_slices(docs, columns, work, f"{column} {docs.schema[column].dataType.simpleString()}, k0 bigint, k1 bigint")


def frequent(docs: DataFrame, text: str = "text") -> Idf:
    """Counts of ``counted`` over the classes of equal shingle counts: copies count once, texts without words not at all."""
    return counted(stored(_keyed(docs, text, text).dropDuplicates(["k0", "k1"]).select(text), "distinct"), text)


def counted(docs: DataFrame, text: str = "text") -> Idf:
    """Exact document counts, over all documents given, of every shingle in at least ``RARE`` of them.

    First each chunk of documents names the shingles in half that share of it.
    A shingle that is frequent in all has, over the chunks that name it, at
    least half the frequent count; there are at most ``2 / RARE`` times the mean
    number of shingles per document of those, whatever the size of the corpus.
    They are then counted exactly, in a second pass, and only they reach the driver.
    """
    spark = docs.sparkSession

    def name(batches):
        held, documents, size = [], 0, 0
        for part in slices(batches, text):
            held.append(shingles(part.column(0))[1])
            documents, size = documents + part.num_rows, size + part.nbytes
            if documents >= CHUNK_DOCUMENTS or size >= CHUNK_BYTES:
                yield _named(held, documents)
                held, documents, size = [], 0, 0
        if documents:
            yield _named(held, documents)

    total = docs.count()
    named = docs.select(text).mapInArrow(name, "shingle bigint, n bigint")
    named = named.groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= RARE / 2 * total)
    candidates = np.sort(named.select("shingle").toArrow().column("shingle").to_numpy().astype(np.uint64))
    shared = spark.sparkContext.broadcast(candidates)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        wanted, found = shared.value, shingles(part.column(0))[1]
        at = np.minimum(np.searchsorted(wanted, found), max(len(wanted) - 1, 0))
        n = np.bincount(at[wanted[at] == found], minlength=len(wanted)) if len(wanted) else np.zeros(0, np.int64)
        seen = np.flatnonzero(n)
        return pa.record_batch({"k": pa.array(seen.astype(np.int64)), "n": pa.array(n[seen].astype(np.int64))})

    exact = map_slices(docs, [text], count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    rows = exact.filter(F.col("n") >= RARE * total).toArrow()
    at = rows.column("k").to_numpy().astype(np.int64)
    order = np.argsort(at)
    return Idf(candidates[at[order]], rows.column("n").to_numpy()[order], total)


def _named(held: list[np.ndarray], documents: int) -> pa.RecordBatch:
    shingle, n = np.unique(np.concatenate(held), return_counts=True)
    often = n >= RARE / 2 * documents
    return pa.record_batch({"shingle": pa.array(shingle[often].astype(np.int64)), "n": pa.array(n[often])})


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2^16 equal steps."""
    x = np.linspace(0, 20, 400_001)
    return np.interp((np.arange(65536) + 0.5) / 65536, 1 - np.exp(-x) * (1 + x), x)


_GAMMA = _gamma_table().astype(np.float32)
_LOG_GAMMA = np.log(_GAMMA)
_SEEDS = random_words(BANDS * ROWS, 3)


def samples(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of each text that has shingles, one row per text, one column per sample.

    For every shingle and sample, r and c come from Gamma(2, 1) and b from the
    unit interval, all by hash; with ``t = floor(ln w / r + b)`` the shingle of
    the least ``ln c - r (t - b) - r`` is drawn, together with its ``t``.
    """
    start = _starts(row)
    size = np.diff(np.append(start, len(row)))
    log_weight = np.log(weight).astype(np.float32)
    out = np.empty((len(start), len(_SEEDS)), np.uint64)
    for k, seed in enumerate(_SEEDS):
        bits = mix(shingle ^ seed).view(np.uint16).reshape(-1, 4)
        r, b = _GAMMA[bits[:, 0]], bits[:, 1].astype(np.float32) / np.float32(65536)
        t = np.floor(log_weight / r + b)
        value = _LOG_GAMMA[bits[:, 2]] - r * (t - b + np.float32(1))
        least = np.minimum.reduceat(value, start)
        drawn = np.flatnonzero(value == np.repeat(least, size))
        first = drawn[np.searchsorted(drawn, start)]
        out[:, k] = mix(shingle[first] * np.uint64(64) + t[first].astype(np.int64).astype(np.uint64))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted weighted sets."""
    both, at, other = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][at], b[1][other]).sum()
    return float(shared / (a[1].sum() + b[1].sum() - shared))


def _described(docs: DataFrame, idf, doc_id: str, text: str) -> DataFrame:
    """``(id, bands)``: the band keys of every text that has words."""

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        row, shingle, count = shingles(part.column(1))
        weight = idf.value.weights(shingle, count)
        start = _starts(row)
        if not len(start):
            return None
        drawn = samples(row, shingle, weight)
        bands = np.zeros((len(start), BANDS), np.uint64)
        for k in range(ROWS):
            bands = mix(bands * np.uint64(31) + drawn[:, k::ROWS]) + np.arange(BANDS, dtype=np.uint64)
        own = pa.array(row[start])
        return pa.record_batch({"id": part.column(0).take(own), "bands": _lists(bands.view(np.int64))})

    schema = "id bigint, bands array<bigint>"
    return map_slices(docs.select(F.col(doc_id).cast("bigint").alias("id"), text), ["id", text], work, schema)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float, parts: int) -> DataFrame:
    """The pairs ``(a, b)`` whose exact similarity reaches the threshold.

    The partners of a document are spread over salted groups. A group is
    streamed: first the text of its document, then its partners one by one, so
    no group is held whole.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    heads = pairs.select(F.col("a").alias("id"), "a", "salt", F.lit(None).cast("bigint").alias("b")).distinct()
    wanted = heads.unionByName(pairs.select(F.col("b").alias("id"), "a", "salt", "b"))
    dealt = wanted.hint("merge").join(texts, "id").select("a", "salt", "b", "text")
    dealt = dealt.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches):
        own, key = None, None
        for part in slices(batches, "text"):
            row, shingle, count = shingles(part.column(3))
            weight = idf.value.weights(shingle, count)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = ([], [])
            for k, (a, salt, b) in enumerate(zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)):
                this = shingle[bounds[k] : bounds[k + 1]], weight[bounds[k] : bounds[k + 1]]
                if b is None:
                    own, key = this, (a, salt)
                elif key == (a, salt) and similarity(own, this) >= threshold:
                    out[0].append(a)
                    out[1].append(b)
            yield pa.record_batch({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return dealt.mapInArrow(compare, "a bigint, b bigint")


class _Block:
    """Documents held while others are compared with them, and which components their links have joined."""

    def __init__(self, rows: list[tuple[int, int, tuple[np.ndarray, np.ndarray]]]):
        self.ids, self.components = [r[0] for r in rows], [r[1] for r in rows]
        shingle = np.concatenate([r[2][0] for r in rows])
        order = np.argsort(shingle, kind="stable")
        self.shingle = shingle[order]
        self.weight = np.concatenate([r[2][1] for r in rows])[order]
        self.owner = np.repeat(np.arange(len(rows)), [len(r[2][0]) for r in rows])[order]
        self.total = np.array([r[2][1].sum() for r in rows])
        self.parent: dict[int, int] = {}

    def _root(self, x: int) -> int:
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def links(self, own: int, component: int, document: tuple[np.ndarray, np.ndarray], threshold: float) -> list[tuple[int, int]]:
        """Links of one more document to the block that join two components."""
        shingle, weight = document
        low, high = (np.searchsorted(self.shingle, shingle, side) for side in ("left", "right"))
        size = high - low
        at = np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        shared = np.bincount(self.owner[at], np.minimum(self.weight[at], np.repeat(weight, size)), len(self.ids))
        out = []
        for k in np.flatnonzero(shared >= threshold * (self.total + weight.sum() - shared)).tolist():
            a, b = self._root(component), self._root(self.components[k])
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                out.append((self.ids[k], own))
        return out


def _rest(bands: DataFrame, near: DataFrame, texts: DataFrame, idf, threshold: float, parts: int) -> DataFrame:
    """Further links ``(a, b)`` within buckets that hold several components.

    All but the documents of a bucket's largest component are dealt to blocks,
    and every document of the bucket streams past each block. So all pairs of
    different components are compared exactly, but only links that join
    components, fewer than there are components, are ever rows. Buckets with
    the same members are looked at once.
    """
    placed = bands.join(near, bands["id"] == near["node"], "left").select(
        "id", "band", F.coalesce("component", "id").alias("component")
    )
    counts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"))
    buckets = counts.groupBy("band").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.bit_xor("x").alias("x"),
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"),
    ).filter("kinds > 1")
    mixed = buckets.groupBy("x", "n", "kinds", "main", "n_main").agg(F.min("band").alias("band"))
    blocks = F.ceil((F.col("n") - F.col("n_main")) / BLOCK_DOCUMENTS).cast("int")
    rows = stored(placed.join(mixed.select("band", "main", blocks.alias("blocks")), "band"), "mixed")
    held = rows.filter("component <> main").select(
        "id", "band", "component", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.lit(0).alias("kind")
    )
    passing = rows.select(
        "id", "band", "component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(1).alias("kind")
    )
    dealt = held.unionByName(passing).hint("merge").join(texts, "id").select("band", "block", "kind", "id", "component", "text")
    dealt = dealt.repartition(parts, "band", "block").sortWithinPartitions("band", "block", "kind", "id")

    def compare(batches):
        key, waiting, block = None, [], None
        for part in slices(batches, "text"):
            row, shingle, count = shingles(part.column(5))
            weight = idf.value.weights(shingle, count)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
            out = []
            for k, (band, number, kind, own, component) in enumerate(zip(*(part.column(i).to_pylist() for i in range(5)), strict=True)):
                this = shingle[bounds[k] : bounds[k + 1]], weight[bounds[k] : bounds[k + 1]]
                if key != (band, number):
                    key, waiting, block = (band, number), [], None
                if kind == 0:
                    waiting.append((own, component, this))
                elif waiting:
                    block = block or _Block(waiting)
                    out += block.links(own, component, this, threshold)
            yield pa.record_batch({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def groups(docs: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, class_id, component_id, kept)`` of every document.

    ``class_id`` is the smallest id with the same shingle counts, ``component_id``
    the smallest id that links reach, ``kept`` marks one document per component.

    1. Documents with equal shingle counts are one class; only classes go on.
    2. Shingle weights from counts over all classes (``counted``), so that copies
       do not make a passage look common.
    3. In every band bucket each class is paired with the bucket's first, and
       the pairs are verified: a bucket gives as many pairs as it has members.
    4. Members of a bucket that these links leave in different components are
       compared too (``_rest``). Members already in one component need no
       further link. So every candidate pair is either joined or compared, and
       no pairs but links are rows.

    Texts are joined by a sort-merge, not a broadcast of ids that happen to be
    few, so the plan is the same at every size.

    Null and empty texts, and texts without words, link with nothing and are
    kept; null ids likewise, with null columns. Rows that repeat an id share its
    component. Columns other than id and text are ignored.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bodies = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    keyed = stored(_keyed(bodies, "id"), "keyed")
    classes = keyed.groupBy("k0", "k1").agg(F.min("id").alias("class"))
    member = stored(keyed.join(classes, ["k0", "k1"]).select("id", "class").distinct(), "member")
    heads = stored(bodies.join(member.filter("id = class").select("id").hint("merge"), "id", "left_semi"), "heads")
    repeated = member.filter("id = class").count() != heads.count()  # ids that come more than once
    idf = spark.sparkContext.broadcast(frequent(heads) if repeated else counted(heads))
    first = stored(_described(heads, idf, "id", "text"), "first")
    bands = first.select("id", F.explode("bands").alias("band"))
    lead = bands.groupBy("band").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    bands = stored(bands.join(lead, "band"), "bands")
    star = materialized(bands.filter("id <> a").select("a", F.col("id").alias("b")).distinct())
    # Every later pair is of members of one bucket too, so only their texts are fetched, once.
    texts = stored(heads.join(bands.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")
    links = materialized(_verified(star, texts, idf, threshold, parts))
    near = components(links)

    more = materialized(_rest(bands, near, texts, idf, threshold, parts))
    near = components(links.unionByName(more))

    least = member.join(near, member["class"] == near["node"], "left").select(
        F.col("id").alias("_id"), F.col("class").alias("class_id"), F.coalesce("component", "class").alias("component_id")
    ).groupBy("_id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    out = ids.join(least, F.col("doc_id").cast("bigint") == F.col("_id"), "left")
    own = F.col("doc_id").cast("bigint")
    return out.select(
        "doc_id", F.coalesce("class_id", own).alias("class_id"), F.coalesce("component_id", own).alias("component_id"),
        F.coalesce(F.coalesce("component_id", own) == own, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each group left, the one with the smallest id; columns as given."""
    gone = groups(docs, doc_id=doc_id, text=text).filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id))
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
