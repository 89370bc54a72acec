"""Document fingerprints from prefix polynomial hashes.

``Prefixes`` keeps, for two prime moduli, the sums ``S[i] = sum c[j] * B^j`` over
the code points before ``i``. A span hash is a difference of two sums moved to
exponent 0, so any two spans, of one text or of two, compare in constant time
and the longest common extension of two positions is found by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkloom.llm.common import mix, slices

# Moduli and bases of the two hashes; a product of two residues stays below 2^62.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)

WIDE, NARROW = 12, 3  # code points of a sketched span
LONG, SHORT = 48, 96  # texts from LONG on have wide spans, those below SHORT narrow ones
SKETCH = 48  # least span hashes kept

_MIN_ID = -(1 << 63)


class _Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int, modulus: int):
        self.p, self.steps = modulus, (base, pow(base, -1, modulus))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.tables[0]) < n:
            size = len(self.tables[0])
            for k, step in enumerate(self.steps):
                jump = np.uint64(pow(step, size, self.p))
                self.tables[k] = np.concatenate([self.tables[k], self.tables[k] * jump % np.uint64(self.p)])
        return self.tables[0][:n], self.tables[1][:n]


_POWERS = [_Powers(b, p) for b, p in zip(BASES, MODULI, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class Prefixes:
    """Modular prefix arrays of one text; of an edited text when ``base`` is given, whose first ``kept`` points it shares."""

    def __init__(self, points: np.ndarray, base: Prefixes | None = None, kept: int = 0):
        self.n, self.sums, self._hashes = len(points), [], {}
        self._base, self._kept = base, kept
        for k, powers in enumerate(_POWERS):
            p = np.uint64(powers.p)
            terms = (points[kept:].astype(np.uint64) + np.uint64(1)) * powers.upto(self.n)[0][kept:] % p
            known = base.sums[k][: kept + 1] if base else np.zeros(1, np.uint64)
            self.sums.append(np.concatenate([known, (known[-1] + np.cumsum(terms, dtype=np.uint64)) % p]))

    def hashes(self, width: int) -> np.ndarray:
        """Scrambled 32-bit hashes of all spans of one width; those of a shared beginning are taken over."""
        if width not in self._hashes:
            known = self._base.hashes(width)[: max(0, self._kept - width + 1)] if self._base else np.zeros(0, np.uint64)
            starts = np.arange(len(known), self.n - width + 1)
            self._hashes[width] = np.concatenate([known, mix(self.spans(starts, starts + width)) >> np.uint64(32)])
        return self._hashes[width]

    def spans(self, start, stop) -> np.ndarray:
        """62-bit hashes of spans ``[start, stop)``; equal for equal spans wherever they stand."""
        out = None
        for powers, sums in zip(_POWERS, self.sums, strict=True):
            p = np.uint64(powers.p)
            value = (sums[stop] + p - sums[start]) % p * powers.upto(self.n + 1)[1][start] % p
            out = value if out is None else out << np.uint64(31) | value
        return out

    def equal(self, start: int, other: Prefixes, at: int, length: int) -> bool:
        """Whether two spans of one length are equal."""
        return bool(self.spans(start, start + length) == other.spans(at, at + length))

    def common_extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest common extension to the right of two positions."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def _least(prefixes: Prefixes, width: int) -> list[str]:
    hashes = prefixes.hashes(width)
    if len(hashes) > 64 * SKETCH:
        low = np.unique(hashes[hashes < np.uint64((8 * SKETCH << 32) // len(hashes))])
        if len(low) >= SKETCH:
            return [f"{h:08x}" for h in low[:SKETCH]]
    return [f"{h:08x}" for h in np.unique(hashes)[:SKETCH]]


def _rungs(n: int) -> list[int]:
    """Lengths of the hashed beginnings: four per doubling, none above ``n``."""
    return sorted({r for j in range(4 * n.bit_length() + 1) if (r := int(2 ** (j / 4))) <= n})


def of(prefixes: Prefixes) -> str:
    """Fingerprint: length, hash of the whole, hashes of beginnings, least hashes of its wide and of its narrow spans."""
    n = prefixes.n
    whole = int(prefixes.spans(0, n)) if n else 0
    rungs = np.array(_rungs(n) if n else [], np.int64)
    ladder = [f"{h:08x}" for h in mix(prefixes.spans(0 * rungs, rungs)) >> np.uint64(32)]
    wide = _least(prefixes, WIDE) if n >= LONG else []
    narrow = _least(prefixes, NARROW) if NARROW <= n < SHORT else []
    return f"{n}:{whole:016x}:{','.join(ladder)}:{','.join(wide)}:{','.join(narrow)}"


def _common_beginning(a: list[str], b: list[str]) -> int:
    """Longest hashed beginning that two ladders share; beginnings agree up to it and differ from there on."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[middle - 1] == b[middle - 1]:
            low = middle
        else:
            high = middle - 1
    return low


def _common(a: list[str], b: list[str]) -> float:
    """Share of common spans (Dice) estimated from the least hashes of the union; exact for small sets."""
    size = min(max(len(a), len(b)), SKETCH)
    least = sorted({*a, *b})[:size] if len(a) >= SKETCH or len(b) >= SKETCH else sorted({*a, *b})
    shared = len({*a} & {*b} & {*least})
    jaccard = shared / len(least)
    return 2 * jaccard / (1 + jaccard)


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 1 for equal ones.

    The larger of two shares: common spans, and the longest common hashed
    beginning of the longer text. Texts that differ in length so much that they
    have no kind of span in common are compared by their beginnings alone.
    """
    if a == b:
        return 1.0
    (n_a, _, ladder_a, *spans_a), (n_b, _, ladder_b, *spans_b) = a.split(":"), b.split(":")
    longer = max(int(n_a), int(n_b))
    steps = _common_beginning(ladder_a.split(",") if ladder_a else [], ladder_b.split(",") if ladder_b else [])
    begun = _rungs(longer)[steps - 1] / longer if steps else 0.0
    for x, y in zip(spans_a, spans_b, strict=True):
        if x and y:
            return max(begun, _common(x.split(","), y.split(",")))
    return begun


def _pairs(rows):
    """``(id, text, next text)`` for every row of a bucket that is no copy from the next bucket."""
    last = None
    for row in rows:
        if last is not None and last[0] == row[0] and not last[1]:
            yield last[2], last[3], row[3]
        last = row
    if last is not None and not last[1]:  # a table of a single row
        yield last[2], last[3], last[3]


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by the first code points of the next."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness to it and to the next document.

    The next document follows in order of id (null ids first), ties in order of
    text; after the last comes the first, and a single document follows itself.
    Null texts are empty, repeated rows stay, an empty table gives no rows, and
    other columns are ignored. ``lce_edited`` and ``lce_next`` are the lengths of
    the longest common beginning with the edited and with the next text.

    Texts are shuffled once, to ranges of ids between quantiles of all ids. A
    quantile is an id of the table, so it is the first of its range, and its row
    is sent to the range before as well: no range needs a look at its neighbour.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[doc_id].dataType.simpleString()
    id_type = to_arrow_type(docs.schema[doc_id].dataType)
    # ids as numbers with null first
    ids = docs.select(F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_MIN_ID)).alias("k"))
    ranges = 8 * parts  # several to a task, which evens out how many each gets
    steps = [i / ranges for i in range(1, ranges)]
    least, cuts = ids.agg(F.min("k"), F.percentile_approx("k", steps, 50 * ranges)).first()
    bounds = np.array(sorted({*(cuts or [])} - {least}), np.int64)

    def place(batches):
        for part in slices(batches, "text"):
            keys = part.column(0).cast(pa.int64()).fill_null(_MIN_ID).to_numpy(zero_copy_only=False)
            bucket = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            first = np.flatnonzero(np.isin(keys, bounds) | (keys == least))
            before = np.where(keys[first] == least, len(bounds), bucket[first] - 1).astype(np.int32)
            take = pa.array(np.concatenate([np.arange(len(keys)), first]))
            yield pa.record_batch({
                "bucket": pa.array(np.concatenate([bucket, before])),
                "copied": pa.array(np.concatenate([np.zeros(len(keys), bool), np.ones(len(first), bool)])),
                "id": part.column(0).take(take), "text": part.column(1).take(take),
            })

    def work(batches):
        def rows():
            for part in slices(batches, "text"):
                yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        held, out, size = None, [], 0
        for key, body, following in _pairs(rows()):
            own = held if held is not None and held[0] is body else None
            if own is None:
                points = code_points(body)
                prefixes = Prefixes(points)
                own = (body, points, prefixes, of(prefixes))
            _, points, prefixes, mark = own
            after = code_points(following)
            ahead = Prefixes(after)
            m = len(points) // 4
            changed = edited(body, following)
            other = Prefixes(np.concatenate([points[: len(points) - m], after[:m]]), prefixes, len(points) - m)
            mark_edited, mark_next = of(other), of(ahead)
            out.append((
                key, len(points), hashlib.sha256(changed.encode()).hexdigest(), mark, mark_edited,
                likeness(mark, mark_edited), likeness(mark, mark_next),
                prefixes.common_extension(0, other, 0), prefixes.common_extension(0, ahead, 0),
            ))
            held = (following, after, ahead, mark_next)
            size += 1
            if size == 500:
                yield _batch(out, id_type)
                out, size = [], 0
        if out:
            yield _batch(out, id_type)

    placed = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(
        place, f"bucket int, copied boolean, id {kind}, text string"
    )
    dealt = placed.repartition(parts, "bucket").sortWithinPartitions("bucket", "copied", "id", "text")
    return dealt.mapInArrow(work, (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, lce_edited bigint, lce_next bigint"
    ))


_RESULT = {
    "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "lce_edited": pa.int64(), "lce_next": pa.int64(),
}


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = {"doc_id": id_type, **_RESULT}
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=[*types])
