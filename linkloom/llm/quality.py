"""Quality by naive Bayes support vectors over n-gram indicators.

Features are indicators of words, word pairs and n-grams of word shapes (case,
closing marks, repetition), hashed to ``FEATURES`` numbers. Each is scaled by the
log-ratio of its counts in the two classes, and a linear model with hinge loss
is fitted by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import (
    Words,
    fit_logistic,
    held_out,
    keep_rows,
    known_labels,
    labelled_sample,
    logistic,
    map_slices,
    mix,
    strings,
)

FEATURES = 1 << 18
#: Training sample: rows per class, and the longest text among them.
ROWS_PER_CLASS = 2000
MAX_TRAINING_BYTES = 1 << 16
LEAST_DOCUMENTS = 3  # sample documents that a feature must stand in
SMOOTHING = 1.0
COST = 0.1
ROUNDS = 20
HELD_OUT = (5, 0)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[0x61:0x7B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def _shapes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and shape of every stretch between white space: case, digits, closing marks, repetition."""
    text = strings(column)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_SPACE[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = ~inside[:-1]
    edge[ends[:-1][ends[:-1] < len(raw)]] = True
    places = np.flatnonzero(inside)
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chars = raw[places]
    start = np.flatnonzero(edge[places])
    stop = np.append(start[1:], len(places))
    row = np.searchsorted(ends, places[start], side="right") - 1
    upper, lower, digit = (np.add.reduceat(kind[chars], start) for kind in (_UPPER, _LOWER, _DIGIT))
    within = np.arange(len(places)) - np.repeat(start, stop - start)
    value = np.add.reduceat(Words.BYTES[chars] * Words._powers(int((stop - start).max()))[within], start)
    same = np.zeros(len(start), np.int64)
    same[1:] = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    last = chars[stop - 1]
    before = np.where(stop - start > 1, chars[np.maximum(stop - 2, start)], 0)
    close = np.where(_MARK[last], last, 0).astype(np.int64)
    close2 = np.where(_MARK[last] & _MARK[before], before, 0).astype(np.int64)
    case = np.where(upper > 1, 2, np.where(upper > 0, 1, 0)) * 2 + (lower > 0)
    return row, ((((case * 2 + (digit > 0)) * 2 + same) << 16) | close << 8 | close2).astype(np.uint64)


def _ngrams(row: np.ndarray, token: np.ndarray, longest: int, kind: int) -> list[np.ndarray]:
    """Keys ``(text number, feature)`` of the n-grams of a token stream up to ``longest``."""
    out, value = [], np.full(len(token), kind, np.uint64)
    for n in range(1, longest + 1):
        if len(token) < n:
            break
        value = mix(value[: len(token) - n + 1] * np.uint64(0x100000001B3) + token[n - 1 :])
        whole = row[: len(token) - n + 1] == row[n - 1 :]
        feature = mix(value[whole] + np.uint64(n)) % np.uint64(FEATURES)
        out.append(row[: len(token) - n + 1][whole].astype(np.uint64) << np.uint64(32) | feature)
    return out


def indicators(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text number, feature) pairs of a slice of texts."""
    words = Words(column)
    keys = _ngrams(words.row, words.hash, 2, 1) + _ngrams(*_shapes(column), 3, 2)
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)


def coordinate_descent(
    start: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = ROUNDS
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear hinge-loss model by dual coordinate descent.

    Row ``i`` has the value ``scale[f]`` at the features ``feature[start[i]:start[i+1]]``
    and 1 for the intercept; ``y`` is -1 or 1; ``cost`` bounds the dual variable of each row.
    """
    weights, intercept = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(y))
    rows = [feature[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
    values = [scale[f] for f in rows]
    norm = np.array([v @ v + 1 for v in values])
    order = np.random.default_rng(1)
    for _ in range(rounds):
        largest = 0.0
        for i in order.permutation(len(y)):
            gradient = y[i] * (weights[rows[i]] @ values[i] + intercept) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                weights[rows[i]] += step * values[i]
                intercept += step
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return weights, intercept


@dataclass
class Model:
    """Weight of each feature (log-ratio times fitted weight), intercept and curve; or a constant score."""

    weights: np.ndarray | None = None
    intercept: float = 0.0
    curve: np.ndarray | None = None
    constant: float = 0.5

    def margin(self, column: pa.Array) -> np.ndarray:
        row, feature = indicators(column)
        return np.bincount(row, self.weights[feature], len(column)) + self.intercept

    def score(self, column: pa.Array) -> np.ndarray:
        if self.curve is None:
            return np.full(len(column), self.constant)
        return logistic(_curve_input(self.margin(column)), self.curve)


def _curve_input(margin: np.ndarray) -> np.ndarray:
    return np.clip(margin, -10, 10)[:, None]


def fit(start: np.ndarray, feature: np.ndarray, label: np.ndarray, aside: np.ndarray, base_rate: float) -> Model:
    """Fit on the rows not set aside, the curve on those set aside."""
    n = len(label)
    if min(label.sum(), n - label.sum()) < 8:
        return Model(constant=float(label.mean()) if n else 0.5)
    row = np.repeat(np.arange(n), np.diff(start))
    learn = ~aside[row]
    counts = [np.bincount(feature[learn & (label[row] == c)], minlength=FEATURES) + SMOOTHING for c in (0, 1)]
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[counts[0] + counts[1] < LEAST_DOCUMENTS + 2 * SMOOTHING] = 0
    used = learn & (ratio[feature] != 0)
    rows = np.flatnonzero(~aside)
    begin = np.concatenate([[0], np.cumsum(np.bincount(row[used], minlength=n)[rows])])
    y = 2.0 * label[rows] - 1
    weights, intercept = coordinate_descent(begin, feature[used], ratio, y, np.full(len(rows), COST))
    model = Model(weights * ratio, intercept)
    margin = np.bincount(row, model.weights[feature], n) + intercept
    part = aside & np.isfinite(margin)
    if 0 < label[part].sum() < part.sum():
        model.curve = fit_logistic(_curve_input(margin[part]), label[part].astype(float))
        # the sample is even, the corpus is not: move the curve to the true share of label 1
        share = label[part].mean()
        model.curve[-1] += np.log(base_rate / (1 - base_rate)) - np.log(share / (1 - share))
    else:
        model.constant = float(label.mean())
    return model


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
    rows_per_class: int = ROWS_PER_CLASS,
) -> Model:
    """Fit on a bounded labelled sample: ``rows_per_class`` rows a class, texts up to ``MAX_TRAINING_BYTES``.

    Three quarters fit the model and one quarter the curve. Features are found
    in the executors; the driver gets the feature numbers of the sample. Labels
    that differ within an id count as 1, and of several texts the smallest. With
    fewer than eight rows of a class the score is the share of label 1.
    """
    learn = ~held_out(F.col(doc_id), *HELD_OUT) & F.col(doc_id).isNotNull()
    sample = labelled_sample(docs, labels, label, learn, rows_per_class, MAX_TRAINING_BYTES, doc_id, text)
    sample = sample.withColumn("part", F.pmod(F.xxhash64(doc_id, F.lit("curve")), F.lit(4)).cast("int"))

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        row, feature = indicators(part.column(2))
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
        return pa.record_batch({"label": part.column(0), "part": part.column(1), "features": lists})

    schema = "label int, part int, features array<int>"
    rows = map_slices(sample, ["label", "part", text], work, schema).toArrow()
    share = known_labels(labels, label, learn, doc_id).agg(F.avg("label")).first()[0]
    lists = rows.column("features").combine_chunks()
    start = np.concatenate([[0], np.cumsum(np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64))])
    feature = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
    y = rows.column("label").to_numpy().astype(np.int64)
    aside = rows.column("part").to_numpy() == 0
    return fit(start, feature, y, aside, float(np.clip(share if share is not None else 0.5, 0.01, 0.99)))


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``: the probability that a whole text has label 1.

    Null and empty texts have no features and get the score of the intercept;
    columns other than id and text are ignored; repeated rows repeat, an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": part.column(0), "score": pa.array(shared.value.score(part.column(1)))})

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs, [doc_id, text], work, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, least_score: float = 0.3, text: str = "text") -> DataFrame:
    """Documents whose score is at least ``least_score``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda part: shared.value.score(part.column(text)) >= least_score)
