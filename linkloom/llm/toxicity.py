"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Toxic and ordinary texts have two interpolated Kneser-Ney models each. One is of
the bytes of their words, given up to ``ORDER`` predecessors; it backs off to a
model of shorter contexts counted over all documents, so that rare forms are
priced by how the whole corpus spells. The other is of whole words and backs off
to how often all documents use them. A text is compared by its
length-normalised log-likelihood ratios; a logistic curve makes them a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import (
    Words, fit_logistic, held_out, known_labels, labelled_sample, logistic, map_slices, stored,
)
from linkloom.llm.contexts import Level, ending, grams, rows
from linkloom.session import materialized

ORDER, SHARED_ORDER = 6, 3
#: Training sample: rows per class, and the longest text among them.
ROWS_PER_CLASS = 4000
MAX_TRAINING_BYTES = 1 << 16
FEATURES = 7
WINDOW = 32  # words of the stretch whose ratio counts besides the whole text's
STRONG = 6.0  # ratio of bytes from which a word counts as a strong sign
LEAST_TEXTS = 3  # texts of the sample that a word must stand in to have a ratio of its own
TELLING = 2.5  # ratio of whole words from which a word is telling
HELD_OUT = (3, 1)


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place of every distinct word of a slice, its number at every place, and the number of texts with it."""
    _, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
    own = np.unique(words.row.astype(np.int64) * max(len(first), 1) + word)
    return first, word, np.bincount(own % max(len(first), 1), minlength=len(first))


def _counted(words: Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of a slice, every word counted once per text."""
    first, _, texts = _distinct(words)
    gram, coded = grams(words, first, order)
    distinct, at = np.unique(gram, return_inverse=True)
    return distinct, np.bincount(at, np.repeat(texts, coded), len(distinct))


def corpus_counts(docs: DataFrame, text: str = "text", vocabulary: np.ndarray | None = None) -> DataFrame:
    """``(kind, gram, n)`` over all whole texts, words counted once per text.

    Kind 0 are the grams of the shared model, 1 the words of a vocabulary of
    sorted hashes, and 2 is the number of all words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(0, np.uint64) if vocabulary is None else vocabulary)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words, known = Words(part.column(0)), shared.value
        first, _, texts = _distinct(words)
        gram, coded = grams(words, first, SHARED_ORDER)
        distinct, at = np.unique(gram, return_inverse=True)
        n = np.bincount(at, np.repeat(texts, coded), len(distinct)).astype(np.int64)
        here = np.flatnonzero(np.isin(words.hash[first], known))
        key = np.concatenate([distinct, words.hash[first][here], np.zeros(1, np.uint64)])
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(distinct), len(here), 1])
        return pa.record_batch({
            "kind": pa.array(kind), "gram": pa.array(key.view(np.int64)),
            "n": pa.array(np.concatenate([n, texts[here], [texts.sum()]]).astype(np.int64)),
        })

    counts = map_slices(docs, [text], count, "kind int, gram bigint, n bigint")
    return counts.groupBy("kind", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Words that the sample knows well enough, as sorted hashes, and log of their toxic over ordinary probability."""

    hashes: np.ndarray
    ratios: np.ndarray

    @classmethod
    def of(cls, label: np.ndarray, word: np.ndarray, n: np.ndarray, common: np.ndarray, common_n: np.ndarray, total: int) -> Lexicon:
        """Kneser-Ney ratio of every word of ``common``, which says in how many of all texts it stands; ``total`` sums all words.

        ``label``, ``word`` and ``n`` are the counts of texts per class in the sample.
        """
        order = np.argsort(common)
        common, spread = common[order], common_n[order] / max(total, 1)
        logs = []
        for value in (0, 1):
            mine = label == value
            counts = n[mine]
            once, twice = (np.count_nonzero(counts == k) for k in (1, 2))
            discount = float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))
            by = np.argsort(word[mine])
            own = rows(word[mine][by], counts[by, None].astype(float), common)[:, 0]
            part = np.maximum(own - discount, 0) + discount * len(counts) * spread
            logs.append(np.log(part / max(counts.sum(), 1)))
        return cls(common, logs[1] - logs[0])

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        return rows(self.hashes, self.ratios[:, None], hashes)[:, 0]


@dataclass
class Model:
    """Levels of the shared and of the class models (column 0 ordinary, 1 toxic), and the curve or a constant score."""

    shared: list[Level]
    own: list[Level]
    discounts: list[float]
    lexicon: Lexicon | None = None
    curve: np.ndarray | None = None
    constant: float = 0.5

    @classmethod
    def of(
        cls, corpus: tuple[np.ndarray, np.ndarray], label: np.ndarray, gram: np.ndarray, n: np.ndarray,
        shorter: tuple[np.ndarray, np.ndarray] | None = None, once_twice: tuple[int, int] | None = None,
    ) -> Model:
        """Model of corpus counts and of counts per label, both as grams of the longest context.

        The longest class contexts count occurrences, all shorter ones the kinds
        of bytes that precede them (continuation counts). Discounts follow from
        the grams counted once and twice. ``corpus`` may lack grams of contexts
        that no class gram goes on from, which change no ratio; then ``shorter``
        are all grams one byte shorter with the kinds of bytes before them, and
        ``once_twice`` how many grams of the corpus are counted once and twice.
        """
        if shorter is None:
            shorter = np.unique(ending(corpus[0], SHARED_ORDER - 1), return_counts=True)
        shared, own = [], []
        for order in range(SHARED_ORDER - 1):
            shared.append(Level.of(*_zeros(ending(np.unique(ending(shorter[0], order + 1)), order)), 1, 1))
        shared.append(Level.of(*_zeros(shorter[0]), shorter[1], 1))
        shared.append(Level.of(*_zeros(corpus[0]), corpus[1], 1))
        for order in range(SHARED_ORDER + 1, ORDER + 1):
            if order == ORDER:
                own.append(Level.of(gram, label, n, 2))
            else:
                longer = [np.unique(ending(gram[label == c], order + 1)) for c in (0, 1)]
                kinds = np.concatenate([ending(g, order) for g in longer])
                own.append(Level.of(kinds, np.repeat([0, 1], [len(g) for g in longer]), 1, 2))
        discounts = []
        for at, level in enumerate([*shared, *own]):
            once, twice = (np.count_nonzero(level.counts == k) for k in (1, 2))
            if at == SHARED_ORDER and once_twice is not None:
                once, twice = once_twice
            discounts.append(float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95)))
        return cls(shared, own, discounts)

    def ratio(self, gram: np.ndarray) -> np.ndarray:
        """Log of toxic over ordinary probability of each gram's last byte in its context."""
        p = np.full((len(gram), 1), 1 / 256)
        for order, (level, discount) in enumerate(zip([*self.shared, *self.own], self.discounts, strict=True)):
            count, total, kinds = level.look_up(ending(gram, order))
            seen = (np.maximum(count - discount, 0) + discount * kinds * p) / np.maximum(total, 1)
            p = np.where(total > 0, seen, p)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: mean ratio of a word, that of the most toxic stretch, share of strong words and log of their
        number; log of the number of telling words, the largest ratio of a whole word, and log of the number of words.
        """
        words, n = Words(column), len(column)
        out = np.zeros((n, FEATURES))
        if not len(words.hash):
            return out
        first, word, _ = _distinct(words)
        gram, coded = grams(words, first, ORDER)
        distinct, at = np.unique(gram, return_inverse=True)
        begin = np.cumsum(coded) - coded
        ratio = np.add.reduceat(self.ratio(distinct)[at], begin)[word]
        size = words.count
        out[:, 0] = np.bincount(words.row, ratio, n) / np.maximum(size, 1)
        strong = np.bincount(words.row, ratio > STRONG, n)
        out[:, 2] = strong / np.maximum(size, 1)
        out[:, 3] = np.log1p(strong)
        place = np.arange(len(word))
        start = np.maximum(words.first[words.row], place - WINDOW + 1)
        running = np.concatenate([[0.0], np.cumsum(ratio)])
        full = np.flatnonzero(size)
        if self.lexicon is not None:
            whole = self.lexicon.look_up(words.hash[first])[word]
            pair = np.unique(words.row.astype(np.int64) * len(first) + word)
            telling = pair[self.lexicon.look_up(words.hash[first[pair % len(first)]]) > TELLING]
            out[:, 6] = np.log1p(size)
            out[:, 4] = np.log1p(np.bincount(telling // len(first), minlength=n))
            out[full, 5] = np.maximum(np.maximum.reduceat(whole, words.first[full]), 0)
        out[full, 1] = np.maximum.reduceat((running[place + 1] - running[start]) / WINDOW, words.first[full])
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if self.curve is None:
            return np.full(len(column), self.constant)
        return logistic(self.features(column), self.curve)


def _zeros(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gram, np.zeros(len(gram), np.int64)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text",
    rows_per_class: int = ROWS_PER_CLASS,
) -> Model:
    """Fit on a bounded labelled sample; the backoff counts come from all documents.

    Of the sample (``rows_per_class`` rows a class, texts up to
    ``MAX_TRAINING_BYTES``) three quarters make the class models and one quarter
    the curve. The driver gets the grams and words of that sample; of all
    documents the counts of its words, the grams that continue a context of it,
    and the grams of three bytes: all bounded by the sample, or by 2^24,
    however large the corpus. The sample is even
    where the classes are large, so the curve is moved to the share of label 1
    among all labelled documents that may be learnt from. Labels that differ
    within an id count as 1, and of several texts the smallest. With fewer than
    eight rows of a class the score is that share (0.5 without labels).
    """
    spark = docs.sparkSession
    learn = ~held_out(F.col(doc_id), *HELD_OUT) & F.col(doc_id).isNotNull()
    known = known_labels(labels, label, learn, doc_id)
    share = known.join(docs.select(doc_id), doc_id, "left_semi").agg(F.avg("label")).first()[0]
    sample = materialized(
        labelled_sample(docs, labels, label, learn, rows_per_class, MAX_TRAINING_BYTES, doc_id, text)
        .withColumn("part", F.pmod(F.xxhash64(doc_id, F.lit("curve")), F.lit(4)))
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 8:
        return Model([], [], [], constant=0.5 if share is None else share)

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for value in (0, 1):
            words = Words(part.column(1).filter(pa.array(part.column(0).to_numpy() == value)))
            gram, n = _counted(words, ORDER)
            first, _, texts = _distinct(words)
            key = np.concatenate([gram, words.hash[first]])
            whole = np.repeat([False, True], [len(gram), len(first)])
            out.append((np.full(len(key), value, np.int32), whole, key.view(np.int64), np.concatenate([n, texts]).astype(np.int64)))
        label_, whole, key, n = map(np.concatenate, zip(*out, strict=True))
        return pa.record_batch({"label": pa.array(label_), "whole": pa.array(whole), "gram": pa.array(key), "n": pa.array(n)})

    counted = map_slices(sample.filter("part > 0"), ["label", text], count, "label int, whole boolean, gram bigint, n bigint")
    counted = counted.groupBy("label", "whole", "gram").agg(F.sum("n").alias("n")).toArrow()
    label_, whole, key, n = (counted.column(c).to_numpy() for c in ("label", "whole", "gram", "n"))
    whole, key = whole.astype(bool), key.view(np.uint64)
    word, at = np.unique(key[whole], return_inverse=True)
    vocabulary = word[np.bincount(at, n[whole], len(word)) >= LEAST_TEXTS]
    corpus = stored(corpus_counts(docs, text, vocabulary), "counts")
    # A class gram's context ends in the context of the shared gram that it backs off to.
    wanted = np.unique(ending(key[~whole] >> np.uint64(8), SHARED_ORDER - 1)).astype(np.int64)
    contexts = spark.createDataFrame(pa.table({"context": wanted}))
    spelled = corpus.filter("kind = 0")
    context = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit((1 << 8 * SHARED_ORDER) - 1))
    going_on = _pairs(spelled.withColumn("context", context).join(F.broadcast(contexts), "context", "left_semi"))
    last = F.col("gram").bitwiseAND(F.lit((1 << 8 * SHARED_ORDER) - 1))
    shorter = _pairs(spelled.groupBy(last.alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    once_twice = tuple(spelled.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first())
    total = corpus.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    model = Model.of(going_on, label_[~whole], key[~whole], n[~whole], shorter, once_twice)
    common, common_n = _pairs(corpus.filter("kind = 1"))
    model.lexicon = Lexicon.of(label_[whole], key[whole], n[whole], common, common_n, total)
    shared = spark.sparkContext.broadcast(model)

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        features = shared.value.features(part.column(1))
        columns = {"label": part.column(0)} | {f"f{k}": pa.array(features[:, k]) for k in range(features.shape[1])}
        return pa.record_batch(columns)

    schema = "label int, " + ", ".join(f"f{k} double" for k in range(FEATURES))
    aside = map_slices(sample.filter("part = 0"), ["label", text], measure, schema).toPandas()
    y = aside["label"].to_numpy(float)
    if 0 < y.sum() < len(y):
        model.curve = fit_logistic(aside.drop(columns="label").to_numpy(float), y)
        model.curve[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    else:
        model.constant = share
    return model


def _pairs(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Grams, in order, and their counts."""
    rows = counts.select("gram", "n").toArrow()
    gram = rows.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(gram)
    return gram[order], rows.column("n").to_numpy()[order]


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)``: the probability that a whole text is toxic.

    Null and empty texts get the score of a text without signs; columns other
    than id and text are ignored; repeated rows repeat, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": part.column(0), "score": pa.array(shared.value.score(part.column(1)))})

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs, [doc_id, text], work, f"doc_id {kind}, score double")
