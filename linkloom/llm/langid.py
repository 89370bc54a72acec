"""Language identification by prediction by partial matching (PPM) with frozen byte statistics.

Each language has a tree of byte contexts up to ``ORDER`` bytes. A byte that a
context has not seen costs an escape (method C) and is coded by the next shorter
context, down to a uniform code. Contexts start at the beginning of a word, so
the exact code length of a text is the sum over its words, and a slice of texts
is priced once per distinct word.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import Words, held_out, keep_rows, map_slices, sample_rows, strings
from linkloom.llm.contexts import Level, ending, grams
from linkloom.session import materialized

ORDER = 3
UNKNOWN = "und"
#: Training sample: rows per language, and the longest text among them.
ROWS_PER_LANGUAGE = 500
MAX_TRAINING_BYTES = 1 << 16

@dataclass
class Model:
    languages: list[str]
    levels: list[Level] = field(default_factory=list)

    @classmethod
    def of(cls, languages: list[str], language: np.ndarray, gram: np.ndarray, count: np.ndarray) -> Model:
        """Model of ``count`` occurrences of each (language number, gram)."""
        levels = [Level.of(ending(gram, order), language, count, len(languages)) for order in range(ORDER + 1)]
        return cls(languages, levels)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in its context, per language."""
        p = np.full((len(gram), len(self.languages)), 1 / 256)
        for order, level in enumerate(self.levels):
            count, total, kinds = level.look_up(ending(gram, order))
            whole = np.maximum(total + kinds, 1)
            p = np.where(count > 0, count / whole, np.where(total > 0, kinds / whole * p, p))
        return -np.log2(p)


def train(
    docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE,
) -> Model:
    """Model of a bounded sample of the rows that ``learn`` admits.

    At most ``rows_per_language`` rows of each language with texts of up to
    ``MAX_TRAINING_BYTES``, those with the least hashes of their ids. The driver
    gets one row per language and four-byte gram of that sample. Rows with null
    language or text teach nothing; without any rows the model knows no language.
    """
    spark = docs.sparkSession
    fit = learn & F.col(lang).isNotNull() & (F.octet_length(text) <= MAX_TRAINING_BYTES)
    permitted = materialized(docs.filter(fit).select(doc_id, lang).distinct())
    ids = materialized(sample_rows(permitted, doc_id, lang, rows_per_language))
    languages = sorted(r[0] for r in ids.select(lang).distinct().collect())
    number = {name: k for k, name in enumerate(languages)}
    chosen = docs.filter(fit).select(doc_id, lang, text).join(F.broadcast(ids), [doc_id, lang], "left_semi")

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(part.column(1))
        gram, coded = grams(words, np.arange(len(words.hash)), ORDER)
        own = np.array([number[x] for x in part.column(0).to_pylist()], np.uint64)
        key, n = np.unique(np.repeat(own[words.row], coded) << np.uint64(32) | gram, return_counts=True)
        return pa.record_batch({"key": pa.array(key.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    counted = map_slices(chosen, [lang, text], count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.toArrow() if languages else None
    if rows is None or not rows.num_rows:
        return Model([])
    key = rows.column("key").to_numpy().astype(np.uint64)
    return Model.of(
        languages, (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF),
        rows.column("n").to_numpy(),
    )


def judge(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and code length per byte of each text."""
    text = strings(column)
    n = len(text)
    if not model.languages or not n:
        return np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n)
    words = Words(text)
    _, first, word = np.unique(words.hash, return_index=True, return_inverse=True)
    gram, coded = grams(words, first, ORDER)
    distinct, at = np.unique(gram, return_inverse=True)
    prices = model.bits(distinct)
    ends = np.cumsum(coded)
    bits = np.empty((n, len(model.languages)))
    for k in range(len(model.languages)):
        running = np.concatenate([[0.0], np.cumsum(prices[at, k])])
        per_word = running[ends] - running[ends - coded]
        bits[:, k] = np.bincount(words.row, per_word[word], n)
    best = bits.argmin(1)
    least = bits[np.arange(n), best]
    score = 1 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(1)
    size = np.bincount(words.row, words.length + 1, n)
    known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    names = np.array([*model.languages, UNKNOWN], object)[np.where(known, best, len(model.languages))]
    return names, np.where(known, score, 0.0), least / np.maximum(size, 1)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score, bits_per_byte)`` of every whole text.

    ``score`` is the share of the best language in the probabilities that all
    languages give the text. Null texts and those without a letter are ``und``
    with score 0; ties go to the first language by name; columns other than id
    and text are ignored; repeated rows repeat, an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        names, score, price = judge(shared.value, part.column(1))
        return pa.record_batch({
            "doc_id": part.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score),
            "bits_per_byte": pa.array(price),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, bits_per_byte double"
    return map_slices(docs, [doc_id, text], work, schema)


def keep_known(docs: DataFrame, model: Model, least_score: float = 0.5, text: str = "text") -> DataFrame:
    """Documents in a known language: not ``und``, and the best language at least as likely as all others together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(part: pa.RecordBatch) -> np.ndarray:
        names, score, _ = judge(shared.value, part.column(text))
        return (names != UNKNOWN) & (score >= least_score)

    return keep_rows(docs, text, known)


#: Rows with this remainder of crc32 of the id are held out from training.
HELD_OUT = (4, 2)


def train_on(docs: DataFrame, doc_id: str = "doc_id") -> Model:
    return train(docs, ~held_out(F.col(doc_id), *HELD_OUT) & F.col(doc_id).isNotNull(), doc_id)
