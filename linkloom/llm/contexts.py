"""Byte contexts within words: grams of a slice of words, and count tables per context length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from linkloom.llm.common import Words

PAD = 0x20


def grams(words: Words, chosen: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the chosen words and their ends, with its ``order`` predecessors as one number; and bytes per word.

    A word is taken to stand between spaces; up to seven predecessors fit.
    """
    length = words.length[chosen]
    size = length + order + 1
    begin = np.cumsum(size) - size
    text = np.full(int(size.sum()), PAD, np.uint64)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    text[np.repeat(begin + order, length) + within] = words.chars[np.repeat(words.start[chosen], length) + within]
    coded = length + 1
    at = np.repeat(begin + order, coded) + np.arange(int(coded.sum())) - np.repeat(np.cumsum(coded) - coded, coded)
    out = text[at].copy()
    for k in range(1, order + 1):
        out |= text[at - k] << np.uint64(8 * k)
    return out, coded


def ending(gram: np.ndarray, order: int) -> np.ndarray:
    """The grams cut to ``order`` predecessors."""
    return gram & np.uint64((1 << 8 * (order + 1)) - 1)


def rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of ``values`` by sorted ``keys``, zeros for keys that are missing."""
    if not len(keys):
        return np.zeros((len(wanted), values.shape[1]))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], 0)


@dataclass
class Level:
    """Statistics of one context length, a column per class: counts of grams, totals and kinds of contexts."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, gram: np.ndarray, column: np.ndarray, count: np.ndarray, columns: int) -> Level:
        distinct, at = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(distinct), columns))
        np.add.at(counts, (at, column), count)
        contexts, at = np.unique(distinct >> np.uint64(8), return_inverse=True)
        totals, kinds = (np.zeros((len(contexts), columns)) for _ in range(2))
        np.add.at(totals, at, counts)
        np.add.at(kinds, at, counts > 0)
        return cls(distinct, counts, contexts, totals, kinds)

    def look_up(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of the grams, totals and kinds of their contexts."""
        context = gram >> np.uint64(8)
        return rows(self.grams, self.counts, gram), rows(self.contexts, self.totals, context), rows(self.contexts, self.kinds, context)
