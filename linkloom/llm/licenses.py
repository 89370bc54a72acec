"""Licence scans by a generalised suffix automaton of licence texts.

The automaton of all template texts, as sequences of words, accepts every run of
words that stands in a template. A file streamed through it gives, at each word,
the longest such run that ends there (its matching statistics). Runs that can't
be extended are chained, template by template, into spans that follow the order
of the template; a template that a chain covers far enough labels the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkloom.llm.common import Words, map_slices

#: Words of the shortest run that counts for a long template, and the least share of it that a chain covers.
LEAST_RUN, LEAST_COVER = 4, 0.5
#: Templates up to so many words count only where they stand whole.
PHRASE_WORDS = 12
#: Words that a chain may skip in the file.
GAP = 30

# The phrases that give a base label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices, and the labels that they give.
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0"],
    "cc-by-nd": ["licensed under CC BY-ND 4.0"],
    "all-rights-reserved": ["all rights reserved"],
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """Words of a text with A-Z lower-cased."""
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with all places in each template for every state."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    longest: list[int] = field(default_factory=lambda: [0])
    place: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])

    def _new(self, longest: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.place.append({})
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """State for the runs of ``target`` that are no longer than one step from ``state``."""
        copy = self._new(self.longest[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, template: int, symbols: list[int]) -> None:
        """Add every run of a template; the walk starts anew at the root."""
        last = 0
        for symbol in symbols:
            target = self.step[last].get(symbol)
            if target is not None:
                last = target if self.longest[target] == self.longest[last] + 1 else self._split(last, symbol, target)
                continue
            state, fresh = last, self._new(self.longest[last] + 1, {}, 0)
            while state >= 0 and symbol not in self.step[state]:
                self.step[state][symbol] = fresh
                state = self.link[state]
            if state >= 0:
                target = self.step[state][symbol]
                near = self.longest[target] == self.longest[state] + 1
                self.link[fresh] = target if near else self._split(state, symbol, target)
            last = fresh

    def locate(self, template: int, symbols: list[int]) -> None:
        """Note where a template reads each of its runs: their last words' numbers, on all states that end there."""
        state = 0
        for at, symbol in enumerate(symbols):
            state = self.step[state][symbol]
            up = state
            while up > 0:
                self.place[up].setdefault(template, []).append(at)
                up = self.link[up]

    def statistics(self, symbols: list[int]) -> list[tuple[int, int]]:
        """State and length of the longest run that ends at each word."""
        out, state, length = [], 0, 0
        for symbol in symbols:
            while state and symbol not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            if symbol in self.step[state]:
                state, length = self.step[state][symbol], length + 1
            else:
                length = 0
            out.append((state, length))
        return out


class Scanner:
    """Templates as word numbers, their automaton, and which pairs of words stand in any of them."""

    def __init__(self, base: dict[str, str] | None = None, notices: dict[str, list[str]] | None = None):
        base, notices = BASE if base is None else base, NOTICES if notices is None else notices
        texts = [(words_of(phrase), label, True) for phrase, label in base.items()]
        texts += [(words_of(t), label, False) for label, group in notices.items() for t in group]
        self.labels = [label for _, label, _ in texts]
        self.is_base = [b for _, _, b in texts]
        self.sizes = [len(words) for words, _, _ in texts]
        vocabulary = sorted({w for words, _, _ in texts for w in words})
        number = {w: k for k, w in enumerate(vocabulary)}
        symbols = [[number[w] for w in words] for words, _, _ in texts]
        self.automaton = Automaton()
        for k, s in enumerate(symbols):
            self.automaton.add(k, s)
        for k, s in enumerate(symbols):
            self.automaton.locate(k, s)
        hashes = Words(pa.array(vocabulary)).hash
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        self.pairs = np.zeros((len(vocabulary), len(vocabulary)), bool)
        for s in symbols:
            self.pairs[s[:-1], s[1:]] = True

    def runs(self, words: Words) -> list[tuple[int, int, int]]:
        """Text, first and last word of the stretches in which every two neighbours stand so in some template.

        Outside them no run of two words can match, so only they are streamed.
        """
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        number = np.where(self.hashes[at] == words.hash, self.numbers[at], -1) if len(words.hash) else np.zeros(0, int)
        self.current = number
        a, b = number[:-1], number[1:]
        good = (a >= 0) & (b >= 0) & (words.row[:-1] == words.row[1:])
        good[good] = self.pairs[a[good], b[good]]
        edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
        return list(zip(
            words.row[np.flatnonzero(edge == 1)].tolist() if good.any() else [],
            np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True,
        ))

    def scan(self, column: pa.Array) -> list[dict]:
        """Findings of every text: number of words, base places, and ``(template, start, stop, cover)`` spans."""
        words = Words(column, ascii_only=True)
        out = [{"n_words": int(n), "base": [], "spans": []} for n in words.count]
        held: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for row, first, last in self.runs(words):
            symbols = self.current[first : last + 1].tolist()
            statistics = self.automaton.statistics(symbols)
            begin = int(words.first[row])
            for k, (state, length) in enumerate(statistics):
                self._whole(out[row], state, length, first + k - begin)
                ended = k + 1 == len(statistics) or statistics[k + 1][1] != length + 1
                if ended and length >= LEAST_RUN:
                    for template, places in self.automaton.place[state].items():
                        if self.sizes[template] > PHRASE_WORDS:
                            stop = first + k - begin + 1
                            held.setdefault((row, template), []).extend((stop, at + 1, length) for at in places)
        for (row, template), matches in sorted(held.items()):
            out[row]["spans"] += [(template, *span) for span in chains(matches, self.sizes[template])]
        return out

    def _whole(self, found: dict, state: int, length: int, at: int) -> None:
        """Short templates that end at this word, whole."""
        while state > 0:
            for template, places in self.automaton.place[state].items():
                size = self.sizes[template]
                if places[-1] == size - 1 and size <= PHRASE_WORDS and self.automaton.longest[self.automaton.link[state]] < size <= length:
                    if self.is_base[template]:
                        found["base"].append((template, at - size + 1))
                    else:
                        found["spans"].append((template, at - size + 1, at + 1, 1.0))
            state = self.automaton.link[state]
            length = min(length, self.automaton.longest[state]) if state > 0 else 0


def chains(matches: list[tuple[int, int, int]], size: int, gap: int = GAP, cover: float = LEAST_COVER) -> list[tuple[int, int, float]]:
    """``(start, stop, cover)`` of the heaviest chains of runs that cover enough of a template of ``size`` words, in order.

    A run ``(stop in the file, stop in the template, length)`` may follow another
    that ends earlier in both and, in the file, at most ``gap`` words before it
    starts; where they overlap, only its new words count. The heaviest chain is
    taken first, of equal ones that nearest to the middle; then the runs wholly
    before it and those wholly after it are chained on their own.
    """
    out, open_ = [], [np.array(sorted(matches), np.int64)]
    while open_:
        runs = open_.pop()
        weight, start = _heaviest(runs, gap)
        best = np.flatnonzero(weight == weight.max())
        last = int(best[np.abs(best - len(weight) // 2).argmin()])
        if weight[last] < cover * size:
            continue
        begin, stop = int(start[last]), int(runs[last, 0])
        out.append((begin, stop, min(1.0, int(weight[last]) / size)))
        sides = (runs[runs[:, 0] <= begin], runs[runs[:, 0] - runs[:, 2] >= stop])
        open_ += [side for side in sides if len(side)]
    return sorted(out)


def _heaviest(runs: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the heaviest chain that ends with each run, and where it starts in the file."""
    stop, at, length = runs.T
    weight, start = length.copy(), stop - length
    reach = np.searchsorted(stop, stop - length - gap)  # runs that end at most a gap before
    for i in range(1, len(runs)):
        j = slice(int(reach[i]), i)
        fresh = np.minimum(np.minimum(stop[i] - stop[j], at[i] - at[j]), length[i])
        total = np.where(fresh > 0, weight[j] + fresh, 0)
        if len(total):
            k = int(total.argmax())
            if total[k] > weight[i]:
                weight[i], start[i] = total[k], start[int(reach[i]) + k]
    return weight, start


def spans(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, label, start, stop, cover)``: every covered template span, in words from 0."""
    tool = scanner or Scanner()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(k, *s) for k, found in enumerate(tool.scan(part.column(1))) for s in found["spans"]]
        return pa.record_batch({
            "doc_id": part.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
            "label": pa.array([tool.labels[r[1]] for r in rows], pa.string()),
            "start": pa.array([r[2] for r in rows], pa.int64()), "stop": pa.array([r[3] for r in rows], pa.int64()),
            "cover": pa.array([r[4] for r in rows], pa.float64()),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs, [doc_id, text], work, f"doc_id {kind}, label string, start bigint, stop bigint, cover double")


def scan(docs: DataFrame, scanner: Scanner | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence findings of every whole text.

    ``n_base``, ``first_word`` and ``last_word`` are the number of places of the
    base phrases and the smallest and largest word that one starts at (null if
    none); ``score`` is the largest cover of a template, 1 for a whole phrase, 0
    without findings. Null texts are empty and have no words; columns other than
    id and text are ignored; repeated rows repeat, an empty table gives no rows.
    """
    tool = scanner or Scanner()

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        found = tool.scan(part.column(1))
        starts = [sorted(at for _, at in f["base"]) for f in found]
        base = [{tool.labels[t] for t, _ in f["base"]} for f in found]
        own = [{tool.labels[s[0]] for s in f["spans"]} for f in found]
        score = [max([1.0 if f["base"] else 0.0, *(s[3] for s in f["spans"])]) for f in found]
        return pa.record_batch({
            "doc_id": part.column(0), "n_words": pa.array([f["n_words"] for f in found], pa.int64()),
            "n_base": pa.array([len(s) for s in starts], pa.int64()),
            "first_word": pa.array([s[0] if s else None for s in starts], pa.int64()),
            "last_word": pa.array([s[-1] if s else None for s in starts], pa.int64()),
            "base_labels": pa.array([",".join(sorted(b)) for b in base], pa.string()),
            "labels": pa.array([",".join(sorted(a | b)) for a, b in zip(own, base, strict=True)], pa.string()),
            "score": pa.array(score, pa.float64()),
        })

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_slices(docs, [doc_id, text], work, (
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels string, labels string, score double"
    ))
