"""Licence scan by matching statistics over a generalised suffix automaton.

The automaton holds the word sequences of all templates.  A text is streamed through it: at
every word the automaton knows the longest stretch that ends there and occurs in some
template.  Stretches of at least ``MIN_WORDS`` words that cannot grow are kept, at every place
that a template has them.  Per template the chains of stretches that keep its order and lie close
together are found by dynamic programming, those that cover most first; a chain that covers
enough of the template is a span with a label.  Words that no template has cannot be part of a match,
and runs of template words shorter than ``MIN_WORDS`` cannot hold a kept one; both are skipped
in arrays before the automaton sees them.

Base phrases are found on the same word ids; every place counts, also in repeated texts.
Null and empty texts have no words, null places, empty labels and score 0.  Whole texts are
read, and other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.llm.common import hashed_words, map_slices, span_hashes, utf8

# Phrases that name a licence, and public licence notices.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
           "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                    "following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
             "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc": "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                    "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
                    "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
                    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
             "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
              "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit "
             "http://creativecommons.org/licenses/by/4.0/.",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution ShareAlike 4.0 International License. To view a copy of this license, visit "
                "http://creativecommons.org/licenses/by-sa/4.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
                 "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

MIN_WORDS = 4
GAP_WORDS = 12
MIN_COVERAGE = 0.6

#: Word bytes: digits, letters after lower-casing, and everything beyond ASCII.
_MEMBER = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def word_ids(text: str) -> list[bytes]:
    """The words of a short text, by the scan's own rule."""
    out, word = [], bytearray()
    for b in text.encode().lower() + b" ":
        if _MEMBER[b]:
            word.append(b)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out


class SuffixAutomaton:
    """Generalised: one automaton of all sequences, with each state's ends in every sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.length, self.link, self.step = [0], [-1], [{}]
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].setdefault(k, set()).add(i + 1)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            above = self.ends[self.link[state]]
            for k, ends in self.ends[state].items():
                above.setdefault(k, set()).update(ends)

    def _state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, at: int, symbol: int, target: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while at >= 0 and self.step[at].get(symbol) == target:
            self.step[at][symbol] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        target = self.step[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and symbol not in self.step[at]:
            self.step[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            target = self.step[at][symbol]
            self.link[new] = target if self.length[target] == self.length[at] + 1 else self._split(at, symbol, target)
        return new

    def maximal_matches(self, symbols: list[int], least: int):
        """(start, length, state) of stretches that the next symbol does not lengthen."""
        state = length = 0
        for i, symbol in enumerate(symbols):
            was, held = state, length
            while state and symbol not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.step[state]:
                state, length = self.step[state][symbol], length + 1
            if length <= held and held >= least:
                yield i - held, held, was
        if length >= least:
            yield len(symbols) - length, length, state


class Scanner:
    """Templates and phrases made ready once per worker."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.labels = list(templates)
        sequences = [word_ids(t) for t in templates.values()]
        named = [(word_ids(p), label) for p, label in phrases.items()]
        words = sorted({w for s in sequences for w in s} | {w for p, _ in named for w in p})
        joined, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
        hashes = span_hashes(joined, ends[:-1], ends[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        place = {words[k]: i for i, k in enumerate(order)}
        self.sizes = [len(s) for s in sequences]
        self.automaton = SuffixAutomaton([[place[w] for w in s] for s in sequences])
        self.phrases = [([place[w] for w in p], label) for p, label in named]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; -1 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def places(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, str]]:
        """Start words of every phrase; ``ends`` is the end of the row of each word."""
        out = []
        for phrase, label in self.phrases:
            n = max(0, len(ids) - len(phrase) + 1)
            hit = np.ones(n, bool)
            for k, word in enumerate(phrase):
                hit &= ids[k: k + n] == word
            at = np.flatnonzero(hit)
            out.append((at[at + len(phrase) <= ends[at]], label))
        return out

    def spans(self, symbols: list[int], first: int) -> list[tuple[int, int, int, int, int]]:
        """Kept matches of one run: template, start and end in the text, start and end in the template."""
        out = []
        for start, length, state in self.automaton.maximal_matches(symbols, MIN_WORDS):
            for k, ends in self.automaton.ends[state].items():
                out.extend((k, first + start, first + start + length, end - length, end) for end in ends)
        return out

    def chains(self, matches: list[tuple[int, int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Label, text span and coverage of the chains of every template, each match in one of them at most.

        A match follows another one that ends before it, in the text and in the template, at most
        ``GAP_WORDS`` words of text earlier; it adds the template words that the other had not
        reached.  The chain that covers most is taken first, then the best among the rest of the text.
        """
        out = []
        matches.sort()
        at = 0
        while at < len(matches):
            k, stop = matches[at][0], at
            while stop < len(matches) and matches[stop][0] == k:
                stop += 1
            own, at = matches[at:stop], stop
            covered, before, low = [], [], 0
            for i, (_, start, end, t_start, t_end) in enumerate(own):
                # matches are sorted by start, and none is longer than the template
                while own[low][1] < start - GAP_WORDS - self.sizes[k]:
                    low += 1
                best, link = t_end - t_start, -1
                for j in range(low, i):
                    _, _, e, _, te = own[j]
                    if start - e <= GAP_WORDS and te < t_end and e < end and covered[j] + t_end - max(te, t_start) > best:
                        best, link = covered[j] + t_end - max(te, t_start), j
                covered.append(best)
                before.append(link)
            used: list[tuple[int, int]] = []
            for i in sorted(range(len(own)), key=lambda i: (-covered[i], own[i][1])):
                j, first = i, own[i][1]
                while j >= 0:
                    first, j = own[j][1], before[j]
                span = first, own[i][2]
                place = bisect_left(used, span)
                if (place and used[place - 1][1] > span[0]) or (place < len(used) and used[place][0] < span[1]):
                    continue
                used.insert(place, span)
                out.append((self.labels[k], *span, covered[i] / self.sizes[k]))
        return out


_scanners: dict = {}


def scanner(templates: dict[str, str], phrases: dict[str, str]) -> Scanner:
    key = tuple(templates.items()), tuple(phrases.items())
    if key not in _scanners:
        _scanners[key] = Scanner(templates, phrases)
    return _scanners[key]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the template spans
    (``label:first word:end word:coverage``); no shuffle."""

    def task(batch):
        own = scanner(templates, phrases)
        data, rows = utf8(batch)
        hashes, _, firsts = hashed_words(data, rows, _MEMBER)
        ids, n = own.ids(hashes), len(rows) - 1
        row_of = np.repeat(np.arange(n), np.diff(firsts))
        row_end = firsts[1:][row_of]
        counts, low, high = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
        base: list[set] = [set() for _ in range(n)]
        for at, label in own.places(ids, row_end):
            where = row_of[at]
            np.add.at(counts, where, 1)
            for row, word in zip(where.tolist(), (at - firsts[where]).tolist()):
                base[row].add(label)
                low[row] = word if low[row] < 0 else min(low[row], word)
                high[row] = max(high[row], word)
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        found: dict[int, list] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            while b - a >= MIN_WORDS:
                row = int(row_of[a])
                stop = min(b, int(firsts[row + 1]))
                if stop - a >= MIN_WORDS and (spans := own.spans(ids[a:stop].tolist(), a - int(firsts[row]))):
                    found.setdefault(row, []).extend(spans)
                a = stop
        labels, score, said = [set(x) for x in base], (counts > 0).astype(float), [""] * n
        for row, matches in found.items():
            chains = own.chains(matches)
            score[row] = max(score[row], max(c[3] for c in chains))
            kept = [c for c in chains if c[3] >= MIN_COVERAGE]
            labels[row].update(c[0] for c in kept)
            said[row] = ",".join(f"{label}:{a}:{b}:{cover:.3f}" for label, a, b, cover in sorted(kept, key=lambda c: (c[1], c[0])))
        null = low < 0
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(firsts), pa.int64()), pa.array(counts, pa.int64()), pa.array(low, pa.int64(), mask=null), pa.array(high, pa.int64(), mask=null),
             pa.array([",".join(sorted(x)) for x in base]), pa.array([",".join(sorted(x)) for x in labels]), pa.array(np.minimum(score, 1.0)), pa.array(said)],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(plain, task, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")


def op7_licence_scan(spark, sf_dir) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
