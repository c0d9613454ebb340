"""Licence scan by matching statistics on a generalised suffix automaton of template words.

The automaton holds every run of words of all templates. A text is streamed through it: after each
word the state and the length say which longest run of template words ends there. Long maximal
matches are chained, template by template, into spans with the share of the template they cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from souklens.llm import textbytes as tb

# The phrases and labels that a result must hold in any case.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wordings of public licence notices, and the label of each.
TEMPLATES = {
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "all-rights-reserved": "All rights reserved",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                         "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
           "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                  "either version 3 of the License, or (at your option) any later version.",
    "gpl-work": "This work is licensed under the GNU General Public License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                 "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-release": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "warranty-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}

#: Words of a match that counts as long; words of text that a chain may skip; share of a template that makes its label.
LONG, GAP, COVER = 3, 12, 0.75


def words_of(text: str) -> list[bytes]:
    block = next(tb.blocks(pa.array([text])))
    data = tb.FOLD[block.data]
    return [data[a:b].tobytes() for a, b in zip(*tb.spans(tb.ALNUM[data], block.offsets))]


class Automaton:
    """Generalised suffix automaton of word sequences; ``ends`` lists where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        self.sequences = sequences
        for k, sequence in enumerate(sequences):
            state = 0
            for i, word in enumerate(sequence):
                state = self._extend(state, word)
                self.ends[state].append((k, i))
        # what ends in a state ends in the states of its suffixes as well
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.step) - 1

    def _split(self, state: int, word: int) -> int:
        """The state for ``state``'s longest run and ``word``, taken out of a longer one if need be."""
        to = self.step[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        part = self._new(self.length[state] + 1, dict(self.step[to]), self.link[to])
        self.link[to] = part
        while state >= 0 and self.step[state].get(word) == to:
            self.step[state][word] = part
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def statistics(self, words: list[int]):
        """After each word: the state and the length of the longest run of template words that ends there."""
        state = size = 0
        for word in words:
            while state and word not in self.step[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.step[state]:
                state = self.step[state][word]
                size += 1
            else:
                size = 0
            yield state, size


class Scanner:
    """Phrases and templates as one automaton, with the vocabulary that text words are looked up in."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.n_phrases = len(phrases)
        self.labels = [*phrases.values(), *templates.keys()]
        worded = [words_of(x) for x in [*phrases, *templates.values()]]
        vocabulary = sorted({w for x in worded for w in x})
        ids = {w: i for i, w in enumerate(vocabulary)}
        sequences = [[ids[w] for w in x] for x in worded]
        self.sizes = [len(x) for x in sequences]
        self.automaton = Automaton(sequences)
        self.ids = ids
        # which words follow which: runs of text without such a pair can't match two words
        n = len(vocabulary)
        self.pairs, self.kept_pairs = np.zeros((n + 1, n + 1), bool), np.zeros((n + 1, n + 1), bool)
        for k, x in enumerate(sequences):
            for a, b in zip(x, x[1:]):
                self.pairs[a, b] = True
                self.kept_pairs[a, b] |= k < self.n_phrases and len(x) == 2
        self.alone = np.zeros(n + 1, bool)  # words that are a phrase by themselves
        self.alone[[x[0] for x in sequences[:self.n_phrases] if len(x) == 1]] = True
        # phrases that end wherever a state's run ends: those of the state and of its suffixes
        self.phrase_ends: list[list[int]] = [[] for _ in self.automaton.step]
        for k in range(self.n_phrases):
            state = 0
            for word in sequences[k]:
                state = self.automaton.step[state][word]
            self.phrase_ends[state].append(k)
        for state in sorted(range(1, len(self.phrase_ends)), key=lambda s: self.automaton.length[s]):
            self.phrase_ends[state] = self.phrase_ends[state] + self.phrase_ends[self.automaton.link[state]]

    def vocabulary_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each word, its size for other words."""
        codes, words = tb.distinct(data, starts, ends)
        other = len(self.ids)
        return np.array([self.ids.get(w, other) for w in words], np.int64)[codes] if words else codes

    def scan_run(self, words: list[int], base: int, phrases: list, matches: list) -> None:
        """Streams one run of words; adds (phrase, start) to ``phrases`` and long maximal matches to ``matches``."""
        before = (0, 0)
        for i, (state, size) in enumerate([*self.automaton.statistics(words), (0, 0)]):
            for k in self.phrase_ends[state]:
                if self.sizes[k] <= size:
                    phrases.append((k, base + i - self.sizes[k] + 1))
            if before[1] >= LONG and size <= before[1]:
                matches.append((base + i - before[1], before[1], before[0]))
            before = state, size

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share covered) of every chain, in order of start.

        A match continues its template's open chain if it stands after it in text, at most ``GAP``
        words on, and after it in the template; else it begins a new chain.
        """
        open_: dict[int, list] = {}
        done = []

        def close(k: int) -> None:
            start, end, _, covered = open_.pop(k)
            done.append((self.labels[k], start, end, covered / self.sizes[k]))

        for start, size, state in matches:
            places: dict[int, list[int]] = {}
            for k, last in self.automaton.ends[state]:
                if k >= self.n_phrases:
                    places.setdefault(k, []).append(last - size + 1)
            for k, begins in places.items():
                if k in open_:
                    _, end, reached, _ = open_[k]
                    # maximal matches may overlap; the later one counts from where the other ended
                    shift = max(0, end - start)
                    later = [b for b in begins if b + shift >= reached]
                    if later and start - end <= GAP and shift < size:
                        b = min(later)
                        chain = open_[k]
                        chain[1], chain[2] = start + size, b + size
                        chain[3] += size - shift
                        continue
                    if shift >= size:
                        continue
                    close(k)
                open_[k] = [start, start + size, min(begins) + size, size]
        for k in list(open_):
            close(k)
        return sorted(done, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",), phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, cover: float = COVER) -> DataFrame:
    """Licence wording in every text: ``keep`` and

    * ``n_words``; ``n_base`` places of phrases, ``first_word``, ``last_word`` their smallest and largest start (else null),
    * ``base_labels``, ``labels``: of phrases, and of phrases and covered templates; distinct, sorted, comma-joined,
    * ``score``: 1 if a phrase stands in the text, else the largest share of a template that a chain covers,
    * ``spans``: label, start and end word and share of every chain that covers at least ``cover``.

    A null or empty text has no words, places, labels or spans and score 0. Rows stay as given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))

    def work(block: tb.Block) -> dict:
        scanner = shared.value
        data = tb.FOLD[block.data]
        starts, ends = tb.spans(tb.ALNUM[data], block.offsets)
        first = np.searchsorted(starts, block.offsets)
        ids = scanner.vocabulary_ids(data, starts, ends)
        linked = np.zeros(len(ids), bool)  # with the next word of the text
        if len(ids) > 1:
            linked[:-1] = scanner.pairs[ids[:-1], ids[1:]]
        text_ends = first[1:] - 1
        linked[text_ends[text_ends >= 0]] = False
        low, high = tb.spans(linked, first)
        short = high - low == 1
        keep_short = scanner.kept_pairs[ids[low], ids[np.minimum(low + 1, max(0, len(ids) - 1))]] if len(low) else short
        real = ~short | keep_short
        low, high = low[real], high[real] + 1
        covered = np.zeros(len(ids), bool)
        covered[tb.ragged(high - low, low)] = True
        single = np.flatnonzero(scanner.alone[ids] & ~covered)
        low, high = np.concatenate([low, single]), np.concatenate([high, single + 1])
        n = len(block)
        places, matches = [[] for _ in range(n)], [[] for _ in range(n)]
        for doc, a, b in zip((np.searchsorted(first, low, side="right") - 1).tolist(), low.tolist(), high.tolist()):
            scanner.scan_run(ids[a:b].tolist(), a - int(first[doc]), places[doc], matches[doc])
        out = {k: [] for k in ("n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        for found, longs in zip(places, matches):
            chains = scanner.chains(longs) if longs else []
            spans = [{"label": k, "start": a, "end": b, "share": s} for k, a, b, s in chains if s >= cover]
            base = {scanner.labels[k] for k, _ in found}
            at = [i for _, i in found]
            out["n_base"].append(len(found))
            out["first_word"].append(min(at, default=None))
            out["last_word"].append(max(at, default=None))
            out["base_labels"].append(",".join(sorted(base)))
            out["labels"].append(",".join(sorted(base | {s["label"] for s in spans})))
            out["score"].append(1.0 if found else max((min(1.0, s) for *_, s in chains), default=0.0))
            out["spans"].append(spans)
        kinds = {"first_word": pa.int64(), "last_word": pa.int64(),
                 "spans": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))}
        return {"n_words": np.diff(first)} | {k: pa.array(v, kinds.get(k)) for k, v in out.items()}

    return tb.map_texts(docs, text_col, list(keep), "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
                        "spans array<struct<label:string,start:long,end:long,share:double>>", work)
