"""Licence notices inside texts, found with one suffix automaton over the words of all templates.

The automaton (``Automaton``) has a state for each set of end places that substrings of the templates share. A text is streamed through it word
by word; at each word it gives the longest stretch ending there that any template holds (the matching statistics). Stretches that cannot
be extended are anchors at their places in each template. Anchors that follow each other in the text and in a template, with few words
between, are chained; a chain that covers enough of its template is a span with the template's label. Phrases are templates too that count only
as a whole: the states that end with one name it, so every place of a phrase is put out.

Words are lower-cased (A-Z) runs of letters, digits and bytes beyond ASCII. Null and empty texts have no word, no span and score 0. What is
held of a text at a time is its words and the chains that can still grow; rows are judged one by one, whatever their id, and columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leadloom.llm.common import pieces

LEAST_ANCHOR, GAP, COVER = 3, 6, 0.75
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases that are reported wherever they stand.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

# Notices as the licences ask for them or as they are commonly given.
NOTICES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the"
             " Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
                   " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES'
                   " OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "Released under the Apache License 2.0"),
    ("boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
            " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
            " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
            " and/or other materials provided with the distribution."),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Released under the BSD License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under the Creative Commons Attribution License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the"
            " Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
            " PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "Licensed under the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"
            " and this permission notice appear in all copies."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the"
             " Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the"
            " Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
            " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission"
            " notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
                " http://mozilla.org/MPL/2.0/"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR"
                 " A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
)


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())  # bytes.lower touches A-Z only


class Automaton:
    """Generalised suffix automaton: of every state the longest string, the state of its longest suffix with other end places, and the steps by word."""

    def __init__(self):
        self.length, self.link, self.steps = [0], [-1], [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, place behind the last word) of prefixes that end in the state

    def _state(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.steps.append(steps)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state of its own for the suffixes of ``q`` that ``p`` leads to."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.steps[q]))
        self.link[q] = clone
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = clone
            p = self.link[p]
        return clone

    def _append(self, last: int, word: int) -> int:
        known = self.steps[last].get(word)
        if known is not None:  # another template has this prefix inside it
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.steps[p]:
            self.steps[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def add(self, template: int, words: list[int]) -> None:
        last = 0
        for at, word in enumerate(words, 1):
            last = self._append(last, word)
            self.ends[last].append((template, at))

    def close(self) -> None:
        """Gives every state all places where its strings end: its own and those of the states that link to it."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]].extend(self.ends[state])

    def read(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state of the longest stretch that ends with ``word``, and its number of words."""
        steps, link = self.steps, self.link
        while state and word not in steps[state]:
            state = link[state]
            length = self.length[state]
        to = steps[state].get(word)
        return (0, 0) if to is None else (to, length + 1)


class Scanner:
    """Templates and phrases in one automaton."""

    def __init__(self, notices: tuple, phrases: tuple, least: int, gap: int, cover: float):
        self.least, self.gap, self.cover = least, gap, cover
        self.codes: dict[bytes, int] = {}
        self.labels, self.sizes = [], []
        self.machine = Automaton()
        rows = [(label, words_of(text.encode())) for label, text in (*notices, *phrases)]
        first_phrase = len(notices)
        for number, (label, words) in enumerate(rows):
            self.labels.append(label)
            self.sizes.append(len(words))
            self.machine.add(number, [self.codes.setdefault(w, len(self.codes)) for w in words])
        self.machine.close()
        # what a state's strings end with: a phrase is the suffix of another string if its state is on the way of links
        self.whole: dict[int, list[tuple[int, int]]] = {}
        states = self.machine
        for state in sorted(range(1, len(states.length)), key=states.length.__getitem__):
            own = [(t, self.sizes[t]) for t, end in states.ends[state] if t >= first_phrase and end == self.sizes[t] and states.length[states.link[state]] < end <= states.length[state]]
            through = self.whole.get(states.link[state], [])
            if own or through:
                self.whole[state] = sorted({*own, *through})
        self.places = [sorted({(t, e) for t, e in ends if t < first_phrase}) for ends in states.ends]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]], float]:
        """((label, start) of every phrase; (label, start, end, share) of every span; best share of any template)."""
        codes = np.fromiter((self.codes.get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[False], codes >= 0, [False]]).astype(np.int8)))
        phrases, anchors = [], []
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < 2:
                continue
            state = length = 0
            for i, word in enumerate(codes[a:b].tolist(), a):
                before, had = state, length
                state, length = self.machine.read(state, length, word)
                if length != had + 1 and had >= self.least:
                    anchors.append((i - had, had, before))
                for t, size in self.whole.get(state, ()):
                    if size <= length:
                        phrases.append((self.labels[t], i + 1 - size))
            if length >= self.least:
                anchors.append((b - length, length, state))
        spans, best = self.chained(anchors)
        return phrases, spans, max(best, 1.0 if phrases else 0.0)

    def chained(self, anchors: list[tuple[int, int, int]]) -> tuple[list[tuple[str, int, int, float]], float]:
        """Spans of the anchors (start, length, state), and the best share of any chain. A chain is [first word, end in the text, end in the template, words covered].

        Starts and ends of anchors both ascend, so a chain that ended more than ``gap`` words before one cannot grow any more and is let go."""
        growing: dict[int, list[list[int]]] = {}
        spans, best = [], 0.0

        def closed(template: int, chains: list[list[int]]) -> None:
            nonlocal best
            for first, end, _, covered in chains:
                share = covered / self.sizes[template]
                best = max(best, share)
                if share >= self.cover:
                    spans.append((template, first, end, share))

        for start, length, state in anchors:
            for template, place in self.places[state]:
                chains = growing.setdefault(template, [])
                closed(template, [c for c in chains if start - c[1] > self.gap])
                chains = [c for c in chains if start - c[1] <= self.gap]
                taken = [start, start + length, place, length]
                for first, end, at, covered in chains:
                    over = max(end - start, at - (place - length), 0)
                    if over < length and place - length + over - at <= self.gap and start + over - end <= self.gap and covered + length - over > taken[3]:
                        taken = [first, start + length, place, covered + length - over]
                growing[template] = [*chains, taken]
        for template, chains in growing.items():
            closed(template, chains)
        return self.widest(spans), min(best, 1.0)

    def widest(self, spans: list[tuple[int, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Overlapping spans of one label as one, with the larger share."""
        kept: list[tuple[str, int, int, float]] = []
        for label, first, end, share in sorted(((self.labels[t], f, e, s) for t, f, e, s in spans), key=lambda s: (s[0], s[1], -s[2], -s[3])):
            if kept and kept[-1][0] == label and first < kept[-1][2]:
                old = kept[-1]
                kept[-1] = (label, old[1], max(end, old[2]), max(share, old[3]))
            else:
                kept.append((label, first, end, share))
        return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


@lru_cache(4)
def scanner(notices: tuple, phrases: tuple, least: int, gap: int, cover: float) -> Scanner:
    return Scanner(notices, phrases, least, gap, cover)


def scan(docs: DataFrame, notices: tuple = NOTICES, phrases: tuple = PHRASES, least: int = LEAST_ANCHOR, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """(doc_id, n_words, phrases, spans, score) for every row; score is the largest share of a template that a chain covers, 1 where a phrase stands.

    An anchor has ``least`` words, at most ``gap`` words lie between anchors of a chain, and a span covers ``cover`` of its template.
    The templates are a parameter and travel with the job; the automaton has at most two states for each of their words."""
    key = docs.schema["doc_id"].dataType
    schema = (f"doc_id {key.simpleString()}, n_words long, phrases array<struct<label:string,start:long>>, "
              "spans array<struct<label:string,start:long,end:long,share:double>>, score double")
    phrase_kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span_kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
    kind = to_arrow_type(key)

    def run(batches):
        own = scanner(notices, phrases, least, gap, cover)
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for text in part.column("text").fill_null("").cast(pa.large_binary()).to_pylist():
                    words = words_of(text)
                    found, spans, score = own.scan(words)
                    rows.append((len(words), [dict(zip(("label", "start"), p)) for p in found], [dict(zip(("label", "start", "end", "share"), s)) for s in spans], score))
                made = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), phrase_kind, span_kind, pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(kind), *made], names=["doc_id", "n_words", "phrases", "spans", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
