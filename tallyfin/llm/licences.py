"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton accepts every substring of every licence template, over word tokens.  A file is
streamed through it once: after each word the automaton holds the longest suffix of the words read so
far that stands in some template (matching statistics).  Where that gives MIN_MATCH words or more, each template's own
automaton gives its maximal matches, and the best chain of them is found by dynamic programming; a template whose
chain covers enough of its words is a label.

The templates are fixed values, so the automaton (a few thousand states) is built on each worker and
cached.  Files are streamed row by row in bounded pieces; nothing is shuffled or collected.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyfin.llm.common import clean_ids

#: Phrases whose places are always counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public licence notices, by label.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) "
        "to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. "
        "You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    ),
    "cddl": (
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    "eupl": (
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.",
    ),
    "gfdl": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; "
        "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ),
    "cc-by": (
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 3.0 Unported License.",
    ),
    "cc-by-nc": (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc-by-nc-nd": ("This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",),
    "cc-by-nc-sa": ("This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",),
    "cc-by-nd": ("This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "cc-by-sa": (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is also available with a FAQ at: http://scripts.sil.org/OFL",),
    "postgresql": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, "
        "provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ),
    "wtfpl": ("This program is free software. It comes without any warranty, to the extent permitted by applicable law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar.",),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        "or substantial portions of the Software.",
        "Released under the MIT License.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",),
}

#: Words of a match that counts, and the share of a template's words that chained matches must cover.
MIN_MATCH, COVER = 4, 0.8

_FOLD = bytearray(b" " * 48 + bytes(range(48, 58)) + b" " * 7 + bytes(range(97, 123)) + b" " * 6 + bytes(range(97, 123)) + b" " * 5 + bytes(range(128, 256)))


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode().translate(bytes(_FOLD)).split()


class Automaton:
    """Generalised suffix automaton over token ids; each state keeps the end places of its longest string, by template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for t, tokens in enumerate(templates):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((t, place + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _clone(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, token: int) -> int:
        if (q := self.next[last].get(token)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, token)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, token)
        return new

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(start, end, state) of the maximal matches of ``least`` tokens or more; tokens below 0 stand in no template."""
        state = length = 0
        for i, token in enumerate(tokens):
            before, reach = state, length
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            if length <= reach and reach >= least:
                yield i - reach, i, before
        if length >= least:
            yield len(tokens) - length, len(tokens), state


def chains(matches: list[tuple[int, int, int]], size: int, least: float) -> list[tuple[int, int, int]]:
    """(words covered, first word, end) of chains of matches (start, end, place in the template) that cover ``least`` words or more and do not overlap, the largest first.

    In a chain both the places in the text and those in the template rise, and a gap is no longer than
    the template.  A word counts once, in the text and in the template.  Each match takes the
    predecessor that gives it most, so a second place of the same words breaks no chain; only matches
    within two template lengths are looked at, which keeps the time linear in the text.
    """
    matches = sorted(matches)
    best, first, low = [], [], 0
    for i, (s, e, p) in enumerate(matches):
        n = e - s
        while matches[low][0] < s - 2 * size:
            low += 1
        top, begin = n, s
        for j in range(low, i):
            t, f, q = matches[j]
            if t < s and q < p and f < e and q + f - t < p + n and s <= f + size:
                gained = best[j] + n - max(0, f - s, q + f - t - p)
                if gained > top:
                    top, begin = gained, first[j]
        best.append(top)
        first.append(begin)
    out: list[tuple[int, int, int]] = []
    taken: list[tuple[int, int]] = []
    for covered, a, b in sorted(((c, a, m[1]) for c, a, m in zip(best, first, matches) if c >= least), key=lambda x: (-x[0], x[1], x[2])):
        k = bisect_left(taken, (b, -1))  # spans taken are disjoint: only the last that starts before the end can meet
        if k and taken[k - 1][1] > a:
            continue
        insort(taken, (a, b))
        out.append((covered, a, b))
    return out


class Scanner:
    def __init__(self):
        self.labels, texts = [], []
        for label, variants in TEMPLATES.items():
            for text in variants:
                self.labels.append(label)
                texts.append(words_of(text))
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        self.sizes = [len(t) for t in texts]
        coded = [[self.ids[w] for w in t] for t in texts]
        self.automaton, self.own = Automaton(coded), [Automaton([t]) for t in coded]
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in PHRASES.items()]

    def base(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """First and last word of each place of a phrase, and their labels."""
        joined = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            before = word = 0
            while at >= 0:
                word += joined.count(b" ", before, at)  # from the place before, so the text is counted through once
                before = at
                starts.append(word)
                labels.add(label)
                at = joined.find(phrase, at + 1)
        return starts, labels

    def spans(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, share of the template covered) of each chain of matches that covers enough."""
        ids = np.fromiter(map(self.ids.get, words, [-1] * len(words)), np.int64, len(words))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < MIN_MATCH:
                continue
            run = ids[a:b].tolist()
            if next(self.automaton.matches(run, MIN_MATCH), None) is None:
                continue
            # a longer match in one template hides those in others, so each is asked where any matches
            for template, own in enumerate(self.own):
                for start, end, state in own.matches(run, MIN_MATCH):
                    found.setdefault(template, []).extend((a + start, a + end, place - (end - start)) for _, place in own.ends[state])
        out = []
        for template, matches in found.items():
            size = self.sizes[template]
            out += [(covered, template, a, b) for covered, a, b in chains(matches, size, COVER * size)]
        # notices that differ in a word cover each other nearly: of spans over the same words the one that explains most stays
        taken, stand = bytearray(len(words)), []
        for covered, template, a, b in sorted(out, key=lambda x: (-x[0], -x[0] / self.sizes[x[1]], x[1], x[2])):
            if 2 * taken.count(1, a, b) < b - a:
                taken[a:b] = b"\1" * (b - a)
                stand.append((template, a, b, covered / self.sizes[template]))
        return sorted(stand, key=lambda x: (x[1], x[0]))

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        starts, base = self.base(words)
        spans = self.spans(words)
        labels = base | {self.labels[t] for t, *_ in spans}
        score = max([0.0, *(c for *_, c in spans), *([1.0] if base else [])])
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
            [{"label": self.labels[t], "first_word": a, "end_word": b, "cover": c} for t, a, b, c in spans],
        )


_scanner: list[Scanner] = []

_SPAN = "struct<label: string, first_word: long, end_word: long, cover: double>"


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first_word, end_word, cover).

    n_base counts all places of PHRASES' words; first_word and last_word are their least and largest
    start (null without any).  labels adds the templates that are covered; score is the largest
    cover, 1 where a phrase stands.  Null and empty texts have no words, no labels and score 0.
    Every row is kept, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())])
        for batch in batches:
            texts = batch.column(1)
            rows = [_scanner[0].scan(texts[i].as_py() or "") for i in range(len(texts))]
            columns = list(zip(*rows)) or [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(columns, (*kinds, pa.list_(span)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{_SPAN}>"
    return clean_ids(df, id_col, text_col).mapInArrow(run, schema)
