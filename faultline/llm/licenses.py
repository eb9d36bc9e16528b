"""License scans: a generalised suffix automaton of licence words, matching statistics, chained spans.

The automaton holds every run of words of all templates (licence notices, and the base phrases as short
templates). A text streams through it once: after each word the automaton knows the longest run of
template words that ends there. A base phrase ends where its state is a suffix of the current run.
Maximal runs of MIN_RUN words or more are matches with their places in the templates; matches that keep
the order of a template chain into spans, and a template covered to at least COVERED adds its label.

Words are lower-cased runs of ASCII letters, digits and all non-ASCII characters. Null and empty texts
have no words and no labels. Rows are independent: repeated rows, empty tables and extra columns need
no special case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.common import arrow_map
from faultline.llm.decontaminate import words

#: Words in a match at least, share of a template that gives its label, and words between chained
#: matches at most.
MIN_RUN, COVERED, GAP = 5, 0.6, 40

# Base phrases and the labels they give.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices, short statements and whole texts of common licences, as published.
TEMPLATES = (
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("mit", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("isc", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    ("cc-by-nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
)


class SuffixAutomaton:
    """Of several sequences of numbers: state 0 is the empty run; ``places`` of a state are the
    (sequence, end) at which its runs occur."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        self.ends: list[int] = []
        for number, sequence in enumerate(sequences):
            last = 0
            for at, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.places[last].add((number, at + 1))
            self.ends.append(last)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]

    def _add(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.places.append(set())
        return len(self.link) - 1

    def _split(self, parent: int, symbol: int) -> int:
        """The state of the runs of ``parent`` followed by ``symbol``, cloned if longer runs share it."""
        child = self.next[parent][symbol]
        if self.length[child] == self.length[parent] + 1:
            return child
        clone = self._add(self.length[parent] + 1, dict(self.next[child]), self.link[child])
        self.link[child] = clone
        while parent >= 0 and self.next[parent].get(symbol) == child:
            self.next[parent][symbol] = clone
            parent = self.link[parent]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol)
        made = self._add(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, symbol)
        return made


class Scanner:
    def __init__(self):
        texts = [(label, words(p)) for p, label in PHRASES] + [(label, words(t)) for label, t in TEMPLATES]
        self.labels = [label for label, _ in texts]
        self.vocabulary: dict[bytes, int] = {}
        self.sequences = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found] for _, found in texts]
        self.automaton = a = SuffixAutomaton(self.sequences)
        self.phrase_at: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(a.link)):
            held, up = [], state
            while up > 0:
                held += [(len(self.sequences[k]), k) for k in range(len(PHRASES)) if a.ends[k] == up]
                up = a.link[up]
            self.phrase_at.append(tuple(held))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, str]], dict[str, float], list[tuple[str, int, int]]]:
        """Words; base places (start word, label); covered share by label; covered spans (label, start, end)."""
        found = words(text)
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        base: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        nexts, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        for start, end in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2))[:, 0] > 1].tolist():
            state = run = 0
            for at, symbol in enumerate(ids[start:end].tolist(), start):
                kept = state, run
                while state and symbol not in nexts[state]:
                    state = link[state]
                    run = length[state]
                if symbol in nexts[state]:
                    state, run = nexts[state][symbol], run + 1
                if kept[1] >= MIN_RUN and run != kept[1] + 1:
                    self._match(matches, *kept, at)
                for size, k in self.phrase_at[state]:
                    if size <= run:
                        base.append((at + 1 - size, self.labels[k]))
            if run >= MIN_RUN:
                self._match(matches, state, run, end)
        shares, spans = self._chain(matches)
        return len(found), base, shares, spans

    def _match(self, matches: dict, state: int, run: int, end: int) -> None:
        """A maximal run that ends before word ``end``, at each of its places in each template."""
        for k, stop in self.automaton.places[state]:
            matches.setdefault(k, []).append((end, stop, run))

    def _chain(self, matches: dict) -> tuple[dict[str, float], list[tuple[str, int, int]]]:
        shares: dict[str, float] = {}
        spans: list[tuple[str, int, int]] = []
        for k, found in matches.items():
            found.sort()
            total, best = len(self.sequences[k]), []  # (words covered, first word) of the best chain to each match
            for i, (end, stop, run) in enumerate(found):
                top = (run, end - run)
                j = i - 1
                while j >= 0 and end - run - found[j][0] <= GAP:
                    before, its_stop, _ = found[j]
                    if its_stop < stop and before < end:
                        new = min(run, stop - its_stop, end - before)
                        if best[j][0] + new > top[0]:
                            top = (best[j][0] + new, best[j][1])
                    j -= 1
                best.append(top)
            cover = [(c, start, found[i][0]) for i, (c, start) in enumerate(best)]
            share = min(1.0, max(c for c, _, _ in cover) / total)
            shares[self.labels[k]] = max(share, shares.get(self.labels[k], 0.0))
            if share >= COVERED:
                spans += [(self.labels[k], start, end) for c, start, end in cover if c >= COVERED * total]
        return shares, spans


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner()


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    the covered template spans (label, start word, end word).

    ``score`` is the largest covered share of a template; a base phrase is covered whole, so it gives 1.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), span]

    def one(text: str | None) -> tuple:
        n, base, shares, spans = _scanner().scan(text)
        starts = [s for s, _ in base]
        labels = {label for _, label in base}
        added = {label for label, share in shares.items() if share >= COVERED}
        score = 1.0 if base else max(shares.values(), default=0.0)
        shown = [{"label": a, "start": b, "end": c} for a, b, c in spans]
        return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | added)), score, shown

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*map(one, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(rows, types))], [id_column, *columns])

    schema = f"`{id_column}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint>>"
    return arrow_map(docs.select(id_column, text_column), work, schema, text_column)
