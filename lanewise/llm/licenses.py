"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates are sequences of lower-cased words (runs of letters and digits). All ``K``-word hashes
of the templates form an inverted index, hash -> (template, position); it depends on the templates only and
goes to every task. A text keeps the least hash of each ``WINDOW`` of them (winnowing), so a run of
K + WINDOW - 1 words that it has in common with a template always leaves a fingerprint. Each fingerprint in
the index gives a diagonal; the template is aligned with the words around it, within ``BAND`` words of that
diagonal, and reported where at least ``coverage`` of its words match in order. Diagonals whose words include
too few of the template's are passed over, equal ones are aligned once, and all of a text and template are
aligned together, a word of the template at a time. Fingerprints inside a reported span of the same template
start no new alignment; spans of different templates may overlap, and each is reported.

Rows don't meet: there is no shuffle, and a text takes time in proportion to its length. Null or empty text, or
an empty table: no rows. Repeated rows: results for each. Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lanewise.llm.common import text_or_empty

K, WINDOW, BAND, COVERAGE = 3, 3, 8, 0.8
#: Diagonals that are aligned together.
TOGETHER = 1024

# Notices of public licenses.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-line": "Released under the MIT License",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}

_WORD = re.compile(r"[^\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Words that a worker keeps the hashes of; a full table is emptied.
KNOWN_WORDS = 1 << 17


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value
        return value


def _grams(h: np.ndarray) -> np.ndarray:
    out = np.zeros(max(0, len(h) - K + 1), np.uint64)
    for i in range(K):
        out = out * _MULTIPLIER + h[i : len(out) + i]
    return (out ^ (out >> np.uint64(29))) * _MULTIPLIER


def winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the least hash of every window (the last one among equals); all where there is less than a window."""
    if len(grams) <= WINDOW:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))


#: Words of a template (and two bands) that fit the numbers that an alignment is kept in.
MOST_WORDS = 1 << 14


def aligned(template: np.ndarray, words: np.ndarray, shifts: np.ndarray, band: int, low: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each shift: most words of the template that match in order, and where the first stands in ``words`` and the last one ends.

    Word j of the template may stand at j + shift - band to j + shift + band, not before ``low``. Of alignments with
    as many matches the shortest counts, and of these the first. Without a match: 0, 0, 0.
    """
    if len(template) + 2 * band >= MOST_WORDS:
        raise ValueError("a template is too long")
    width, bits = 2 * band + 1, 14
    # a cell holds matches and, below them, where the first one stands; places count from shift - band
    above, best = np.zeros((len(shifts), width + 1), np.int64), np.zeros(len(shifts), np.int64)
    begin = shifts - band
    for j, t in enumerate(template):
        local = j + np.arange(width)
        at = begin[:, None] + local
        same = (at >= low) & (at < len(words))
        same &= words[np.clip(at, 0, len(words) - 1)] == t
        before = above[:, :width]
        taken = np.where(same, np.where(before > 0, before + (1 << bits), (1 << bits) + local), 0)
        matches, start = taken >> bits, taken & (MOST_WORDS - 1)
        key = ((matches << bits | MOST_WORDS - 1 - (local - start)) << bits | MOST_WORDS - 1 - start) << bits | local
        best = np.maximum(best, np.where(same, key, 0).max(axis=1))
        # a word of the text, or of the template, is passed over
        above[:, :width] = np.maximum.accumulate(np.maximum(above[:, 1:], taken), axis=1)
    some, part = best > 0, MOST_WORDS - 1
    start = begin + part - (best >> bits & part)
    return best >> 3 * bits, np.where(some, start, 0), np.where(some, begin + (best & part) + 1, 0)


class Index:
    def __init__(self, templates: dict[str, str]):
        hashes = _Hashes()
        self.names = list(templates)
        self.words = [np.array([hashes[w] for w in _WORD.findall(t)], np.uint64) for t in templates.values()]
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for j, g in enumerate(_grams(words).tolist()):
                self.places.setdefault(g, []).append((t, j))
        self.grams = np.array(sorted(self.places), np.uint64)

    def scan(self, text: str, hashes: _Hashes, coverage: float, band: int) -> list[tuple[str, int, int, float, int, int]]:
        """(name, matched, words, coverage, start, end) of each template found."""
        h = np.fromiter(map(hashes.__getitem__, _WORD.findall(text)), np.uint64)
        grams = _grams(h)
        at = winnowed(grams)
        found = grams[at]
        at = at[self.grams[np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)] == found] if len(self.grams) else at[:0]
        if not len(at):
            return []
        by_template: dict[int, list[tuple[int, int]]] = {}
        for i in at.tolist():
            for t, j in self.places[int(grams[i])]:
                by_template.setdefault(t, []).append((i, i - j))
        spans, out = None, []
        for t, hits in by_template.items():
            for n, start, end in self._reported(t, hits, h, coverage, band):
                spans = spans or [m.span() for m in _WORD.finditer(text)]
                out.append((self.names[t], n, len(self.words[t]), n / len(self.words[t]), spans[start][0], spans[end - 1][1]))
        return out

    def _reported(self, t: int, hits: list[tuple[int, int]], h: np.ndarray, coverage: float, band: int):
        """(matched, first word, end) of a template's alignments; hits: (place, diagonal) of its fingerprints, by place."""
        template = self.words[t]
        # how many of the words around a diagonal occur in the template at all
        known = np.concatenate([[0], np.cumsum(np.isin(h, template))])
        shifts = np.unique(np.array([d for _, d in hits]))
        first, last = np.clip(shifts - band, 0, len(h)), np.clip(shifts + len(template) + band, 0, len(h))
        shifts = shifts[known[last] - known[first] >= coverage * len(template)]
        scores = {}
        for part in range(0, len(shifts), TOGETHER):
            own = shifts[part : part + TOGETHER]
            scores |= dict(zip(own.tolist(), zip(*(x.tolist() for x in aligned(template, h, own, band)), strict=True), strict=True))
        done = 0
        for i, shift in hits:
            if shift not in scores or i < done:
                continue
            n, start, end = scores[shift]
            if n >= coverage * len(template) and start < done:  # it may do without the words that were reported
                n, start, end = (int(x[0]) for x in aligned(template, h, np.array([shift]), band, done))
            if n >= coverage * len(template) and end > done:
                done = end
                yield n, start, end


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND) -> DataFrame:
    """doc_id, license, matched, words, coverage, start, end: a row for each template found in each row of ``docs`` (doc_id, text)."""
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def work(batches):
        hashes = _Hashes()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for row in index.value.scan(text, hashes, coverage, band):
                    at.append(i)
                    rows.append(row)
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "license", "matched", "words", "coverage", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_or_empty(docs).alias("text"))
    return texts.mapInArrow(work, f"doc_id {kind}, license string, matched int, words int, coverage double, start long, end long")
