"""License scans: winnowed n-grams and words pick candidates, banded alignment reports coverage and spans.

Templates are cut into words without case and outer punctuation. Of every `w` word n-grams of a template that follow each
other the one with the smallest hash is a fingerprint, and the fingerprints go into an inverted index (hash -> template,
place). A text's n-grams are looked up there; every diagonal (text place less template place) of a hit is a candidate,
whose words are aligned to the template's within a band. All candidates of a template in a text are aligned together, a
template word a step; those that can't reach the coverage any more leave. Matched template words over all template words
is the coverage.

The guarantee: any w + n - 1 template words that follow each other in the text share a fingerprint with it. w is the largest
with which a match cannot miss that: a template of m words of which at most c may be changed or missing keeps a run of
(m - c) / (c + 1), rounded up (`kept_run`), 4 for a coverage of 0.8. Templates too short for that, or of fewer than `SHORT`
words, are indexed by single words, as many of their longest as a match can't miss all of; there every diagonal of the band is aligned, so that
every match is found. Only words inserted into every run hide a match of a longer template.

Of a template's matches the one with most words stays first, then those in what it leaves free.

Defined results: null and empty texts and texts without hits give no rows; every occurrence is a row, so repeated
licenses and repeated rows are reported each time; of matches of templates that overlap, the one with more matched
words stays; spans are code points of the text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from importlib.resources import files
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import text_slices, texts_of
from .words import gram_hashes, split_words

GRAM, SHORT, BAND = 3, 15, 8
MIN_COVERAGE = 0.8
#: From this length on counting a window's words costs less than aligning it.
LONG = 64
_EDGE = "!\"#$%&'()*,-./:;<=>?@[\\]^_`{|}~"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: The wording of public license notices.
TEMPLATES = {
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT": "Released under the MIT License.",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-license": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-license": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-license": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-license": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-license": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-license": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense-license": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}


#: Whole licenses, as they are published.
BODIES = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
ALL_TEMPLATES = {**TEMPLATES, **BODIES}


def _norm(word: str) -> str:
    return word.strip(_EDGE).lower()


def kept_run(n: int, min_coverage: float = MIN_COVERAGE) -> int:
    """Words that follow each other unchanged at least in a match of n words of which some are changed or missing."""
    lost = n - math.ceil(min_coverage * n)
    return -(-(n - lost) // (lost + 1))


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash, the last of equal ones, of every `window` hashes that follow each other; of fewer, of all."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))


class Index:
    """Templates' words and the inverted indexes of their fingerprints and, for short ones, of single words."""

    def __init__(self, templates: dict[str, str] = ALL_TEMPLATES, min_coverage: float = MIN_COVERAGE) -> None:
        self.names = sorted(templates)
        self.words = [[w for x in templates[n].split() if (w := _norm(x))] for n in self.names]
        self.vocabulary = sorted({w for words in self.words for w in words})
        #: Each template as numbers of its words (from 1 on; 0 is any other word), and which numbers it holds.
        self.codes = [self.code(words) for words in self.words]
        self.holds = [np.isin(np.arange(len(self.vocabulary) + 1), codes) for codes in self.codes]
        self.windows = [kept_run(len(words), min_coverage) - GRAM + 1 for words in self.words]
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.word_at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            if self.is_short(t):
                spare = len(words) - math.ceil(min_coverage * len(words))
                for p in sorted(range(len(words)), key=lambda p: (words[p].isalpha(), -len(words[p]), p))[: spare + 1]:
                    self.word_at[int(self.codes[t][p])].append((t, p))
                continue
            grams, _ = gram_hashes(self.codes[t], np.array([0, len(words)]), GRAM)
            for p in winnow(grams, self.windows[t]).tolist():
                self.at[int(grams[p])].append((t, p))
        self.keys, self.word_keys = (np.array(sorted(x), np.uint64) for x in (self.at, self.word_at))

    def is_short(self, t: int) -> bool:
        """Whether the template is short, or a match of it may keep no run that a fingerprint is sure to come from."""
        return len(self.words[t]) < SHORT or self.windows[t] < 2

    def code(self, words: list[str] | pa.Array) -> np.ndarray:
        """Numbers of normalised words."""
        found = pc.index_in(pa.array(words, pa.string()), value_set=pa.array(self.vocabulary, pa.string()))
        return (pc.fill_null(found, -1).to_numpy(zero_copy_only=False) + 1).astype(np.uint64)

    def hits(self, grams: np.ndarray, single: bool = False) -> np.ndarray:
        """Places of grams, or single words, that the index holds."""
        keys = self.word_keys if single else self.keys
        at = np.minimum(np.searchsorted(keys, grams), max(0, len(keys) - 1))
        return np.flatnonzero(keys[at] == grams) if len(keys) and len(grams) else np.zeros(0, np.int64)


#: A state of an alignment in one number: words matched, first text place and how early the last one is, both within the window.
_FIRST, _PAST = 1 << 16, (1 << 16) - 1


def align(template: np.ndarray, text: np.ndarray, shifts: np.ndarray, least: float, low: np.ndarray | int = 0, high: np.ndarray | None = None, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which shifts match at least `least` words, and for those: most words matched in order, template[i] against
    text[i + shift + d] with |d| <= band, from low to below high only; first and past-last text place.

    Of equal matches the shortest wins, then the earliest. Words are numbers; all shifts go a template word a step."""
    n, width = len(template), 2 * band + 1
    low, high = (np.broadcast_to(np.asarray(x, np.int64), len(shifts)) for x in (low, len(text) if high is None else high))
    state = np.zeros((len(shifts), width), np.int64)
    alive = np.arange(len(shifts))
    lanes = np.arange(width)
    for i in range(n):
        best = np.maximum.accumulate(state, axis=1)
        at = (shifts[alive] + (i - band))[:, None] + lanes
        hit = (at >= low[alive][:, None]) & (at < high[alive][:, None])
        hit &= text[np.where(hit, at, 0)] == template[i]
        place = i + lanes  # within the window that begins at shift - band
        more = np.where(best > 0, (best | _PAST) - (place + 1), ((place[None, :] << 16) | _PAST) - (place + 1)) + (1 << 32)
        state = np.maximum(np.concatenate([best[:, 1:], best[:, -1:]], axis=1), np.where(hit, more, 0))
        if i % 8 == 7:
            stay = (state.max(1) >> 32) + (n - 1 - i) >= least
            if not stay.all():
                alive, state = alive[stay], state[stay]
                if not len(alive):
                    break
    matched, first, past = state >> 32, state >> 16 & _PAST, _PAST - (state & _PAST)
    most = matched.max(1, initial=0)
    ok = (most >= least) & (most > 0)
    alive, matched, first, past, most = alive[ok], matched[ok], first[ok], past[ok], most[ok]
    # the shortest of the best, then the earliest
    cost = np.where(matched == most[:, None], (past - first) * _FIRST + first, np.iinfo(np.int64).max)
    lane, row = cost.argmin(1) if len(cost) else np.zeros(0, np.int64), np.arange(len(alive))
    begin = shifts[alive] - band
    return alive, most, begin + first[row, lane], begin + past[row, lane]


def template_matches(template: np.ndarray, holds: np.ndarray, words: np.ndarray, shifts: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(matched, first, past last) of a template's matches: the best first, then those in what it leaves free."""
    n, found, taken = len(template), [], np.zeros(len(words) + 1, bool)
    low, high = np.maximum(0, shifts - BAND), np.minimum(len(words), shifts + n + BAND)
    # where too few of the template's words stand, no alignment helps
    there = np.concatenate([[0], np.cumsum(holds[words])])
    may = there[high] - there[low] >= least
    shifts, low, high = shifts[may], low[may], high[may]
    if n >= LONG and len(shifts):
        # no more words can match in order than the window has of each
        need = np.bincount(template.astype(np.int64), minlength=len(holds))
        may = np.array([np.minimum(np.bincount(words[a:z].astype(np.int64), minlength=len(holds)), need).sum() >= least for a, z in zip(low.tolist(), high.tolist(), strict=True)])
        shifts, low, high = shifts[may], low[may], high[may]
    if not len(shifts):
        return found
    which, matched, first, past = align(template, words, shifts, least, low, high)
    heap = list(zip((-matched).tolist(), (past - first).tolist(), first.tolist(), past.tolist(), shifts[which].tolist(), low[which].tolist(), high[which].tolist(), strict=True))
    heapq.heapify(heap)
    while heap:
        lost, _, f, p, shift, a, z = heapq.heappop(heap)
        if not taken[f:p].any():
            found.append((-lost, f, p))
            taken[f:p] = True
        edges = [a - 1, *(np.flatnonzero(taken[a:z]) + a).tolist(), z]
        for e, g in pairwise(edges):
            if g - e - 1 >= least and there[g] - there[e + 1] >= least:
                _, m, start, stop = align(template, words, np.array([shift]), least, e + 1, g)
                if len(m):
                    heapq.heappush(heap, (-int(m[0]), int(stop[0] - start[0]), int(start[0]), int(stop[0]), shift, e + 1, g))
    return found


def scan_words(words: np.ndarray, hits: list[tuple[int, int, int]], index: Index, min_coverage: float = MIN_COVERAGE) -> list[tuple[int, int, int, float]]:
    """(first word, past last word, template, coverage) of each match; words by their numbers; hits: (place, template, place in template)."""
    places = defaultdict(set)
    for place, t, p in hits:
        places[t].add(place - p)
    found = []
    for t, own in places.items():
        template = index.codes[t]
        shifts = np.array(sorted(own), np.int64)
        if index.is_short(t):
            shifts = np.unique((shifts[:, None] + np.arange(-BAND, BAND + 1)).ravel())
        found += [(*m, t) for m in template_matches(template, index.holds[t], words, shifts, min_coverage * len(template))]
    # matches of several templates: most words first, then the shorter template
    out: list[tuple[int, int, int, float]] = []
    taken = np.zeros(len(words) + 1, bool)
    for matched, first, end, t in sorted(found, key=lambda x: (-x[0], len(index.words[x[3]]), x[1], x[3])):
        if not taken[first:end].any():
            taken[first:end] = True
            out.append((first, end, t, matched / len(index.words[t])))
    return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = ALL_TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start and end (code points) and the matched text, of every occurrence."""
    index = Index(templates, min_coverage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            texts = texts_of(part)
            words, ends = split_words(texts, lower=False)
            coded = words.dictionary_encode()
            normal = pc.utf8_lower(pc.utf8_trim(coded.dictionary.cast(pa.string()), characters=_EDGE))
            table, full = index.code(normal), pc.greater(pc.binary_length(normal), 0).to_numpy(zero_copy_only=False)
            which = coded.indices.to_numpy(zero_copy_only=False)
            seen = np.flatnonzero(full[which]) if len(which) else np.zeros(0, np.int64)
            own = np.searchsorted(seen, ends)  # words of punctuation alone don't count
            codes = table[which[seen]] if len(which) else np.zeros(0, np.uint64)
            grams, starts = gram_hashes(codes, own, GRAM)
            hits = index.hits(grams)
            single = index.hits(codes, single=True)
            rows = []
            n = np.arange(part.num_rows + 1)
            at_hit, at_single = np.searchsorted(hits, starts[n]), np.searchsorted(single, own[n])
            for d in np.flatnonzero((np.diff(at_hit) > 0) | (np.diff(at_single) > 0)).tolist():
                a, z = own[d], own[d + 1]
                mine = [(int(h - starts[d]), t, p) for h in hits[at_hit[d] : at_hit[d + 1]].tolist() for t, p in index.at[int(grams[h])]]
                mine += [(int(h - a), t, p) for h in single[at_single[d] : at_single[d + 1]].tolist() for t, p in index.word_at[int(codes[h])]]
                matches = scan_words(codes[a:z], mine, index, min_coverage)
                if matches:
                    text = texts[d].as_py()
                    spans = [m.span() for m in _WORD.finditer(text)]
                    at = (seen[a:z] - ends[d]).tolist()
                    for first, end, t, coverage in matches:
                        start, stop = spans[at[first]][0], spans[at[end - 1]][1]
                        rows.append((part.column("doc_id")[d].as_py(), index.names[t], coverage, start, stop, text[start:stop]))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "coverage", "start", "end", "matched"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, start long, end long, matched string")
