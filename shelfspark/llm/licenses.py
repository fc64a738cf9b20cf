"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports coverage and spans.

Templates and texts become words (runs of letters and digits, lower case). Hashes of three words in a row are winnowed
(the least of each two neighbours), so any four equal words in a row share a fingerprint. An inverted index from
fingerprint to template and place turns a text's fingerprints into candidate diagonals; around each, the template is
aligned with the text within a band, and the matched words give coverage and the span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import doc_chunks, text_buffer

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_DISCLAIMER,
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
}


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, e = tv.word_bounds(buf, offs, tv.ALNUM)
    return s, e, tv.span_hashes(buf, s, e, fold=True)


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the gram, hash) of the winnowed grams of texts whose words begin at ``first`` (with the end)."""
    h = tv.window_hashes(words, GRAM)
    n = np.diff(first)
    left = np.repeat(first[1:], n)[: len(h)] - np.arange(len(h))  # words to the end of the text
    ok = left >= GRAM
    last = left == GRAM
    keep = np.zeros(len(h), bool)
    pair = np.flatnonzero(ok & ~last)
    keep[np.where(h[pair] <= h[pair + 1], pair, pair + 1)] = True
    # a text of three words has one gram and no neighbour
    begin = np.zeros(len(h) + 1, bool)
    begin[np.minimum(first[:-1], len(h))] = True
    keep |= ok & last & begin[:-1]
    at = np.flatnonzero(keep & ok)
    return at, h[at]


class Templates:
    """The words of all templates and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        prints, template, place = [], [], []
        for k, name in enumerate(self.names):
            raw = np.frombuffer(templates[name].encode(), np.uint8)
            _, _, w = _words(raw, np.array([0, len(raw)]))
            self.words.append(w)
            at, h = winnow(w, np.array([0, len(w)]))
            prints.append(h)
            template.append(np.full(len(at), k))
            place.append(at)
        h = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.prints, self.template, self.place = h[order], np.concatenate(template)[order], np.concatenate(place)[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.prints & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, posting) for each fingerprint that the index has."""
        some = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.prints, h[some], "left"), np.searchsorted(self.prints, h[some], "right")
        n = hi - lo
        return np.repeat(some, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Banded alignment of a whole template within a text: (equal words, first matched text word, end after the last).

    Template word i may meet text words shift + i - band to shift + i + band. The equal words are as many as an
    alignment in the band can have; of alignments with as many, the shortest stretch of text is taken, then the first.
    """
    m, width = len(template), 2 * band + 1
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * (width + 1)  # equal, -length, start, for the text up to column c
    for i in range(m):
        base, row = shift + i - band, [(0, 0, -1)] * (width + 1)
        for c in range(width):
            j = base + c
            up, side = best[c + 1], row[c - 1] if c else (0, 0, -1)
            now = max(up, side)
            if 0 <= j < len(text) and text[j] == template[i]:
                e, _, s = best[c]
                s = j if s < 0 else s
                now = max(now, (e + 1, s - j, s))
            row[c] = now
        row[width] = row[width - 1]
        best = row
    e, length, s = max(best)
    return (e, s, s - length + 1) if e else (0, -1, -1)


def _fullest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping matches the fullest, in order."""
    taken: list[tuple[int, int, int]] = []
    for e, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
        if all(b <= x or a >= y for _, x, y in taken):
            taken.append((e, a, b))
    return sorted(taken, key=lambda x: x[1])


def _matches(template: np.ndarray, words: np.ndarray, at: np.ndarray, d: np.ndarray, lo: int, hi: int, coverage: float, level: int = 2) -> list[tuple[int, int, int]]:
    """(equal words, first word, end word) of the copies of one template within words lo to hi, given its hits and their diagonals.

    Diagonals form groups of three widths: of one copy, with small changes, and with insertions as long as the template.
    A wider group is aligned as a whole unless it has several matches of narrower ones; what the matches leave of it is
    searched again.
    """
    m = len(template)
    gaps = (min(BAND, (m - 1) // 2), BAND, max(BAND, m))
    order = np.argsort(d, kind="stable")
    at, d, found = at[order], d[order], []
    for g in np.split(np.arange(len(d)), np.flatnonzero(np.diff(d) > gaps[level]) + 1):
        if not len(g):
            continue
        best = _matches(template, words, at[g], d[g], lo, hi, coverage, level - 1) if level else []
        joined = not level or gaps[level] > gaps[level - 1] and (level == 1 or bool((np.diff(d[g]) > BAND).any()))
        if joined and len(best) < 2:
            pad, wide = min(BAND, gaps[level]), int(d[g[-1]] - d[g[0]] + 1) // 2
            e, a, b = align(template, words[lo:hi], int((d[g[0]] + d[g[-1]]) // 2) - lo, pad + wide)
            if e >= coverage * m and (not best or e > best[0][0]):
                best = [(e, a + lo, b + lo)]
        found += best
        if best and joined:
            edges = [lo, *(x for _, a, b in best for x in (a, b)), hi]
            for x, y in zip(edges[::2], edges[1::2], strict=True):
                rest = g[(at[g] >= x) & (at[g] + GRAM <= y)]
                if len(rest):
                    found += _matches(template, words, at[rest], d[rest], x, y, coverage, level)
    return _fullest(found)


def scan_text(t: Templates, words: np.ndarray, at: np.ndarray, posting: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, equal words, first word, end word) of the matches in one text, given its fingerprint hits."""
    out = []
    diagonal = at - t.place[posting]
    kind = t.template[posting]
    for k in np.unique(kind).tolist():
        out += [(k, e, a, b) for e, a, b in _matches(t.words[k], words, at[kind == k], diagonal[kind == k], 0, len(words), coverage)]
    return out


@cache
def _templates(items: tuple[tuple[str, str], ...]) -> Templates:
    return Templates(dict(items))


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each match of a template in a text: doc_id, license, coverage, matched_words, start_char, end_char, excerpt.

    ``coverage`` is the share of the template's words that the alignment matches (at least the parameter); the span runs
    from the first to after the last matched word, in characters. A template may match several times; a text several
    templates (a short notice and the long header that begins with it, say). Null, empty and wordless texts match
    nothing; repeated rows match alike; whole texts are scanned, and every fingerprint hit is aligned. An empty table
    gives none; other columns are ignored. Templates of fewer than three words are never found.
    """
    items = tuple(sorted((TEMPLATES if templates is None else templates).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _templates(items)
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            rows = []
            for i, j in doc_chunks(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                s, e, w = _words(part, o)
                first = np.searchsorted(s, o)
                at, h = winnow(w, first)
                hit, posting = t.hits(h)
                at = at[hit]
                doc = np.searchsorted(first, at, "right") - 1
                cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
                for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(doc)][: len(cut)], strict=True):
                    k = int(doc[x])
                    base = int(first[k])
                    for lic, equal, a, z in scan_text(t, w[base : first[k + 1]], at[x:y] - base, posting[x:y], coverage):
                        lo, hi = int(s[base + a]), int(e[base + z - 1])
                        text = part[lo:hi].tobytes().decode("utf-8", "replace")
                        start = len(part[o[k] : lo].tobytes().decode("utf-8", "replace"))
                        rows.append((ids[i + k], t.names[lic], round(equal / len(t.words[lic]), 6), equal, start, start + len(text), text))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                names = ["doc_id", "license", "coverage", "matched_words", "start_char", "end_char", "excerpt"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, license string, coverage double, matched_words int, start_char long, end_char long, excerpt string"
    )
