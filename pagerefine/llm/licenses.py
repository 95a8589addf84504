"""License scans: an inverted index of winnowed template fingerprints picks candidates, banded alignment reports spans.

Templates' word k-grams are thinned to the minima of windows; the index maps each to its places in templates. A
document's k-grams are looked up all, so any stretch that holds a fingerprint is a candidate. Hits of a template on
nearby diagonals, and near each other, are aligned once with the template's words around them, in a band; alignments
that follow each other in both are one match, whose words count together.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary, map_arrow, steps
from .jaccard_join import windows
from .substring_dedup import minimizers
from .words import hashed_words, separating

# Notices and texts of public licenses; longer ones are in the folder license_texts, one file each.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        'of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
        "THIS SOFTWARE."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "
        '"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
        "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS "
        'SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
        "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
        "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means."
    ),
    "apache-2.0-header": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
} | {
    f"{short}-header": (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {long} as published by "
        f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        f"PURPOSE. See the GNU {long} for more details."
    )
    for short, long, version in (
        ("gpl-2.0", "General Public License", 2),
        ("gpl-3.0", "General Public License", 3),
        ("lgpl-3.0", "Lesser General Public License", 3),
        ("agpl-3.0", "Affero General Public License", 3),
    )
}
#: Bytes that separate words: all of ASCII but letters and digits.
SEPARATES = separating(bytes(c for c in range(128) if not chr(c).isalnum()))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def known_templates() -> tuple[tuple[str, str], ...]:
    """Names and texts of all templates that come with the package."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return (*TEMPLATES.items(), *((f.stem, f.read_text("utf-8")) for f in files))


def license_words(text: bytes) -> np.ndarray:
    """Hashes of the runs of letters and digits, A-Z lower-cased; all bytes beyond ASCII count as letters."""
    return next(hashed_words(pa.array([text], pa.binary()), SEPARATES))


@dataclass(frozen=True)
class Part:
    """An alignment: matched words, places of words in the document and in the template, ends exclusive."""

    start: int
    end: int
    first: int
    last: int
    matched: int


@dataclass(frozen=True)
class LicenseIndex:
    """k: words of a fingerprint; window: k-grams of which one at least is a fingerprint; band: words by which an
    alignment may leave its diagonals; reach: words from one hit to the next of one alignment; inserted: words that
    may stand between two alignments of one match; hits: fingerprints of an alignment of a template that has more than
    long words; coverage: the least share of a template's words that must match."""

    templates: tuple[tuple[str, str], ...] = field(default_factory=known_templates)
    k: int = 3
    window: int = 4
    band: int = 8
    reach: int = 32
    inserted: int = 64
    hits: int = 4
    long: int = 60
    coverage: float = 0.8
    words: list = field(init=False, repr=False, compare=False)
    keys: np.ndarray = field(init=False, repr=False, compare=False)
    places: dict = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        words = [license_words(t.encode()) for _, t in self.templates]
        places = defaultdict(list)
        for i, w in enumerate(words):
            grams = windows(w, min(self.k, len(w)))
            for j in minimizers(grams, self.window).tolist():
                places[int(grams[j])].append((i, j))
        object.__setattr__(self, "words", [w.tolist() for w in words])
        object.__setattr__(self, "keys", np.array(sorted(places), np.uint64))
        object.__setattr__(self, "places", dict(places))

    def candidates(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """template and its hits (place in the document, place in it) that lie near each other on nearby diagonals.

        Diagonals of one candidate are at most a band apart, so a notice that is repeated makes one for each place.
        """
        if len(words) < self.k or not len(self.keys):
            return
        grams = windows(words, self.k)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        found = [(t, i - j, i, j) for i in np.flatnonzero(self.keys[at] == grams).tolist() for t, j in self.places[int(grams[i])]]
        found.sort()
        own: list[tuple[int, int]] = []
        template, low = -1, 0
        for t, d, i, j in [*found, (-1, 0, 0, 0)]:
            if t != template or d - low > self.band:
                own.sort()
                start = 0
                for n in range(1, len(own) + 1):
                    if n == len(own) or own[n][0] - own[n - 1][0] > self.reach:
                        if n - start >= (self.hits if len(self.words[template]) > self.long else 1):
                            yield template, own[start:n]
                        start = n
                own, template, low = [], t, d
            own.append((i, j))

    def align(self, words: list, template: int, low: int, high: int, first: int, last: int) -> Part | None:
        """The best local alignment of the template's words first to last with words, in the band from diagonal low
        to high. A match earns one, a substitution or a skipped word costs one."""
        own = self.words[template]
        best = (0, 0, 0, 0, 0, 0)
        before: dict[int, tuple[int, int, int, int]] = {}
        for j in range(first, last):
            row: dict[int, tuple[int, int, int, int]] = {}
            t = own[j]
            for i in range(max(0, low + j), min(len(words), high + j + 1)):
                score, matched, start, top = before.get(i - 1, (0, 0, i, j))
                cell = (score + 1, matched + 1, start, top) if words[i] == t else (score - 1, matched, start, top)
                for score, matched, start, top in (before.get(i, (0, 0, i, j)), row.get(i - 1, (0, 0, i, j))):
                    if score - 1 > cell[0]:
                        cell = (score - 1, matched, start, top)
                if cell[0] > 0:
                    row[i] = cell
                    if cell[:2] > best[:2]:
                        best = (*cell, i + 1, j + 1)
            before = row
        return Part(best[2], best[4], best[3], best[5], best[1]) if best[1] else None

    def parts(self, words: np.ndarray) -> dict[int, list[Part]]:
        """Alignments of each template by start; of two that overlap by half or more, the better one."""
        found = defaultdict(set)
        for template, hits in self.candidates(words):
            size = len(self.words[template])
            diagonals, js = [i - j for i, j in hits], [j for _, j in hits]
            low, high = min(diagonals) - self.band, max(diagonals) + self.band
            first, last = max(0, min(js) - self.reach), min(size, max(js) + self.k + self.reach)
            at = max(0, first + low)
            rest = words[at : max(at, last + high + 1)].tolist()
            while part := self.align(rest, template, low - at, high - at, first, last):
                found[template].add(Part(part.start + at, part.end + at, part.first, part.last, part.matched))
                if part.matched < self.coverage * size:
                    break
                # The template may repeat within the band: what is matched is taken out, and the rest looked at again.
                rest[part.start : part.end] = [None] * (part.end - part.start)
        out = {}
        for template, own in found.items():
            kept: list[Part] = []
            for p in sorted(own, key=lambda p: (p.start, p.end, -p.matched, p.first)):
                if kept and 2 * (min(kept[-1].end, p.end) - p.start) >= min(kept[-1].end - kept[-1].start, p.end - p.start):
                    if p.matched > kept[-1].matched:
                        kept[-1] = p
                else:
                    kept.append(p)
            out[template] = kept
        return out

    def joined(self, template: int, parts: list[Part]) -> Iterator[tuple[int, int, int, float, str]]:
        """start, end, matched words, coverage and name of what parts cover enough of, alone or in a row.

        A part follows another one in both texts with few words between; what both hold counts once. The best row
        comes first, and a part is in one row.
        """
        size = len(self.words[template])
        rest = []
        for p in parts:
            if p.matched >= self.coverage * size:
                yield p.start, p.end, p.matched, p.matched / size, self.templates[template][0]
            else:
                rest.append(p)
        longest = max((p.end - p.start for p in rest), default=0)
        left_out = max(self.inserted, round((1 - self.coverage) * size))
        score, before = [p.matched for p in rest], [-1] * len(rest)
        for n, p in enumerate(rest):
            m = n - 1
            while m >= 0 and p.start - rest[m].start <= longest + self.inserted:
                q = rest[m]
                shared = max(0, q.end - p.start, q.last - p.first)
                follows = q.start < p.start and q.end < p.end and q.first < p.first and q.last < p.last
                near = p.start - q.end <= self.inserted and p.first - q.last <= left_out and 2 * shared <= p.end - p.start
                if follows and near and score[m] + p.matched - shared > score[n]:
                    score[n], before[n] = score[m] + p.matched - shared, m
                m -= 1
        used = [False] * len(rest)
        for n in sorted(range(len(rest)), key=lambda n: (-score[n], n)):
            if score[n] < self.coverage * size:
                break
            end, first, whole = n, n, True
            while n >= 0 and whole:
                whole, used[n], first, n = not used[n], True, n, before[n]
            if whole:
                yield rest[first].start, rest[end].end, score[end], score[end] / size, self.templates[template][0]

    def find(self, words: np.ndarray, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """license, coverage, matched words, and start and end in code points, by start; a match inside another one
        with more matched words, or as many and a higher coverage, is left out."""
        found = sorted({f for template, parts in self.parts(words).items() for f in self.joined(template, parts)})
        if not found:
            return []
        longest, starts, kept = max(f[1] - f[0] for f in found), [f[0] for f in found], []
        rank = lambda f: (f[2], f[3], -f[0], f[4])
        for f in found:
            n, inside = bisect_left(starts, f[1] - longest), False
            while not inside and n < len(found) and found[n][0] <= f[0]:
                inside = f[1] <= found[n][1] and rank(found[n]) > rank(f)
                n += 1
            if not inside:
                kept.append(f)
        spans = [m.span() for m in _WORD.finditer(text)]
        points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
        return [(name, share, matched, int(points[spans[start][0]]), int(points[spans[end - 1][1]])) for start, end, matched, share, name in kept]


def scan_licenses(docs: DataFrame, index: LicenseIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage, n_matched, start, end (code points, end exclusive).

    Whole texts are scanned, each by itself, in time about linear in their length; null and empty ones have no match.
    Repeated rows have rows each, rows with a null id too. Other columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(index or LicenseIndex())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches):
            owner, found = [], []
            texts = b.column(1)
            for i, words in enumerate(hashed_words(texts, SEPARATES)):
                if len(words):
                    own = shared.value.find(words, binary(texts.slice(i, 1))[0])
                    found += own
                    owner += [i] * len(own)
            if found:
                name, share, matched, start, end = zip(*found, strict=True)
                columns = [pa.array(name), pa.array(share), *(pa.array(x, pa.int64()) for x in (matched, start, end))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), *columns], ["id", "license", "coverage", "n_matched", "start", "end"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(source, run, f"id {kind}, license string, coverage double, n_matched long, start long, end long")
    return out.withColumnRenamed("id", id_col)
