"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are hashed in runs of K words; of every WINNOW consecutive runs the least is kept, and an
inverted index leads from a kept run to its templates and places. A text's runs that stand in the
index give hits; hits of one template on nearby diagonals are a candidate. A banded alignment of the
template with the text around them, whose ends in the text are free, gives the matched words, the
coverage of the template and the span. Candidates of enough coverage count; the best of a template
stays, and the template is aligned again with what is left around it, until no more reaches the
coverage, so occurrences side by side all count and those of one template never overlap.

The templates are a fixed list in this module, the notices and distinctive parts of licenses, or one
that the caller gives (``read_templates`` reads a folder of whole licenses), so the index that
tasks get is bounded by it. Texts are read once, whole, and never shuffled.

Defined results: null and empty texts match nothing. Rows pass with all columns, repeated rows and
null doc_ids too; a column named matches is replaced. Spans count code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import FOLD, slices, trimmed

#: Words of a run; runs of which the least is kept; least coverage; half width of a band.
K, WINNOW, COVERAGE, BAND = 3, 2, 0.8, 6

# Texts of licenses and of the usual notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.',
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}



def read_templates(spark, folder: str, glob: str = "*") -> dict[str, str]:
    """Templates from a folder of license texts, by file name: a list of whole licenses such as systems
    come with. It goes to every task, so it is for a list of bounded size."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.try_validate_utf8(F.col("content").cast("string")).alias("text")).collect()
    return {r.name: r.text for r in rows if r.text}


#: Words of a text, as FOLD parts them.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Index:
    """Vocabulary, templates as word numbers, and the inverted index of their kept runs."""

    def __init__(self, templates: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted(templates)
        self.texts = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(templates[n])] for n in self.names]
        self.base = len(self.vocabulary) + 1
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.texts):
            runs = self.runs(np.array(ids, np.int64)).tolist()
            mixed = [(r * 0x9E3779B97F4A7C15) & ((1 << 64) - 1) for r in runs]
            kept = set()
            for p in range(max(1, len(runs) - WINNOW + 1) if runs else 0):  # the last of equal ones
                window = range(p, min(p + WINNOW, len(runs)))
                kept.add(min(window, key=lambda q: (mixed[q], -q)))
            for q in kept:
                self.places.setdefault(runs[q], []).append((t, q))
        self.codes = np.array(sorted(self.places), np.int64)

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Codes of the runs of K words; 0 where a word is not in the vocabulary."""
        if len(ids) < K:
            return np.zeros(0, np.int64)
        n = len(ids) - K + 1
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(K):
            code = code * self.base + ids[k : n + k]
            known &= ids[k : n + k] > 0
        return np.where(known, code, 0)


def align(template: list[int], ids: list[int], low: int, high: int) -> tuple[int, int, int] | None:
    """Best alignment of a template with ids on the diagonals from low to high (place in the ids
    less place in the template): matched words, first and last + 1 matched place. The ends in the
    ids are free; a match gains 1, a differing or missing word costs 1 or is left out at the rim."""
    best = _best(template, ids, low, high)
    return best[1:] if best[1] else None


def _best(template: list[int], ids: list[int], low: int, high: int) -> tuple[int, int, int, int]:
    """As ``align``, with the score before the matched words."""
    width = high - low + 1
    # For each diagonal: score, matched, first matched place, one after the last.
    row = [(0, 0, -1, -1)] * width
    for i, w in enumerate(template):
        new: list[tuple[int, int, int, int]] = []
        for d in range(width):
            j = i + low + d
            score, n, a, b = row[d]
            if 0 <= j < len(ids) and ids[j] == w:
                best = (score + 1, n + 1, j if a < 0 else a, j + 1)
            else:
                best = (score - 1, n, a, b)
            if d + 1 < width and row[d + 1][0] - 1 > best[0]:  # a word of the template is missing
                best = (row[d + 1][0] - 1, *row[d + 1][1:])
            if d and new[d - 1][0] - 1 > best[0]:  # a word stands between
                best = (new[d - 1][0] - 1, *new[d - 1][1:])
            new.append(best)
        row = new
    return max(row, key=lambda x: (x[1], x[0], -x[2]))


def _candidates(hits: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges of diagonals of one template's hits, each at most a band wide."""
    found = sorted({p - q for p, q in hits})
    begin = last = found[0]
    for d in found[1:]:
        if d - begin > BAND:
            yield begin, last
            begin = d
        last = d
    yield begin, last


def _occurrences(template: list[int], ids: list[int], hits: list[tuple[int, int]], coverage: float) -> list[tuple[int, int, int]]:
    """Matched words, first and last + 1 place of all occurrences of a template, none over another:
    the best first, then the best of what its neighbours and itself leave of the candidates."""
    queue: list[tuple[int, int, int, int, int, int, int, int]] = []

    def aligned(begin: int, end: int, low: int, high: int) -> Iterator[tuple]:
        if end - begin < coverage * len(template):
            return
        score, n, a, b = _best(template, ids[begin:end], low - begin, high - begin)
        if n and n >= coverage * len(template):
            yield -n, -score, a + begin, b + begin, begin, end, low, high

    for low, high in _candidates(hits):  # each with the piece of the text that the band can touch
        queue += aligned(max(0, low - BAND), min(len(ids), high + BAND + len(template)), low - BAND, high + BAND)
    heapify(queue)
    starts: list[int] = []
    found: list[tuple[int, int, int]] = []  # by place
    while queue:
        n, _, a, b, begin, end, low, high = heappop(queue)
        at = bisect_left(starts, a)
        if not (at and found[at - 1][2] > a or at < len(found) and found[at][1] < b):
            starts.insert(at, a)
            found.insert(at, (-n, a, b))
        at = max(0, bisect_left(starts, begin) - 1)
        while at < len(found) and found[at][1] < end:
            for x in aligned(begin, min(found[at][1], end), low, high):
                heappush(queue, x)
            begin = max(begin, found[at][2])
            at += 1
        for x in aligned(begin, end, low, high):
            heappush(queue, x)
    return found


def scan_shard(texts: list[str], index: Index, coverage: float = COVERAGE) -> list[list[dict]]:
    """For each text its matches, by place."""
    get = index.vocabulary.get
    each = [[get(w, 0) for w in words(t)] for t in texts]
    out: list[list[dict]] = []
    for text, ids in zip(texts, each, strict=True):
        code = index.runs(np.array(ids, np.int64))
        at = np.flatnonzero(np.isin(code, index.codes)) if len(code) else []
        hits: dict[int, list[tuple[int, int]]] = {}
        for p in at:
            for t, q in index.places[int(code[p])]:
                hits.setdefault(t, []).append((int(p), q))
        found = []
        for t, own in sorted(hits.items()):
            template = index.texts[t]
            found += [(a, b, index.names[t], n, n / len(template)) for n, a, b in _occurrences(template, ids, own, coverage)]
        if found:
            place = [m.span() for m in _WORD.finditer(text)]
            found = [{"license": name, "coverage": c, "matched": n, "start": place[a][0], "end": place[b - 1][1]} for a, b, name, n, c in sorted(found)]
        out.append(found)
    return out


_MATCHES = "array<struct<license:string,coverage:double,matched:bigint,start:bigint,end:bigint>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with matches: array<struct<license, coverage, matched, start, end>>, by place."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    docs = docs.drop("matches")
    schema = docs.withColumn("matches", F.array().cast(_MATCHES)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("text")).to_pylist()]
            found = [m for a, b in slices([len(t) for t in texts]) for m in scan_shard(texts[a:b], shared.value, coverage)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "matches"])

    return docs.mapInArrow(trimmed(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs)
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",")
    spans = F.array_join(F.transform("matches", lambda m: F.format_string("%s:%d:%d:%.3f", m["license"], m["start"], m["end"], m["coverage"])), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), spans.alias("spans"), best.alias("best_coverage"))
