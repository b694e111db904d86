"""Licence scan by patience alignment.

A template is aligned with a text on the words that occur once in both: the longest increasing subsequence of their
places gives anchors, and the gaps between anchors are aligned the same way, down to equal runs at a gap's ends. The
share of the template's words that are aligned is its coverage. Every match at ``COVER`` or more is reported with its
span, as long as no two share words: of those that do, the one stays that aligns most words less the ones it misses (so
a BSD-3-Clause text isn't a BSD-2-Clause one). Words of a match are blanked and the windows that held them aligned
again until nothing more is found, so repeated and concatenated licences all count.

A licence's words lie together: alignments are made within windows of ``WINDOW`` times the template's words, one beginning with every
template's length, so any match whose words lie within ``WINDOW - 1`` template lengths is inside one, however long the text. Only
windows that hold enough of a template's distinct words are aligned; others can't reach the coverage.

Odd cases: null and wordless texts have no licence (null, coverage 0, no matches). ``license`` and its columns are those
of the match of largest coverage; of equal ones the longer template, then the name that sorts first, then the first place. Repeated rows give equal rows; a null ``doc_id`` stays null. No rows in, no rows
out. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DBL, INT, LONG, STR, own_columns, schema

COVER = 0.8
#: Template lengths to a window; words of a match may stand three times as far apart as in the template.
WINDOW = 4
#: The words of well-known licences and notices. "ISC grant" and "BSD conditions" are the parts that stand without the rest.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "ISC grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
}
_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        pairs = [(i, at[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in at]
        tops: list[int] = []  # patience piles: least end of a rising run of each length
        ends: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(pairs):
            pile = bisect_left(tops, j)
            tops[pile : pile + 1], ends[pile : pile + 1] = [j], [n]
            back.append(ends[pile - 1] if pile else -1)
        n, anchors = (ends[-1] if ends else -1), []
        while n >= 0:
            anchors.append(pairs[n])
            n = back[n]
        if not anchors:
            continue
        x, y = a0, b0
        for i, j in reversed(anchors):
            out.append((i, j))
            todo.append((x, i, y, j))
            x, y = i + 1, j + 1
        todo.append((x, a1, y, b1))
    return sorted(out)


_PARSED = {name: [w.lower() for w in _WORD.findall(t)] for name, t in TEMPLATES.items()}
_SETS = {name: frozenset(w) for name, w in _PARSED.items()}
_EVERY = frozenset().union(*_SETS.values())
#: Longer templates first. A coverage of COVER leaves out a few words at most, so this many distinct ones are in the text.
_ORDER = sorted(((n, t, len(_SETS[n]) - int(len(t) * (1 - COVER) + 1e-9)) for n, t in _PARSED.items()), key=lambda x: (-len(x[1]), x[0]))


def _starts(words: int, n: int) -> range:
    """Where windows begin: also close to the end, where the last of several copies stands alone."""
    return range(0, max(1, words - int(n * COVER) + 1), n)


Match = tuple[str, float, int, int, int]


def matches(text: str) -> list[Match]:
    """Template, coverage, aligned words, and the characters [from, to) they span, of each match, in order of place; none share words."""
    have = _EVERY.intersection(_WORD.findall(text.lower()))
    likely = [(n, t, least) for n, t, least in _ORDER if len(have & _SETS[n]) >= least]
    if not likely:
        return []
    found = list(_WORD.finditer(text))
    words: list[str | None] = [m[0].lower() for m in found]
    tries: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (template, window): aligned places
    todo = [(k, at) for k, (_, t, _) in enumerate(likely) for at in _starts(len(words), len(t))]
    order: list[tuple] = []  # tries, the best first; entries whose try has changed are passed over
    out: list[Match] = []
    while True:
        for k, at in todo:
            name, t, least = likely[k]
            window = words[at : at + WINDOW * len(t)]
            tries.pop((k, at), None)
            if len(_SETS[name].intersection(window)) >= least:
                pairs = aligned(t, window)
                if len(pairs) / len(t) >= COVER:
                    tries[k, at] = pairs = [(i, at + j) for i, j in pairs]
                    # most aligned words less missing ones; of equal ones the longer template, then the tightest, then the first
                    heappush(order, (len(t) - 2 * len(pairs), k, pairs[-1][1] - pairs[0][1], pairs[0][1], at, pairs))
        while order and tries.get((order[0][1], order[0][4])) is not order[0][5]:
            heappop(order)
        if not order:
            return sorted(out, key=lambda m: (m[3], m[4], m[0]))
        pairs, (name, t, _) = order[0][5], likely[order[0][1]]
        out.append((name, len(pairs) / len(t), len(pairs), found[pairs[0][1]].start(), found[pairs[-1][1]].end()))
        for _, j in pairs:
            words[j] = None
        lo, hi = pairs[0][1], pairs[-1][1]
        todo = []
        for k, (_, t, _) in enumerate(likely):  # windows that held a word of it
            n = len(t)
            todo += [(k, at) for at in range(max(0, (lo // n - WINDOW) * n), hi + 1, n) if at in _starts(len(words), n) and at + WINDOW * n > lo]


def scan(text: str, every: list[Match] | None = None) -> tuple[str | None, float, int, int, int]:
    """The match of largest coverage."""
    every = matches(text) if every is None else every
    return min(every, key=lambda m: (-m[1], -len(_PARSED[m[0]]), m[0], m[3]), default=(None, 0.0, 0, 0, 0))


_MATCH = schema(license=STR, coverage=DBL, n_aligned=INT, start=LONG, end=LONG)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
    match = pa.struct(list(zip(_MATCH.names, kinds)))
    for b in batches:
        every = [matches(t or "") for t in b.column("text").to_pylist()]
        cols = list(zip(*[scan("", x) for x in every])) or [()] * 5
        lists = pa.array([[dict(zip(_MATCH.names, m)) for m in x] for x in every], pa.list_(match))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)], lists], ["doc_id", *_MATCH.names, "matches"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, license, coverage, n_aligned, start, end of the best match and ``matches``, all of them in order of place, of each row of ``docs``."""
    own = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(_scanned, T.StructType([*schema(doc_id=LONG).fields, *_MATCH.fields, T.StructField("matches", T.ArrayType(_MATCH))]))
