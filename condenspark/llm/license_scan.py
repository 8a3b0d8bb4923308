"""Operator 3: license scans by patience alignment.

A text is aligned with a license template at the level of words: words that are unique to both sides are anchors, the longest increasing
subsequence of them is kept, and the gaps between anchors are aligned in the same way; a gap without anchors, of any size, takes its
longest common subsequence. Coverage is the share of the template's words that are aligned.

Texts are scanned whole. A template can only be covered where its distinctive words are, so alignment runs on windows around them; a
window that shares too few words for the coverage is skipped, which cannot lose a match. A window is cut into occurrences first: each ends
where enough of the template's words have come in order, so copies that follow each other are told apart. Templates are short notices
and whole license texts. Of overlapping matches the one with most aligned words stays. Null and empty texts have no match. Repeated rows each give their matches.
doc_id may be null and of any type. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame

#: Short notices of well-known licenses, as they are commonly printed, and two whole licenses that are short.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "reserved": "All rights reserved.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC": "Released under the ISC License.",
    "BSD-line": "Released under the BSD License.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}
_MIT = ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT-grant"] + _MIT,
    "BSD-2-Clause-text": TEMPLATES["BSD"] + _BSD + _BSD_END,
    "BSD-3-Clause-text": TEMPLATES["BSD"] + _BSD + _BSD_3 + _BSD_END,
}
#: The Creative Commons licenses by their short and long names.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
TEMPLATES |= {f"CC-{k}-4.0-line": f"Licensed under CC {k} 4.0." for k in _CC}
TEMPLATES |= {f"CC-{k}-4.0": f"This work is licensed under a Creative Commons {v} 4.0 International License." for k, v in _CC.items()}
TEMPLATES |= {"CC0-1.0-line": "Licensed under CC0 1.0.", "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."}
#: Whole licenses in the folder licenses, without the appendix on how to apply them.
WHOLE = ("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0")


def all_templates() -> dict[str, str]:
    """TEMPLATES and the whole licenses. Only the driver reads the folder."""
    return TEMPLATES | {f"{k}-text": (files("condenspark.llm") / "licenses" / f"{k}.txt").read_text() for k in WHOLE}


WORD = re.compile(r"\w+")
FOUND = "license string, coverage double, aligned int, begin long, end long"


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of a and b."""
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
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and ca[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place])
        if anchors:
            out += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
        else:
            out += common(a, b, a0, a1, b0, b1)
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (in order of the first) that rises in the second, by piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def masks_of(words: list[str]) -> dict[str, int]:
    """The places of each word, as bits."""
    masks: dict[str, int] = {}
    for j, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << j
    return masks


def rows_of(a: list[str], b: list[str]) -> Iterator[int]:
    """After each word of a: bit j is 0 where the longest common subsequence with b[: j + 1] is longer than with b[:j]."""
    masks, full = masks_of(b), (1 << len(b)) - 1
    v = full
    for w in a:
        if u := v & masks.get(w, 0):
            v = ((v + u) | (v - u)) & full
        yield v


def lengths(v: int, m: int) -> list[int]:
    out = [0]
    for c in reversed(f"{v:0{m}b}"):
        out.append(out[-1] + (c == "0"))
    return out


def common(a, b, a0, a1, b0, b1, cells: int = 1 << 26) -> list[tuple[int, int]]:
    """Longest common subsequence of a gap. One of more cells is halved first, so memory is bounded."""
    out, todo = [], [(a0, a1, b0, b1)]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n * m > cells and n > 1:
            mid, v, r = a0 + n // 2, 0, 0
            for v in rows_of(a[a0:mid], b[b0:b1]):
                pass
            for r in rows_of(a[mid:a1][::-1], b[b0:b1][::-1]):
                pass
            left, right = lengths(v, m), lengths(r, m)
            cut = b0 + max(range(m + 1), key=lambda j: left[j] + right[m - j])
            todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
            continue
        rows, i, j = list(rows_of(a[a0:a1], b[b0:b1])), n, m
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    j -= 1
                    out.append((a0 + i, b0 + j))
    return out


def occurrences(a: list[str], m: int, need: int, ahead: dict[str, int], back: dict[str, int]) -> list[tuple[int, int]]:
    """The most disjoint stretches of a that hold need words of a template of m words in order: each ends as early and begins as late as
    it can. ahead and back: masks of the template and of the template backwards."""
    full, out = (1 << m) - 1, []
    v = full
    for i, w in enumerate(a):
        if not (u := v & ahead.get(w, 0)):
            continue
        v = ((v + u) | (v - u)) & full
        if m - v.bit_count() < need:
            continue
        r, k = full, i + 1
        while m - r.bit_count() < need:
            k -= 1
            u = r & back.get(a[k], 0)
            r = ((r + u) | (r - u)) & full
        out.append((k, i + 1))
        v = full
    return out


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {k: [w.lower() for w in WORD.findall(v)] for k, v in templates.items()}
        counts = {k: Counter(v) for k, v in self.templates.items()}
        self.counts = counts
        self.masks: dict[str, tuple[dict[str, int], dict[str, int]]] = {}  # made where they are used
        # a match lacks at most (1 - coverage) of the words: so many of the longest ones and one more always include a word of it
        self.marks: dict[str, set[str]] = {}
        for name, words in self.templates.items():
            spare, picked = len(words) - -(-int(coverage * len(words) * 1000) // 1000), Counter()
            for w in sorted(counts[name], key=lambda w: (-len(w), w)):
                picked[w] = counts[name][w]
                if sum(picked.values()) > spare + 1:
                    break
            for w in picked:
                self.marks.setdefault(w, set()).add(name)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        spans = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        lower = (text or "").lower()
        words = [lower[b:e] for b, e in spans] if len(lower) == len(text or "") else [text[b:e].lower() for b, e in spans]
        at: dict[str, list[int]] = {}
        marks = self.marks
        for i, w in enumerate(words):
            if w in marks:
                for name in marks[w]:
                    at.setdefault(name, []).append(i)
        found = []
        for name, places in at.items():
            template, reach = self.templates[name], 2 * len(self.templates[name])
            need = math.ceil(self.coverage * len(template))
            if len(words) < need:
                continue
            if name not in self.masks:
                self.masks[name] = masks_of(template), masks_of(template[::-1])
            begin = 0
            for k, i in enumerate(places):
                if k + 1 < len(places) and places[k + 1] - i <= reach:
                    continue
                lo, hi = max(0, places[begin] - reach), min(len(words), i + reach)
                begin = k + 1
                window, has = words[lo:hi], self.counts[name]
                own = Counter(w for w in window if w in has)
                if sum((own & has).values()) < need:
                    continue
                spots = occurrences(window, len(template), need, *self.masks[name])
                more, end = 2 * (len(template) - need), 0  # words of the notice that may stand around the least stretch
                for (b, e), (after, _) in zip(spots, [*spots[1:], (len(window), 0)], strict=False):
                    b, e = max(end, b - more), min(after, e + more)
                    pairs = patience(window[b:e], template)
                    if len(pairs) < need:
                        pairs = sorted(common(window[b:e], template, 0, e - b, 0, len(template)))
                    first, end = lo + b + pairs[0][0], b + pairs[-1][0] + 1
                    found.append((name, len(pairs) / len(template), len(pairs), spans[first][0], spans[lo + end - 1][1]))
        kept: list[tuple[int, tuple[str, float, int, int, int]]] = []  # by their places, which are disjoint
        for f in sorted(found, key=lambda f: (-f[2], -f[1], f[3], f[0])):
            i = bisect_left(kept, (f[3],))
            if (not i or kept[i - 1][1][4] <= f[3]) and (i == len(kept) or kept[i][0] >= f[4]):
                kept.insert(i, (f[3], f))
        return [f for _, f in kept]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.85) -> DataFrame:
    """doc_id, license, coverage, aligned, begin, end (characters) for each notice found."""
    scanner = Scanner(templates or all_templates(), coverage)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, t in enumerate(batch.column("text").to_pylist()) for f in scanner.scan(t)]
            own, *found = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own, pa.int64())), *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=["doc_id", "license", "coverage", "aligned", "begin", "end"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}")
