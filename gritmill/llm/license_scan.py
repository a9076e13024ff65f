"""License scans: winnowed template fingerprints pick candidates, banded alignment tells coverage and spans.

Templates are tokenised, and their five-word shingles winnowed (Schleimer et al., 2003) into an inverted index from
fingerprint to (template, position). The index is built on the driver from the templates alone, whose total size is
checked, and travels with the task. A document's shingles that the index knows vote for (template, diagonal); each voted
diagonal band is aligned to the template, and matched words give coverage and a span in the document. Of matches of one
template that overlap, the one with most matched words stays.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gritmill.llm.common import text_bytes

WIDTH, WINDOW, BAND, MAX_TEMPLATE_WORDS = 5, 4, 8, 200_000
_WORD = re.compile(rb"[A-Za-z0-9]+(?:[.-][0-9]+)*")

# Notices, first paragraphs, and (named -text) whole texts of common licenses, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0-text": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}


def tokens(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Lower-case words of letters and digits (version numbers whole), with byte spans."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [x for x, _ in found], [s for _, s in found]


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Positions of the least (rightmost of equals) hash of each window; all if fewer."""
    if len(hashes) <= window:
        return list(range(len(hashes)))
    keep = {min(range(i, i + window), key=lambda k: (hashes[k], -k)) for i in range(len(hashes) - window + 1)}
    return sorted(keep)


class Index:
    """Templates as word numbers, and the inverted index of their winnowed shingles."""

    def __init__(self, templates: dict[str, str]):
        words = {k: tokens(v.encode())[0] for k, v in templates.items()}
        if sum(map(len, words.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have over {MAX_TEMPLATE_WORDS} words")
        self.numbers: dict[bytes, int] = {}
        self.names = [k for k, v in words.items() if v]
        self.words = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words[k]] for k in self.names]
        self.posts: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            width = min(WIDTH, len(ids))
            shingles = [tuple(ids[i : i + width]) for i in range(len(ids) - width + 1)]
            for i in winnow([zlib.crc32(repr(s).encode()) for s in shingles]):
                self.posts[shingles[i]].append((t, i))
        self.widths = sorted({len(s) for s in self.posts})


def align(doc: list[int], template: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the longest common subsequence of pairs (i, j) with low <= i - j <= high.

    Of the longest, the one with the shortest span in the document, the first such; 0 words give (0, 0, 0).
    """
    m, unit = len(template), 1 << 32
    row = [0] * (m + 1)  # by template position: matched words * unit + the latest first word
    best = (0, 0, 0)  # matched, -span, -first
    for i, word in enumerate(doc):
        if i - low < 0:
            continue
        start = max(0, i - high)
        before = row[start]  # of the row above
        left = before
        for j in range(start, min(m, i - low + 1)):
            x = above = row[j + 1]
            if word == template[j]:
                y = before + unit if before else unit + i
                if y > x:
                    x = y
                    matched, first = divmod(y, unit)
                    if matched >= best[0]:
                        best = max(best, (matched, first - i - 1, -first))
            if left > x:
                x = left
            row[j + 1] = left = x
            before = above
    matched, span, first = best
    return matched, -first, -first - span


def places(ids: list[int], template: list[int], diagonals: list[int], min_coverage: float) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of the template's matches about the voted diagonals, by best matched count; none overlap.

    Diagonals within BAND of the first of a group share a band, which reaches BAND beyond them. What a better match leaves
    of a band's words is aligned again, so that copies in a row are all found. A band with too few words of the template
    to reach min_coverage is passed over, which loses nothing.
    """
    m = len(template)
    vocabulary = set(template)
    known = [0, *accumulate(x in vocabulary for x in ids)]
    todo: list[tuple[int, int, int, int, int, int, int]] = []

    def add(low: int, high: int, a: int, z: int) -> None:
        if known[z] - known[a] >= min_coverage * m:
            matched, first, end = align(ids[a:z], template, low - a, high - a)
            if matched and matched >= min_coverage * m:
                heappush(todo, (-matched, end - first, a + first, low, high, a, z))

    groups: list[list[int]] = []
    for d in sorted(diagonals):
        if groups and d <= groups[-1][0] + BAND:
            groups[-1][1] = d
        else:
            groups.append([d, d])
    for lowest, highest in groups:
        low, high = lowest - BAND, highest + BAND
        add(low, high, max(0, low), min(len(ids), high + m))
    found: list[tuple[int, int]] = []  # sorted spans, disjoint
    out = []
    while todo:
        matched, span, first, low, high, a, z = heappop(todo)
        end = first + span
        at = bisect_left(found, (first, end))
        if (at == 0 or found[at - 1][1] <= first) and (at == len(found) or found[at][0] >= end):
            found.insert(at, (first, end))
            out.append((-matched, first, end))
        at = max(0, bisect_left(found, (a, a)) - 1)
        while at < len(found) and found[at][0] < z:
            if a < found[at][0]:
                add(low, high, a, found[at][0])
            a = max(a, found[at][1])
            at += 1
        if a < z:
            add(low, high, a, z)
    return out


def scan(text: bytes, index: Index, min_coverage: float = 0.8) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start byte, end byte) of the template matches of one text, by place."""
    words, spans = tokens(text)
    get = index.numbers.get
    ids = [get(w, 0) for w in words]
    known = np.array(ids, np.int64) > 0
    votes: dict[int, set[int]] = defaultdict(set)
    for width in index.widths:
        if len(ids) < width:
            continue
        run = np.convolve(known, np.ones(width, int), "valid") if len(ids) else np.zeros(0)
        for i in np.flatnonzero(run == width).tolist():
            for t, j in index.posts.get(tuple(ids[i : i + width]), ()):
                votes[t].add(i - j)
    out = []
    for t, diagonals in votes.items():
        m = len(index.words[t])
        for matched, first, end in places(ids, index.words[t], list(diagonals), min_coverage):
            out.append((index.names[t], matched / m, matched, spans[first][0], spans[end - 1][1]))
    return sorted(out, key=lambda x: (x[3], -x[2], x[0]))


def _scanner(templates: dict[str, str], min_coverage: float):
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index = Index(templates)
        for b in batches:
            at, out = [], []
            for i, t in enumerate(text_bytes(b.column(1))):
                found = scan(t, index, min_coverage)
                at += [i] * len(found)
                out += found
            cols = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return run


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage (matched share of the template's words), matched_words, start, end (bytes).

    Null and empty texts have no matches; a text matches a template at each place once, and may match several. Repeated
    rows and null doc_ids give rows of their own; other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scanner(templates or TEMPLATES, min_coverage), "doc_id long, license string, coverage double, matched_words long, start long, end long")
