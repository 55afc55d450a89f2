"""License scan: MinHash bands over overlapping windows of words find templates, exact containment verifies.

Words are runs of letters and digits, in lower case; shingles are five words. A template of s shingles is
looked for in windows of 2s - 1 shingles that begin every s shingles, so every run of s shingles of a text
lies whole in one window. Template and window have ``BANDS`` MinHash values, each a band of its own: a
window that holds a share c of the template has Jaccard similarity of at least c / (2 + (1 - c) - 1 / s), so
with 32 bands a template held whole is met with probability 1 - 1e-9 or more, and one of which 0.8 is held
with 0.999999. What is met is verified: the shingles of the template in the window, counted exactly, must be
``CONTAINMENT`` of the template's. A met window that lacks some is counted again with s shingles more on both sides,
without what other matches cover; so a copy that inserted words stretch to at most 2s shingles is counted whole,
wherever it begins.

A window can share its minimum with a template only where it holds the shingle which is the template's
minimum. Minima are therefore taken in the windows around such shingles; all other windows can't meet any
template, and the result is that of taking the minima of all windows.

Texts that are null, empty or shorter than five words have no shingle and no match. Templates have at least
five words; two with the same shingles are told apart by nothing, and both are reported. Every text is read in whole, in
time proportional to its length and the template's. Repeated rows each have their matches, an empty table gives none.
Columns to ``keep`` may not have the name of a result column.

``TEMPLATES`` holds notices, headers and short licenses in usual wordings; it is a bounded list, any other can be given.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import Words, mix, share, table

SHINGLE = 5
BANDS = 32
CONTAINMENT = 0.8
_APART = re.compile(r"[\W_]+")
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

# Public license notices, by SPDX identifier and part.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."
    ),
    "ISC permission": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "MIT warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "MIT licensed": "Licensed under the MIT License.",
    "MIT use": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "BSD use": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software. This notice may not be removed or altered from "
        "any source distribution."
    ),
    "GPL-2.0 header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."
    ),
    "GPL warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details."
    ),
    "GPL version 2": "Licensed under the GNU GPL version 2",
    "GPL version 3": "Licensed under the GNU GPL version 3",
    "LGPL-2.1 header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version."
    ),
    "LGPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "AGPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
        "any later version."
    ),
    "EPL-2.0 header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to "
        "this work to the public domain worldwide."
    ),
    "SPDX Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def words_of(text: str | None) -> str:
    return _APART.sub(" ", (text or "").lower()).strip()


def shingles(text: str | None) -> np.ndarray:
    words = Words(words_of(text))
    return words.runs(SHINGLE) if words.n >= SHINGLE else np.zeros(0, np.uint64)


class _Stretches:
    """Matches found from left to right, each at most a few template lengths long, and those near a place."""

    def __init__(self) -> None:
        self.all: list[tuple[int, int, int, float]] = []
        # the largest end so far never falls, so it can be searched
        self.ends: list[int] = []

    def add(self, match: tuple[int, int, int, float]) -> None:
        self.all.append(match)
        self.ends.append(max(match[2], self.ends[-1] if self.ends else 0))

    def near(self, lo: int, hi: int) -> list[tuple[int, int, int, float]]:
        """The matches that overlap lo .. hi, and perhaps a few more."""
        out = []
        for m in self.all[bisect_left(self.ends, lo) :]:
            if m[1] > hi + (hi - lo):
                break
            if m[1] <= hi:
                out.append(m)
        return out


class Scanner:
    def __init__(self, templates: Mapping[str, str], containment: float = CONTAINMENT):
        self.containment = containment
        self.names = list(templates)
        self.shingles = [np.unique(shingles(t)) for t in templates.values()]
        self.length = [len(shingles(t)) for t in templates.values()]
        if not all(self.length):
            raise ValueError("a license template needs at least five words")
        # (shingle, band, template): where the template's minima stand
        found = []
        for number, own in enumerate(self.shingles):
            for band, seed in enumerate(_SEEDS):
                found.append((own[mix(own ^ seed).argmin()], band, number))
        found.sort()
        self.key = np.array([f[0] for f in found], np.uint64)
        self.band = [f[1] for f in found]
        self.template = [f[2] for f in found]
        self.keys = np.unique(self.key)

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, words, containment) of each match, in the order of the text."""
        own = shingles(text)
        if not len(own) or not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == own)
        met: set[tuple[int, int]] = set()
        for place in hits.tolist():
            lo, hi = np.searchsorted(self.key, own[place], "left"), np.searchsorted(self.key, own[place], "right")
            for i in range(lo, hi):
                number, size = self.template[i], self.length[self.template[i]]
                seed = _SEEDS[self.band[i]]
                least = mix(own[place : place + 1] ^ seed)[0]
                for window in range(max(0, -(-(place - 2 * size + 2) // size)), place // size + 1):
                    if (number, window) not in met:
                        part = own[window * size : window * size + 2 * size - 1]
                        if mix(part ^ seed).min() == least:
                            met.add((number, window))
        found: list[tuple[int, int, int, float]] = []
        for number, windows in groupby(sorted(met), lambda m: m[0]):
            found += self._verified(own, number, [w for _, w in windows])
        return self._joined(sorted(found))

    def _verified(self, own: np.ndarray, number: int, windows: list[int]) -> list[tuple[int, int, int, float]]:
        """Matches of one template in the windows that were met, by counting its shingles."""
        size, wanted = self.length[number], self.shingles[number]
        sure, unsure = _Stretches(), []
        for window in windows:
            first = window * size
            inside = first + np.flatnonzero(np.isin(own[first : first + 2 * size - 1], wanted))
            if not len(inside):
                continue
            share_ = len(np.unique(own[inside])) / len(wanted)
            if share_ >= self.containment:
                sure.add((number, int(inside[0]), int(inside[-1]) + SHINGLE, share_))
            if share_ < 1:
                unsure.append((first, inside, share_))
        more = _Stretches()
        for first, inside, share_ in unsure:
            lo, end = int(inside[0]), int(inside[-1]) + SHINGLE
            begin, stop = max(0, first - size), first + 3 * size - 1
            # only what stands near the window can cover a part of it
            near = sure.near(begin, stop + SHINGLE) + more.near(begin, stop + SHINGLE)
            if share_ >= self.containment:
                # what the match lacks may stand beyond the window
                near = [m for m in near if m[2] <= lo or m[1] >= end]
            else:
                inside = self._clear(inside, near)
                if not len(inside):
                    continue
            wide = begin + np.flatnonzero(np.isin(own[begin:stop], wanted))
            wide = self._clear(wide[np.isin(wide, inside) | ~np.isin(own[wide], own[inside])], near)
            share_ = len(np.unique(own[wide])) / len(wanted)
            if share_ >= self.containment:
                more.add((number, int(wide[0]), int(wide[-1]) + SHINGLE, share_))
        return sure.all + more.all

    @staticmethod
    def _clear(at: np.ndarray, matches: list[tuple[int, int, int, float]]) -> np.ndarray:
        """The shingles that share no word with any of the matches."""
        for _, lo, end, _ in matches:
            at = at[(at + SHINGLE <= lo) | (at >= end)]
        return at

    def _joined(self, matches: list[tuple[int, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Windows of one template whose matched words overlap are one match, with the larger containment."""
        out: list[list] = []
        for number, first, end, share_ in matches:
            if out and out[-1][0] == number and first < out[-1][2]:
                out[-1][2] = max(out[-1][2], end)
                out[-1][3] = max(out[-1][3], share_)
            else:
                out.append([number, first, end, share_])
        return [(self.names[n], first, end - first, c) for n, first, end, c in sorted(out, key=lambda m: (m[1], m[0]))]


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    keep: tuple[str, ...] = ("doc_id",),
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row for each match: the columns ``keep`` of docs, template, first_word (from 0), n_words,
    containment and matched, its words. Texts without a match give no row. The templates, a fixed list, go to
    the executors with the code."""
    if clash := {"template", "first_word", "n_words", "containment", "matched"} & set(keep):
        raise ValueError(f"columns to keep are also result columns: {sorted(clash)}")
    shared = share(docs.sparkSession, dict(templates))
    scanners: list[Scanner] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not scanners:
            scanners.append(Scanner(shared.value, containment))
        for b in batches:
            rows, found = [], []
            for i, text in enumerate(b["text"]):
                matches = scanners[0].scan(text)
                if matches:
                    words = words_of(text).split(" ")
                    for name, first, n, share_ in matches:
                        rows.append(i)
                        found.append((name, first, n, share_, " ".join(words[first : first + n])))
            out = b[list(keep)].iloc[rows].reset_index(drop=True)
            more = pd.DataFrame(found, columns=["template", "first_word", "n_words", "containment", "matched"])
            yield pd.concat([out, more], axis=1)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    schema += ", template string, first_word long, n_words long, containment double, matched string"
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInPandas(run, schema)


def op8_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every match of a license template in any document."""
    return scan(table(spark, sf, "documents").select("doc_id", "text"))
