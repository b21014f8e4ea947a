"""Operator 1: licence scan by Dice coefficient over word bigrams.

A text is cut into units: the whole text, its paragraphs and its lines. A
normalised unit is compared to the licence templates whose sizes leave the Dice
coefficient a chance to reach the limit; the others are passed over. Passages of
the whole text, across lines and within them, are compared to the templates of
which it holds enough bigrams.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lookout.llm.common import prepared

# Notices as their publishers ask for them to be used.
TEMPLATES: dict[str, str] = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF "
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING "
        "FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING "
        "OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software. Permission is granted to anyone to "
        "use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."),
    "GPL-3.0 line": "Licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    "GPL-2.0 notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU General Public License for more details."),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC-BY-4.0 line": "This work is licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "This work is licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 line": "This work is licensed under CC BY-NC 4.0.",
    "CC0-1.0 line": "To the extent possible under law, all copyright and related rights to this work are waived (CC0 1.0).",
    "All rights reserved": "Copyright. All rights reserved.",
}

TOKEN = re.compile(r"[a-z0-9]+")
FIELDS = "license string, dice double, n_units long, licenses array<string>"


@dataclass(frozen=True)
class Settings:
    """``dice``: least coefficient of a match."""
    dice: float = 0.8


def normalised(text: str) -> list[str]:
    """Lower-case runs of letters and digits; the spellings of licence are one."""
    return TOKEN.findall(text.lower().replace("licence", "license"))


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 |a and b| / (|a| + |b|) over bigrams, counted as often as they occur."""
    return 2 * sum((a & b).values()) / max(1, a.total() + b.total())


class Library:
    """The templates, by the number of their bigrams."""

    def __init__(self, templates: dict[str, str], limit: float):
        self.limit = limit
        sets = {name: bigrams(normalised(t)) for name, t in templates.items()}
        self.sets = sorted(((b.total(), name, b) for name, b in sets.items()), key=lambda x: x[:2])
        self.pairs = {p for b in sets.values() for p in b}
        self.words = {w for p in self.pairs for w in p}
        self.least = int(self.sets[0][0] * limit / (2 - limit)) if self.sets else 0
        self.most = self.sets[-1][0] * (2 - limit) / limit if self.sets else 0

        self.vocab = {w: k for k, w in enumerate(sorted(self.words))}
        size = len(self.vocab)
        code = {p: self.vocab[p[0]] * size + self.vocab[p[1]] for p in self.pairs}
        self.codes = np.array(sorted(code.values()), np.int64)
        #: how often each template has each pair of ``codes``, and how many a passage must share
        self.counts = np.zeros((len(self.sets), len(self.codes)), np.int64)
        for t, (_, _, template) in enumerate(self.sets):
            for pair, times in template.items():
                self.counts[t, np.searchsorted(self.codes, code[pair])] = times
        self.need = np.array([m * limit / (2 - limit) for m, _, _ in self.sets]) - 1e-9

    def passages(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(Dice, template, first word, past the last), best first: for every place
        where a template may begin, the run of words most like it, if it reaches the
        limit. A run has at least ``need`` pairs in common with its template, and its
        first and last pairs are the template's, as others only lower Dice."""
        if len(words) < 2 or not len(self.codes):
            return []
        number = np.fromiter(map(self.vocab.get, words, [-1] * len(words)), np.int64, len(words))
        at = np.flatnonzero((number[:-1] >= 0) & (number[1:] >= 0))
        code = number[at] * len(self.vocab) + number[at + 1]
        pair = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        same = self.codes[pair] == code
        at, pair = at[same], pair[same]
        if len(at) < self.need.min():
            return []
        have = np.minimum(self.counts, np.bincount(pair, minlength=len(self.codes))).sum(axis=1)
        out = []
        for t in np.flatnonzero(have >= self.need):
            m, name, _ = self.sets[t]
            mine = self.counts[t, pair] > 0
            place, kind = at[mine], pair[mine]
            most = int(m * (2 - self.limit) / self.limit + 1e-9)
            past = np.searchsorted(place, place + most)
            for lo in np.flatnonzero(past - np.arange(len(place)) >= self.need[t]):
                left, common, top = {}, 0, None
                first = int(place[lo])
                for q, k in zip(place[lo:past[lo]].tolist(), kind[lo:past[lo]].tolist()):
                    rest = left[k] if k in left else int(self.counts[t, k])
                    left[k] = rest - 1
                    if rest > 0:
                        common += 1
                        score = 2 * common / (q - first + 1 + m)
                        if score >= self.limit and (top is None or score > top[0]):
                            top = (score, name, first, q + 2)
                if top:
                    out.append(top)
        return sorted(out, key=lambda x: (-x[0], *x[1:]))

    def best(self, words: list[str]) -> tuple[float, str] | None:
        """The template most like a unit, if it reaches the limit; of equal ones
        the first by name. With n bigrams in one and m in the other, Dice is at
        most 2 min(n, m) / (n + m): this bound drops templates without counting."""
        n = len(words) - 1
        if n < 1 or n < self.least or n > self.most or self.words.isdisjoint(words):
            return None
        unit, top = None, None
        for m, name, template in self.sets:
            if 2 * min(n, m) < self.limit * (n + m):
                continue
            if unit is None:
                unit = bigrams(words)
                if self.pairs.isdisjoint(unit):
                    return None
            score = dice(unit, template)
            if score >= self.limit and (top is None or (-score, name) < (-top[0], top[1])):
                top = (score, name)
        return top

    def scan(self, text: str | None) -> tuple[str | None, float, int, list[str]]:
        """(best licence, its Dice, units that match, all licences found). A passage
        counts as a unit if most of its words aren't in units and better passages
        that match."""
        found: dict[str, float] = {}
        units = 0
        lines = [normalised(line) for line in (text or "").split("\n")]
        # the whole text, paragraphs of several lines, and lines; equal units count once
        spans, start = set(), None
        for k, words in enumerate([*lines, []]):
            if words:
                spans.add((k, k + 1))
                start = k if start is None else start
            elif start is not None:
                spans.add((start, k))
                start = None
        full = [k for k, words in enumerate(lines) if words]
        if full:
            spans.add((full[0], full[-1] + 1))
        sizes = [0]
        for words in lines:
            sizes.append(sizes[-1] + len(words))
        every = [w for words in lines for w in words]
        covered = np.zeros(len(every), bool)
        for a, b in sorted(spans):
            if self.least < sizes[b] - sizes[a] <= self.most + 1:
                top = self.best([w for words in lines[a:b] for w in words])
                if top:
                    units += 1
                    found[top[1]] = max(found.get(top[1], 0.0), top[0])
                    covered[sizes[a]:sizes[b]] = True
        for score, name, first, past in self.passages(every):
            if 2 * int(covered[first:past].sum()) < past - first:
                units += 1
                found[name] = max(found.get(name, 0.0), score)
                covered[first:past] = True
        best = min(found, key=lambda name: (-found[name], name), default=None)
        return best, found.get(best, 0.0), units, sorted(found)


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, s: Settings = Settings()) -> DataFrame:
    """(doc_id, FIELDS...): one row for each input row. Null, empty and other
    texts without a match have a null licence and a Dice of 0; repeated rows get
    equal results; an empty table gives no rows. Other columns aren't read."""
    prepared(docs)

    def scan(texts: pd.Series) -> pd.DataFrame:
        library = Library(templates, s.dice)
        return pd.DataFrame([library.scan(t) for t in texts], columns=[f.split()[0] for f in FIELDS.split(", ")])

    return docs.select("doc_id", F.pandas_udf(scan, FIELDS)("text").alias("l")).select("doc_id", "l.*")
