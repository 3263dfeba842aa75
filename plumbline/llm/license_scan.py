"""License scans: windows of words are compared with license templates by the Dice coefficient of their word bigrams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, mix, slices, span_hashes, word_spans

DICE = 0.8

#: Notices as their licenses word them, by SPDX identifier where there is one.
TEMPLATES: dict[str, Sequence[str]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",),
    "proprietary": ("All rights reserved.",),
}

#: Whole licenses, each a text as published, by SPDX identifier.
FOLDER = Path(__file__).parent / "licenses"


def all_templates(folder: Path = FOLDER) -> dict[str, list[str]]:
    """TEMPLATES and the whole licenses of the folder."""
    out = {name: list(texts) for name, texts in TEMPLATES.items()}
    for path in sorted(folder.glob("*.txt")):
        out.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return out


#: Normal form: letters and digits, A-Z lower-cased; other ASCII divides words, other bytes belong to them.
IS_PART = np.zeros(256, dtype=bool)
IS_PART[48:58] = IS_PART[65:91] = IS_PART[97:123] = IS_PART[128:] = True

FOUND = "doc_id long, n_matches long, best_license string, best_dice double, licenses string, matches array<struct<license:string,dice:double,first_line:int,last_line:int>>"


def bigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the bigrams that begin at each word (the last word of a row has none: 0), word starts, row bounds."""
    data = LOWER[data]
    start, end, first = word_spans(data, at, IS_PART)
    words = span_hashes(data, start, end)
    pairs = np.zeros(len(words), dtype=np.uint64)
    pairs[:-1] = mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:]) | np.uint64(1)
    pairs[first[1:][first[1:] > 0] - 1] = 0
    return pairs, start, first


class Templates:
    """Distinct bigrams of the templates (sorted hashes), their lengths in bigrams, and the union of all."""

    def __init__(self, texts: Mapping[str, Sequence[str]]):
        self.names, self.sets, self.lengths = [], [], []
        for name, variants in texts.items():
            for text in variants:
                raw = text.encode()
                pairs, _, _ = bigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                if len(pairs) > 1:
                    self.names.append(name)
                    self.sets.append(np.unique(pairs[:-1]))
                    self.lengths.append(len(pairs) - 1)
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)


def within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values if len(sorted_values) else np.zeros(len(values), bool)


def distinct_in_windows(before: np.ndarray, width: int, counts: np.ndarray) -> np.ndarray:
    """For each window of width places, the number of different values at the places that count. before: the place of
    the same value before each place, or -1."""
    place = np.flatnonzero(counts)
    if width >= len(before):
        return np.array([int((before[place] < 0).sum())])
    # a place is the first of its value in the windows that begin after the one before it and not after itself
    low, high = np.maximum(before[place] + 1, place - width + 1), np.minimum(place, len(before) - width)
    low, high = low[low <= high], high[low <= high]
    change = np.bincount(low, minlength=len(before) + 1) - np.bincount(high + 1, minlength=len(before) + 1)
    return np.cumsum(change)[: len(before) - width + 1]


def windows_of(pairs: np.ndarray, templates: Templates, least: float) -> list[tuple[str, float, int, int]]:
    """License, Dice, first and last word of the best windows of a row's bigrams, line ends being no bounds.

    A window has as many bigrams as the template (or all, if the row has fewer); its Dice is that of the two sets of
    distinct bigrams. Of windows that overlap the better counts, then that of the longer template, then of the one that
    comes first, then the earlier.
    Bounds: at Dice d with a template of b distinct bigrams, a row shares d / (2 - d) * b of them at least. Linear in
    the row for each template that it shares so many with.
    """
    order = np.argsort(pairs, kind="stable")
    before = np.full(len(pairs), -1)
    same = pairs[order[1:]] == pairs[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    ones, own = np.ones(len(pairs), dtype=bool), pairs[before < 0]
    met = own[within(templates.known, own)]
    found = []
    for k, template in enumerate(templates.sets):
        low = least / (2 - least) * len(template) - 1e-9
        if len(met) < low or within(template, met).sum() < low:
            continue
        width = templates.lengths[k]
        shared = distinct_in_windows(before, width, within(template, pairs))
        dice = 2 * shared / (distinct_in_windows(before, width, ones) + len(template))
        found += [(-dice[i], -width, k, i, min(i + width, len(pairs))) for i in np.flatnonzero(dice >= least - 1e-12).tolist()]
    starts, ends, chosen = [], [], []
    for dice, _, k, first, last in sorted(found):  # windows cover the words from first to last
        i = bisect_left(starts, first)
        if (i == len(starts) or starts[i] > last) and (i == 0 or ends[i - 1] < first):
            starts.insert(i, first)
            ends.insert(i, last)
            chosen.append((templates.names[k], -float(dice), first, last))
    return sorted(chosen, key=lambda x: x[2])


def scanner(texts: Mapping[str, Sequence[str]], least: float):
    def scan(batches):
        templates = Templates(texts)
        for batch in batches:
            matches: list[list[tuple[str, float, int, int]]] = []
            for _, data, at in slices(batch.column("text")):
                pairs, start, first = bigrams(data, at)
                hits = np.concatenate([[0], np.cumsum(within(templates.known, pairs))])
                breaks = np.flatnonzero(data == 10)
                for row in range(len(at) - 1):
                    if hits[first[row + 1]] == hits[first[row]]:
                        matches.append([])
                        continue
                    inner = breaks[np.searchsorted(breaks, at[row]) : np.searchsorted(breaks, at[row + 1])]
                    line = lambda word: int(np.searchsorted(inner, start[first[row] + word]))  # noqa: B023, E731
                    matches.append([(name, dice, line(a), line(z)) for name, dice, a, z in windows_of(pairs[first[row] : first[row + 1] - 1], templates, least)])
            best = [max(m, key=lambda x: x[1]) if m else None for m in matches]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(m) for m in matches], pa.int64()),
                    pa.array([b and b[0] for b in best], pa.string()),
                    pa.array([b and b[1] for b in best], pa.float64()),
                    pa.array([",".join(sorted({x[0] for x in m})) for m in matches], pa.string()),
                    pa.array([[dict(zip(("license", "dice", "first_line", "last_line"), x, strict=True)) for x in m] for m in matches], pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))),
                ],
                ["doc_id", "n_matches", "best_license", "best_dice", "licenses", "matches"],
            )

    return scan


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] | None = None, least: float = DICE) -> DataFrame:
    """doc_id, n_matches, best_license, best_dice, licenses, matches for each row of docs, over whole texts.

    matches are windows of words that don't overlap, as windows_of() has them, with the lines (numbered from 0, split at new
    lines) where they begin and end; licenses are their distinct names, sorted, joined by commas. A null or empty text,
    or one of a single word, has no match: best_license and best_dice are null. Repeated rows are alike, null ids stay,
    further columns go. An empty table gives no rows. templates: all_templates() if not given; they have some twenty
    thousand bigrams, which tasks get with their code; nothing is shuffled.
    """
    return docs.select("doc_id", "text").mapInArrow(scanner(templates or all_templates(), least), FOUND)
