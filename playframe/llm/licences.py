"""Licence texts in documents by the Dice coefficient over word bigrams.

Text is normalised to lower-case words. Every line, every paragraph (lines up to a
blank one) and the whole text is compared with the templates. Dice is
2 * shared / (a + b) over the multisets of bigrams, so a template of size b can
reach the threshold t with a segment of size a only if
a * t / (2 - t) <= b <= a * (2 - t) / t: sizes prune the candidates. A segment that
shares too few bigrams with all templates together needs no comparison either.
Both bounds are exact.

Runs of words anywhere in the text, within a line or over lines and paragraphs, are
compared as windows of every size a template allows. If h bigrams of a window of a
occur in a template, 2 * shared - t * (a + b) is at most (2 - t) * h - t * (a - h) - t * b,
so no window reaches the threshold where no run of bigrams, worth 2 - t each if the
template has them and -t if not, sums to t * b. A running sum finds that, first for
all templates of like size together, then for each of them; only where it holds are
the windows from each such bigram measured. This bound is exact too.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

THRESHOLD = 0.8
#: Window ends measured at a time.
CELLS = 1 << 19
#: Slack of bounds in floating point.
SLACK = 1e-6

#: The notices by which texts are commonly put under a licence.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 "
        "as published by the Free Software Foundation.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    (
        "EPL-1.0",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
        "which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0."),
    ("EPL-1.0", "Licensed under the Eclipse Public License 1.0."),
    (
        "GFDL-1.3",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 "
        "or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ),
)


def _gnu(what: str, name: str, version: str) -> tuple[str, str]:
    """The notice of a GNU licence, its first sentence and the whole of it."""
    first = (
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )
    return first, (
        f"{first} This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. "
        f"You should have received a copy of the GNU {name} General Public License along with this {what}. If not, see <https://www.gnu.org/licenses/>."
    )


GNU = tuple(
    (licence, notice)
    for licence, what, name, version in (
        ("GPL-2.0", "program", "", "2"),
        ("GPL-3.0", "program", "", "3"),
        ("LGPL-2.1", "library", "Lesser", "2.1"),
        ("LGPL-3.0", "library", "Lesser", "3"),
        ("AGPL-3.0", "program", "Affero", "3"),
    )
    for notice in _gnu(what, name, version)
)
COMMONS = tuple(
    (f"CC-{code}-{version.split()[0]}", notice)
    for code, name in (
        ("BY", "Attribution"),
        ("BY-SA", "Attribution-ShareAlike"),
        ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
    for version in ("4.0 International", "3.0 Unported")
    for notice in (
        f"Licensed under CC {code} {version.split()[0]}.",
        f"This work is licensed under CC {code} {version.split()[0]}.",
        f"This work is licensed under a Creative Commons {name.replace('Derivatives', 'Derivs') if version[0] == '3' else name} {version} License.",
    )
)
#: Published texts of whole licences, a file each by the licence's SPDX name.
TEXTS = tuple(sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in (files(__package__) / "licence_texts").iterdir() if f.name.endswith(".txt")))
TEMPLATES = (*NOTICES, *GNU, *COMMONS, *TEXTS)

WORD = re.compile(r"\w+")
BLANK = re.compile(r"\n[^\S\n]*\n")


class Scanner:
    """Templates by size, ready for comparison."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold = threshold
        known = sorted(((self.bigrams(WORD.findall(t.lower())), name) for name, t in templates), key=lambda x: sum(x[0].values()))
        self.templates = [(sum(c.values()), c, name) for c, name in known if c]
        self.sizes = [n for n, _, _ in self.templates]
        self.vocabulary = frozenset(b for _, c, _ in self.templates for b in c)
        #: Bigrams by number from 1 (0: in no template), how often each template has them, and the sizes' powers of two in which they occur, as bits.
        self.numbers = {b: i for i, b in enumerate(sorted(self.vocabulary), 1)}
        self.times = np.zeros((len(self.templates), len(self.numbers) + 1), np.int32)
        self.powers = np.zeros(len(self.numbers) + 1, np.int32)
        self.classes: dict[int, list[int]] = {}
        for k, (size, template, _) in enumerate(self.templates):
            own = [self.numbers[b] for b in template]
            self.times[k, own] = list(template.values())
            self.powers[own] |= 1 << size.bit_length()
            self.classes.setdefault(size.bit_length(), []).append(k)

    @staticmethod
    def bigrams(words: list[str]) -> Counter:
        return Counter(zip(words, words[1:]))

    def best(self, words: list[str]) -> tuple[str, float] | None:
        """The template most like the segment, if it reaches the threshold; the smaller and then the earlier template wins ties."""
        n, t = len(words) - 1, self.threshold
        if n < 1:
            return None
        lo, hi = bisect.bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect.bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        if lo == hi or sum(b in self.vocabulary for b in zip(words, words[1:])) < t * (n + self.sizes[lo]) / 2 - 1e-9:
            return None
        own, top = self.bigrams(words), None
        for size, template, name in self.templates[lo:hi]:
            dice = 2 * sum(min(k, own[b]) for b, k in template.items()) / (n + size)
            if dice >= t and (top is None or dice > top[1]):
                top = (name, dice)
        return top

    def _reach(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per bigram, at most what a window from it sums to, and whether it occurs in the template."""
        total = np.cumsum(np.where(hit, 2 - self.threshold, -self.threshold))
        before = np.concatenate(([0.0], total[:-1]))
        return np.maximum.accumulate(total[::-1])[::-1] - before, hit

    def _likely(self, ids: np.ndarray) -> list[int]:
        """Templates of which the text may hold a window."""
        t, powers, likely = self.threshold, self.powers[ids], []
        for power, own in self.classes.items():
            hit, need = powers >> power & 1 > 0, t * self.templates[own[0]][0] - SLACK
            if np.count_nonzero(hit) * (2 - t) >= need and self._reach(hit)[0].max() >= need:
                likely += [k for k in own if self._reach(self.times[k][ids] > 0)[0].max() >= t * self.templates[k][0] - SLACK]
        return likely

    def _ends(self, k: int, hit: np.ndarray, earlier: np.ndarray, starts: np.ndarray, limit: int) -> Iterator[tuple[float, float, int, int]]:
        """Per start (excess, dice, start, end) of the window before ``limit`` with the most excess, 2 * shared - t * (a + b), if it reaches the threshold."""
        size, t = self.templates[k][0], self.threshold
        most = min(int(size * (2 - t) / t + 1e-9), limit - int(starts.min()))
        for lo in range(0, len(starts), max(1, CELLS // most)):
            part = starts[lo : lo + max(1, CELLS // most), None]
            at = part + np.arange(most)
            there = at < limit
            at[~there] = 0
            shared = np.cumsum(hit[at] & (earlier[at] < part) & there, axis=1)
            sizes = np.arange(1, most + 1) + size
            excess = np.where(there, 2 * shared - t * sizes, -np.inf)
            best = excess.argmax(axis=1)
            row = np.arange(len(part))
            dice = 2 * shared[row, best] / sizes[best]
            for i in np.flatnonzero(dice >= t).tolist():
                yield round(float(excess[i, best[i]]), 6), float(dice[i]), int(part[i, 0]), int(part[i, 0] + best[i] + 1)

    def windows(self, ids: np.ndarray, likely: list[int]) -> list[tuple[int, int, int, float]]:
        """(template, first bigram, end, dice) of windows that don't overlap: that with the most excess, then the same in what is left of the text.

        Of equal ones the smaller template, the earlier template and the earlier window win.
        """
        parts, queue = {}, []
        for k in likely:
            times = self.times[k][ids]
            hit = times > 0
            #: The place at which the bigram last stood as many places of its own ago as the template has it: from there on, one more is not shared.
            order = np.argsort(ids, kind="stable")
            back = np.arange(len(ids)) - times[order]
            same = (back >= 0) & (ids[order[np.maximum(back, 0)]] == ids[order])
            earlier = np.full(len(ids), -1)
            earlier[order] = np.where(same, order[np.maximum(back, 0)], -1)
            parts[k] = hit, earlier
            starts = np.flatnonzero(hit & (self._reach(hit)[0] >= self.threshold * self.templates[k][0] - SLACK))
            if len(starts):
                queue += [(-excess, k, a, z, dice) for excess, dice, a, z in self._ends(k, hit, earlier, starts, len(ids))]
        heapq.heapify(queue)
        taken: list[tuple[int, int]] = []
        found = []
        while queue:
            _, k, a, z, dice = heapq.heappop(queue)
            i = bisect.bisect_right(taken, (a, len(ids)))
            #: A window of bigrams a to z - 1 has the words a to z.
            if i and a <= taken[i - 1][1]:
                continue
            limit = taken[i][0] - 1 if i < len(taken) else len(ids)
            if z <= limit:
                taken.insert(i, (a, z))
                found.append((k, a, z, dice))
            elif a < limit:
                for excess, d, _, end in self._ends(k, *parts[k], np.array([a]), limit):
                    heapq.heappush(queue, (-excess, k, a, end, d))
        return sorted(found, key=lambda x: x[1])

    def matches(self, text: str) -> list[tuple[str, str, int, int, float]]:
        """(licence, level, first character, end, dice). A paragraph of one line and a text of one paragraph count once, at the lower level.

        A window inside a line, paragraph or text found with its licence is not given again.
        """
        low = text.lower()
        words = WORD.findall(low)
        ids = np.fromiter(map(self.numbers.get, zip(words, words[1:]), repeat(0)), np.int64, max(0, len(words) - 1))
        #: Lines, paragraphs and the text are windows too.
        likely = self._likely(ids) if ids.any() else []
        if not likely:
            return []
        found = []

        def compare(level: str, start: int, end: int) -> None:
            top = self.best(WORD.findall(text[start:end].lower()))
            if top:
                found.append((top[0], level, start, end, top[1]))

        def lines(start: int, end: int) -> int:
            n, at = 0, start
            while at <= end:
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop
                compare("line", at, stop)
                n, at = n + 1, stop + 1
            return n

        paragraphs, at = 0, 0
        for m in [*BLANK.finditer(text), None]:
            end = m.start() if m else len(text)
            if lines(at, end) > 1:
                compare("paragraph", at, end)
            paragraphs, at = paragraphs + 1, m.end() if m else len(text)
        if paragraphs > 1:
            compare("text", 0, len(text))
        spans = [m.span() for m in WORD.finditer(low)]
        #: Lower case can be longer than the character.
        place = range(len(text) + 1) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        whole = list(found)
        for k, a, z, dice in self.windows(ids, likely):
            name, start, end = self.templates[k][2], place[spans[a][0]], place[spans[z][1] - 1] + 1
            if not any(name == n and s <= start and end <= e for n, _, s, e, _ in whole):
                found.append((name, "window", start, end, dice))
        return found


SCHEMA = "licence string, level string, first_char long, end_char long, dice double"


def scan(df: DataFrame, row_id: str = "doc_id", text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per segment that reaches the threshold: the id, ``licence``, ``level``, ``first_char``, ``end_char`` and ``dice``.

    Levels are line, paragraph, text and window, a run of words in any place. Per
    segment the best template counts. Null and empty texts, and segments of fewer
    than two words, match nothing. Repeated rows give repeated results. An empty table
    gives no rows. Only the id and the text are read.
    """
    kind = df.select(F.col(f"`{row_id}`").alias("id")).dtypes[0][1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in slices(batches):
            rows, at = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                own = scanner.matches(t) if t else []
                rows += own
                at += [i] * len(own)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", *(x.split()[0] for x in SCHEMA.split(", "))])

    return df.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(task, f"id {kind}, {SCHEMA}").withColumnRenamed("id", row_id)
