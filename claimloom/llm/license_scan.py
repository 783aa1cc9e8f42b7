"""License scans by Dice coefficient over word bigrams.

Texts and templates are normalised (lower case, words of letters and
digits); a window of a text is compared with a template by twice the
number of shared bigrams (repeats count) over the sum of both numbers.
A coefficient of t needs sizes within t / (2 - t) of each other and so
a least number of shared bigrams; the best windows start and end with
one.  So windows slide over the whole text, from bigram of the template
to bigram of the template, wherever enough of them lie close together;
lines and paragraphs do not matter, and a whole text is a window too.
Of overlapping matches that stays which shares most beyond the least.
Templates are usual notices and the full texts in ``licenses/``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from functools import lru_cache
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimloom.llm.common import map_batches

#: Least coefficient of a match.
DICE = 0.8

# Texts of public licences and their usual notices.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ],
}

_GNU = (
    "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public "
    "License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any "
    "later version."
)
_GNU_ONE_LINE = "This work is licensed under the GNU {0} General Public License, version {1}."
#: More notices.
NOTICES = {
    "AGPL-3.0": [_GNU.format("program", "Affero", "3"), _GNU_ONE_LINE.format("Affero", "3")],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "GPL-2.0": [_GNU.format("program", "", "2"), _GNU_ONE_LINE.format("", "2")],
    "ISC": ["Released under the ISC License."],
    "LGPL-2.1": [_GNU.format("library", "Lesser", "2.1"), _GNU_ONE_LINE.format("Lesser", "2.1")],
    "LGPL-3.0": [_GNU.format("library", "Lesser", "3"), _GNU_ONE_LINE.format("Lesser", "3")],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Licences whose full text is in ``licenses/``.
FULL = (
    "Apache-2.0", "Artistic-1.0-Perl", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense",
)


@lru_cache(maxsize=1)
def all_templates() -> dict[str, list[str]]:
    """Notices and full texts by licence."""
    out = {name: list(ts) for name, ts in TEMPLATES.items()}
    for name, ts in NOTICES.items():
        out.setdefault(name, []).extend(ts)
    for name in FULL:
        out.setdefault(name, []).append(get_data("claimloom.llm", f"licenses/{name}.txt").decode())
    return out


WORDS = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter[tuple[str, str]]:
    """Bigrams of the normalised words, with repeats."""
    w = WORDS.findall(text.lower())
    return Counter(zip(w, w[1:]))


class Templates:
    """Templates by number of bigrams."""

    def __init__(self, texts: dict[str, list[str]] | None = None, dice: float = DICE):
        self.dice = dice
        self.all = [(name, b, b.total()) for name, ts in sorted((texts or all_templates()).items()) for b in map(bigrams, ts) if b]
        self.ratio = dice / (2 - dice)
        self.least = min((n for _, _, n in self.all), default=1) * self.ratio
        self.most = max((n for _, _, n in self.all), default=0) / self.ratio
        # bigrams by number; their count in each template; shared bigrams that a match needs
        self.number = {g: i for i, g in enumerate(sorted({g for _, b, _ in self.all for g in b}))}
        self.counts = np.zeros((len(self.number), len(self.all)), np.int16)
        for t, (_, b, _) in enumerate(self.all):
            for g, n in b.items():
                self.counts[self.number[g], t] = n
        self.needed = np.array([math.ceil(dice / 2 * (1 + self.ratio) * n - 1e-9) for _, _, n in self.all], np.int64)

    def best(self, text: str) -> tuple[float, str] | None:
        """Best coefficient and licence, ties to the first name."""
        w = WORDS.findall(text.lower())
        n = len(w) - 1
        if not self.least <= n <= self.most:
            return None
        b = Counter(zip(w, w[1:]))
        found = None
        for name, t, size in self.all:
            if min(n, size) < self.ratio * max(n, size):
                continue  # the size alone rules it out
            d = 2 * (b & t).total() / (n + size)
            if d >= self.dice and (found is None or d > found[0]):
                found = d, name
        return found

    def windows(self, at: np.ndarray, grams: np.ndarray, t: int) -> list[tuple[float, int, int, int]]:
        """Matches of template ``t``, none overlapping: coefficient, shared
        bigrams, first and last bigram; from its bigrams and their places."""
        size, need = self.all[t][2], int(self.needed[t])
        caps = self.counts[grams, t]
        starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] + 1 <= size / self.ratio + 1e-9)
        if not len(starts):
            return []
        # a repeat counts unless the template's number of them lies between it and the start
        seen: dict[int, list[int]] = {}
        before = np.full(len(at), -1)
        for i, (g, c) in enumerate(zip(grams.tolist(), caps.tolist())):
            x = seen.setdefault(g, [])
            if len(x) >= c:
                before[i] = x[-c]
            x.append(i)
        found = []
        ends = np.searchsorted(at, at[starts] + size / self.ratio, "left")
        for s, e in zip(starts.tolist(), ends.tolist()):
            shared = np.cumsum(before[s:e] < s)
            d = 2 * shared / (at[s:e] - at[s] + 1 + size)
            j = int(d.argmax())
            if d[j] >= self.dice:
                found.append((float(d[j]), int(shared[j]), int(at[s]), int(at[s + j])))
        return _apart(sorted(found, key=lambda x: (-x[0], x[2])), 2)

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """Matches in the order of the text: number of the line in which
        the window starts, licence, coefficient."""
        low = (text or "").lower()
        w = WORDS.findall(low)
        if not self.all or len(w) - 1 < self.least:
            return []
        hits = [(i, g) for i, g in enumerate(map(self.number.get, zip(w, w[1:]))) if g is not None]
        if len(hits) < self.needed.min():
            return []
        at, grams = np.array(hits).T
        of = self.counts[grams] > 0
        found = []
        for t in np.flatnonzero(of.sum(0) >= self.needed).tolist():
            name, _, size = self.all[t]
            for d, shared, s, e in self.windows(at[of[:, t]], grams[of[:, t]], t):
                found.append((shared - self.dice / 2 * (e - s + 1 + size), d, name, s, e))
        if not found:
            return []
        kept = sorted(_apart(sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])), 3), key=lambda x: x[3])
        places = [m.start() for m in WORDS.finditer(low)]
        return [(low.count("\n", 0, places[s]), name, d) for _, d, name, s, _ in kept]


def _apart(found: list, k: int) -> list:
    """Those that overlap no earlier one; places ``k`` and ``k + 1`` of
    each are the first and last bigram."""
    starts: list[int] = []
    out: list = []
    for x in found:
        i = bisect(starts, x[k + 1])
        if i == 0 or out[i - 1][k + 1] < x[k]:
            starts.insert(i, x[k])
            out.insert(i, x)
    return out


def license_scan(
    docs: DataFrame, templates: Templates | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, ``n_matches``, ``licenses`` (distinct names, sorted,
    comma-joined), ``best_dice`` (0 without a match).

    Whole texts; null and empty texts have no match; repeated rows give a
    row each; other columns are left alone.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def make():
        t = templates or Templates()

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            found = [t.scan(x) for x in batch.column(1).to_pylist()]
            return {
                id_col: batch.column(0), "n_matches": list(map(len, found)),
                "licenses": [",".join(sorted({n for _, n, _ in f})) for f in found],
                "best_dice": [max((d for _, _, d in f), default=0.0) for f in found],
            }

        return run

    return map_batches(
        docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_matches bigint, licenses string, best_dice double"
    )
