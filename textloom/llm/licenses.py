"""License scans by patience alignment of templates with documents.

Text and template are read as words (runs of letters and digits, lower case).
A template of m words is held against windows of 3m words, m apart, over the
whole text. In a window, words that are there once and once in the template
are anchors; the longest increasing subsequence of the anchors' places is
kept, and the gaps between them are aligned in the same way. A gap begins by
pairing equal words at its ends; where it has no anchors at all, its longest
common subsequence is taken. Coverage is the share of the template's words
that are aligned.

A window is aligned only if enough of its words are words of the template
for the coverage to be reached; this bound leaves out no match.

Defined results: all windows that reach the threshold are matches. Of matches
that overlap in the text, the one with more aligned words stays (of equals the
greater coverage, then the first template by name, then the shorter and the
first place). Each place that stays is a row, so a license may come several
times in a document; notices less than a window apart may be found as one. Null and empty texts have
no matches. Repeated rows give repeated matches. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8

TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License.",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
}

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def lis(seq: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(seq)
    for i, x in enumerate(seq):
        k = bisect_left(tails, x)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(x)
            at.append(i)
        else:
            tails[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _lcs(a: list, b: list, i0: int, j0: int) -> list[tuple[int, int]]:
    """A longest common subsequence of two short lists."""
    common = set(a) & set(b)
    x = [(i, w) for i, w in enumerate(a) if w in common]
    y = [(j, w) for j, w in enumerate(b) if w in common]
    if not x:
        return []
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, nxt, w = best[i], best[i + 1], x[i][1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = nxt[j + 1] + 1 if w == y[j][1] else max(nxt[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i][1] == y[j][1]:
            out.append((i0 + x[i][0], j0 + y[j][0]))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            out.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            out.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a: dict = {}
        for i in range(i0, i1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        in_b: dict = {}
        for j in range(j0, j1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        anchors = [(in_a[w], j) for w, j in in_b.items() if j >= 0 and in_a.get(w, -1) >= 0]
        if not anchors:
            out += _lcs(a[i0:i1], b[j0:j1], i0, j0)
            continue
        anchors.sort(key=lambda p: p[1])
        kept = [anchors[k] for k in lis([i for i, _ in anchors])]
        out += kept
        edges = [(i0 - 1, j0 - 1), *kept, (i1, j1)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:]) if q[0] - p[0] > 1 and q[1] - p[1] > 1]
    out.sort()
    return out


def windows(n: int, m: int) -> Iterator[tuple[int, int]]:
    """Windows of 3m words, m apart, over n words."""
    start = 0
    while True:
        yield start, min(n, start + 3 * m)
        if start + 3 * m >= n:
            return
        start += m


class Scanner:
    """Templates as numbers of words, with the bounds by which windows are left out."""

    #: Words that are too frequent to tell anything; a bound counts them as always there.
    FREQUENT = frozenset("the of and to a in is or for this at you any be by with on it as".split())

    def __init__(self, templates: Mapping[str, str], coverage: float):
        self.coverage = coverage
        self.number: dict[str, int] = {}
        self.templates: list[tuple[str, list[int]]] = []
        for name in sorted(templates):
            w = words_of(templates[name])
            if w:
                self.templates.append((name, [self.number.setdefault(x, len(self.number)) for x in w]))
        frequent = {self.number[w] for w in self.FREQUENT if w in self.number}
        self.rare = np.zeros((len(self.templates), len(self.number) + 1), dtype=bool)
        self.least = []
        for k, (_, t) in enumerate(self.templates):
            self.rare[k, [x for x in t if x not in frequent]] = True
            self.least.append(self.need(len(t)) - sum(x in frequent for x in t))
        self.weight = self.rare.any(axis=0)

    def need(self, m: int) -> int:
        """Aligned words at which the coverage is reached."""
        return next(x for x in range(m + 1) if x / m >= self.coverage)

    def matches(self, doc: list[int], k: int, hits: np.ndarray | None = None) -> Iterator[tuple]:
        """(aligned, first, last) of each window that reaches the coverage; hits: places of the template's rare words."""
        t = self.templates[k][1]
        m = len(t)
        for start, end in windows(len(doc), m):
            if hits is not None and np.searchsorted(hits, end) - np.searchsorted(hits, start) < self.least[k]:
                continue
            pairs = patience(doc[start:end], t)
            if len(pairs) >= self.need(m):
                yield len(pairs), start + pairs[0][0], start + pairs[-1][0]

    def best(self, doc: list[int], k: int, hits: np.ndarray | None = None) -> tuple | None:
        """The first match of most aligned words."""
        return max(self.matches(doc, k, hits), key=lambda f: f[0], default=None)

    def candidates(self, text: str | None) -> Iterator[tuple]:
        """Number of a template, the text's words as numbers, and hits, of each template that the text may have."""
        words = words_of(text)
        get = self.number.get
        none = len(self.number)
        ids = [get(w, none) for w in words]
        arr = np.fromiter(ids, dtype=np.int32, count=len(ids))
        places = np.flatnonzero(self.weight[arr]) if len(ids) else arr
        if not len(places):
            return
        kinds = arr[places]
        for k in range(len(self.templates)):
            hits = places[self.rare[k, kinds]] if self.least[k] > 0 else None
            # Words of no template are unlike each other: none of them can be an anchor.
            if hits is None or len(hits) >= self.least[k]:
                yield k, ids, hits

    def row(self, k: int, match: tuple) -> tuple:
        return self.templates[k][0], match[0] / len(self.templates[k][1]), *match

    def scan(self, text: str | None) -> list[tuple]:
        """(license, coverage, aligned, first, last) of each template's best match alone, where no other's is stronger."""
        return strongest([self.row(k, b) for k, ids, hits in self.candidates(text) if (b := self.best(ids, k, hits))])

    def scan_all(self, text: str | None) -> list[tuple]:
        """The same of each place, of all matches."""
        return strongest(list({self.row(k, b) for k, ids, hits in self.candidates(text) for b in self.matches(ids, k, hits)}))


def strongest(found: list[tuple]) -> list[tuple]:
    kept: list[tuple] = []
    firsts, lasts = [], []  # of those kept, in order; they don't overlap
    for f in sorted(found, key=lambda f: (-f[2], -f[1], f[0], f[4] - f[3], f[3])):
        i = bisect_right(firsts, f[4])
        if not i or lasts[i - 1] < f[3]:
            kept.append(f)
            firsts.insert(i, f[3])
            lasts.insert(i, f[4])
    return sorted(kept)


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, aligned (words), first and last (places of words in the text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("aligned", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(templates, coverage)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in s.scan_all(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, license string, coverage double, aligned long, first long, last long")
