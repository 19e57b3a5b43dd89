"""License scans: winnowed fingerprints find candidates, banded alignment confirms them.

Texts and templates are reduced to words (letters and digits, lower case). Of every
``WINDOW`` neighbouring word 3-grams the one with the least hash is a fingerprint, so a
shared run of ``WINDOW + 2`` words shares one. The templates' fingerprints form an inverted
index of bounded size that every task holds. A fingerprint of a document found there seeds
a place of the template (position minus offset). Nearby places form a cluster, which is aligned
once: a local alignment of the template with the words around, within a band from the
cluster's least to its greatest place and a margin on both sides (a quarter of the
template's words, ``BAND`` at least; places up to two margins apart are neighbours). It
reports the share of template words matched in order and the span; the words inside are
then done, and the fingerprints outside are clustered again.

Defined cases: null or empty text has no match; a match needs ``min_coverage`` of the
template's words; where places of one template overlap, the one with most matches is kept
(ties: the first); rows that repeat an id are scanned one by one; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabvet.llm.common import frugal, rolling, rows_of, texts_of, word_hashes

GRAM, WINDOW, BAND = 3, 2, 8
MAX_TEMPLATE_WORDS = 1_000_000  # bounds the index that tasks hold
#: Wordings of common license statements and notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.encode().translate(_PLAIN) for t in texts])


def winnow(h: np.ndarray) -> np.ndarray:
    """Positions of the chosen 3-grams of word hashes; a text of fewer grams keeps its least."""
    r = rolling(h, GRAM)
    if len(r) <= WINDOW:
        return np.array([r.argmin()]) if len(r) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(r, WINDOW)
    return np.unique(views.argmin(1) + np.arange(len(views)))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [_hashes([t])[0] for t in templates.values()]
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        if any(len(w) < GRAM for w in self.words):
            raise ValueError(f"a template needs at least {GRAM} words")
        entries = sorted((int(rolling(w, GRAM)[p]), t, int(p)) for t, w in enumerate(self.words) for p in winnow(w))
        self.keys = np.array([e[0] for e in entries], np.uint64)
        self.template, self.place = (np.array([e[i] for e in entries], np.int64) for i in (1, 2))

    def seeds(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, start of the template in the document, place) of each known 3-gram."""
        r = rolling(h, GRAM)
        lo, hi = np.searchsorted(self.keys, r), np.searchsorted(self.keys, r, side="right")
        return {(int(self.template[e]), int(p - self.place[e]), int(p)) for p in np.flatnonzero(hi > lo) for e in range(lo[p], hi[p])}


def align(t: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[int, int, int]:
    """(matches, first, last) of the best in-order matching of template ``t`` with ``h`` inside
    the band of starts from ``lo`` to ``hi``; of equal ones that with the shortest span."""
    none = (0, 0, 0)  # matches, -span, first
    row = [none] * (hi - lo + 3)
    best = (0, 0, 0, 0)
    for i, w in enumerate(t):
        new = [none] * (hi - lo + 3)
        for d in range(1, hi - lo + 2):
            j = lo + i + d - 1
            up, left, diag = row[d + 1], new[d - 1], row[d]
            got = max(up, left)
            if 0 <= j < len(h) and h[j] == w:
                first = diag[2] if diag[0] else j
                got = max(got, (diag[0] + 1, first - j, first))
                best = max(best, (got[0], got[1], got[2], got[2] - got[1]))
            new[d] = got
        row = new
    return best[0], best[2], best[3]


def matches(h: np.ndarray, index: Index, band: int, min_coverage: float) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, first word, last word, matched words) of the places in a document."""
    found = []
    seeds: dict[int, list[tuple[int, int]]] = {}
    for t, start, p in index.seeds(h):
        seeds.setdefault(t, []).append((start, p))
    for t, left in seeds.items():
        words = index.words[t]
        margin, need = max(band, len(words) // 4), min_coverage * len(words)
        reach = len(words) + 2 * margin  # of one band; a longer cluster is aligned in overlapping bands
        left.sort()
        free = h.copy()  # without the words of places found
        while left:
            k, a = 1, left[0][0]
            while k < len(left) and left[k][0] - left[k - 1][0] <= 2 * margin and left[k][0] - a <= reach:
                k += 1
            whole = k == len(left) or left[k][0] - left[k - 1][0] > 2 * margin
            lo, hi = a - margin, left[k - 1][0] + margin
            if np.isin(words, free[max(lo, 0):max(hi + len(words), 0)]).sum() >= need:
                n, first, last = align(words, free, lo, hi)
                if n >= need:
                    found.append((t, n / len(words), first, last, n))
                    free[first:last + 1] = 0
                    rest = [x for x in left[:k] if not first <= x[1] <= last]
                    if len(rest) < k:
                        left = rest + left[k:]
                        continue
            left = left[k if whole else max(1, sum(x[0] <= a + reach // 2 for x in left[:k])):]
    out = []
    for f in sorted(found, key=lambda f: (f[0], -f[4], f[2])):
        if not any(f[0] == g[0] and f[2] <= g[3] and g[2] <= f[3] for g in out):
            out.append(f)
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] | None = None,
         min_coverage: float = 0.8, band: int = BAND) -> DataFrame:
    """(doc_id, template, coverage, n_matched, first_word, last_word) of each match;
    words are counted from 0 over runs of letters and digits."""
    templates = templates or TEMPLATES
    Index(templates)  # fails here rather than in a task

    def run(batches):
        index, kinds = Index(templates), [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
        for ids, texts in rows_of(batches):
            h, at = _hashes(texts)
            known = np.isin(rolling(h, GRAM), index.keys)
            sums = np.concatenate(([0], np.cumsum(known)))
            rows = []
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if b - a >= GRAM and sums[b - GRAM + 1] > sums[a]:
                    rows += [(ids[k], index.names[t], cover, n, first, last) for t, cover, first, last, n in matches(h[a:b], index, band, min_coverage)]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    names = ["doc_id", "template", "coverage", "n_matched", "first_word", "last_word"]
    return texts_of(df, id_col, text_col).mapInArrow(frugal(run), "doc_id long, template string, coverage double, n_matched long, first_word long, last_word long")
