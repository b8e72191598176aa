"""License scans: MinHash bands retrieve templates, shingle containment verifies.

Texts and templates become words of letters and digits (lower case) and
shingles of five words. Templates are grouped by size: class L (a power of two)
holds those of more than L/2 and at most L distinct shingles. Windows of 2L
shingles every L/2 cover the text, so an occurrence of up to 1.5L shingles lies
whole in one. Its Jaccard similarity with the window is then at least
0.8 * L/2 / (2L + 0.1L), about 0.19; with one-row bands, ``BANDS`` of them let a
true match through with probability 0.9999. Windows without any template
shingle cannot verify and are not hashed. A retrieved template matches if at
least 0.8 of its shingles are in the window; overlapping matches of one
template are reported once, the fullest first, and a partial match that overlaps
a fuller one of a template as large is left out.

The templates are a parameter on the driver (at most ``MOST_TEMPLATE_BYTES``),
sent to the tasks with the code; nothing is shuffled.

Defined cases: null and empty texts match nothing; a template of fewer than
five words is refused; a text of any length is scanned whole; every occurrence
is reported, in repeated rows too; spans are code points, end exclusive; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U64, chunks, mix, prepare, raw, shingles, table, text_col, words

SHINGLE, CONTAINED = 5, 0.8
LEAST_LIKENESS, RETRIEVED = CONTAINED * 0.5 / 2.1, 0.9999
BANDS = math.ceil(math.log(1 - RETRIEVED) / math.log(1 - LEAST_LIKENESS))
MOST_TEMPLATE_BYTES = 32 << 20

# License notices by SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_SPELLED = np.array([i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 or 48 <= i <= 57 else 32 for i in range(256)], np.uint8)
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def bands(values: np.ndarray) -> np.ndarray:
    """[BANDS] least hash of the shingles under each seed."""
    return np.array([mix(values ^ s).min() for s in _SEEDS], U64)


def tight(places: list[int], values: list[int], size: int) -> list[tuple[int, int, float]]:
    """(first, last, share) of disjoint stretches that hold 0.8 of a template's
    ``size`` shingles: the shortest one with all that are there, then the same
    to its left and right."""
    need = len(set(values))
    if need < CONTAINED * size:
        return []
    held: dict[int, int] = {}
    best, i = None, 0
    for j, v in enumerate(values):
        held[v] = held.get(v, 0) + 1
        while held[values[i]] > 1:
            held[values[i]] -= 1
            i += 1
        if len(held) == need and (best is None or places[j] - places[i] < places[best[1]] - places[best[0]]):
            best = (i, j)
    i, j = best
    return (tight(places[:i], values[:i], size) + [(places[i], places[j], need / size)]
            + tight(places[j + 1:], values[j + 1:], size))


class Templates:
    """Shingle sets, size classes and band tables of the templates."""

    def __init__(self, templates: list[tuple[str, str]]):
        if sum(len(t.encode()) for _, t in templates) > MOST_TEMPLATE_BYTES:
            raise ValueError("too many templates for the driver")
        self.names = [n for n, _ in templates]
        self.texts = [t for _, t in templates]
        w, doc, _, _ = words(pa.array(self.texts, pa.string()), _SPELLED)
        s, at, _ = shingles(w, doc, SHINGLE)
        if (np.diff(doc) < SHINGLE).any():
            raise ValueError(f"a template needs {SHINGLE} words")
        self.sets = [np.unique(s[a:b]) for a, b in zip(at, at[1:])]
        self.vocabulary = np.unique(s)
        self.tables: dict[int, dict[tuple[int, int], list[int]]] = {}
        for k, own in enumerate(self.sets):
            size = 1 << (len(own) - 1).bit_length()
            by_band = self.tables.setdefault(size, {})
            for i, v in enumerate(bands(own).tolist()):
                by_band.setdefault((i, v), []).append(k)

    def matches(self, s: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, last shingle, containment) in one text's shingles."""
        place = np.minimum(np.searchsorted(self.vocabulary, s), len(self.vocabulary) - 1)
        hits = np.flatnonzero(self.vocabulary[place] == s)
        found: list[tuple[int, int, int, float]] = []
        for size, by_band in self.tables.items() if len(hits) else ():
            step = max(1, size // 2)
            width = 2 * size
            last = hits // step  # windows k * step that hold a hit
            starts = np.unique(np.concatenate([last - d for d in range(-(-width // step))]))
            for a in (starts[starts >= 0] * step).tolist():
                own = s[a:a + width]
                near = {k for key in enumerate(bands(own).tolist()) for k in by_band.get(key, ())}
                for k in near:
                    inside = np.flatnonzero(np.isin(own, self.sets[k]))
                    found += [(k, a + i, a + j, share) for i, j, share in tight(inside.tolist(), own[inside].tolist(), len(self.sets[k]))]
        return self.plainest(self.fullest(found))

    def plainest(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Without partial matches that overlap a fuller one of a template as large
        (sister notices that differ in a version)."""
        out, reach = [], []
        for m in sorted(found, key=lambda m: -m[3]):
            n = len(self.sets[m[0]])
            if not any(o[3] > m[3] and o[1] <= m[2] and m[1] <= o[2] and len(self.sets[o[0]]) >= n for o in reach):
                out.append(m)
            if m[3] > CONTAINED:
                reach.append(m)
        return sorted(out, key=lambda m: (m[1], m[0]))

    def fullest(self, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
        """Of overlapping matches of a template the fullest, then shortest, then first."""
        out: dict[int, list] = {}
        for m in sorted(set(found), key=lambda m: (m[0], -m[3], m[2] - m[1], m[1])):
            if all(m[2] < o[1] or m[1] > o[2] for o in out.setdefault(m[0], [])):
                out[m[0]].append(m)
        return sorted((m for own in out.values() for m in own), key=lambda m: (m[1], m[0]))


SCHEMA = "doc_id long, license string, template int, span_start long, span_end long, containment double"


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per match: its document, license, template number and span."""
    Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = []
            for part in chunks(batch, "text"):
                texts = part.column("text")
                data, begin = raw(texts)
                w, doc, lo, hi = words(texts, _SPELLED)
                s, at, first = shingles(w, doc, SHINGLE)
                place = np.minimum(np.searchsorted(known.vocabulary, s), len(known.vocabulary) - 1)
                has = np.unique(np.searchsorted(at, np.flatnonzero(known.vocabulary[place] == s), "right") - 1) if len(s) else []
                ids = part.column("doc_id")
                for d in has:
                    text = data[begin[d]:begin[d + 1]].tobytes()
                    for k, a, b, share in known.matches(s[at[d]:at[d + 1]]):
                        left, right = lo[first[at[d] + a]], hi[min(first[at[d] + b] + SHINGLE, doc[d + 1]) - 1]
                        before = len(text[:left].decode())
                        rows.append((ids[int(d)].as_py(), known.names[k], k, before, before + len(text[left:right].decode()), share))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(docs["doc_id"].cast("long"), text_col().alias("text")).mapInArrow(run, SCHEMA)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    return find_licenses(table(spark, sf_dir, "documents"))
