"""Licence scans: a trained paragraph classifier, a calibrated unknown class, and confirmation by templates.

Paragraphs are what blank lines separate, so notices may be wrapped over lines. In a paragraph, the words that templates share with it
mark regions: marked word runs with small gaps, cut where a sentence or line ends and no template runs on, and widened by a few
words within their sentence. So words before and after a notice don't dilute it, and two notices side by side stay two.
A region's features are hashed word 1- to 3-grams; a softmax over the licence families, "unknown" and "none", trained
on the driver by gradient descent, gives its family. Training texts are the notices and names below in frames and surroundings made by rule, names of
invented licences in the same frames for "unknown", and for "none" a bounded sample of the corpus's own lines, the ``NONE_ROWS`` lines
with the smallest hashes among those without cue words, but for lines that share a word 3-gram with a template.

Calibration: variants that were kept out of training, with other words around them and one word left out. The threshold of a family is the least that
keeps the accepted share of what it must not accept, the notices of each family under a model that never saw the family and invented names, below ``ERROR``,
but never more than what all but ``MISSED`` of its own kept-out variants reach. A template confirms a family if the region holds
at least ``CONFIRM`` of its word 3-grams (fewer words: the whole of it) and no other family's template more; families that the region names in full besides are reported with it. A region that is likelier a
licence than not, but isn't sure or isn't confirmed, is "unknown".

Words: A-Z lower-cased, runs of ASCII letters and digits and everything beyond ASCII. Null texts have no paragraphs; long ones are read
whole; of equally likely families the first by name is taken. Equal rows
are handled separately. An empty table gives an empty one. Columns other than the two named ones are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ALNUM, Words, lean, raw, table

_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_OLD = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; version {2} of the License."
_GIVEN = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_CC = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
# The families' names, and the notices that their licences tell to use.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPL-3.0", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache Software License 2.0", "Apache-2.0"],
    "bsd": ["BSD License", "BSD-style license", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "Simplified BSD License", "License: BSD"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "isc": ["ISC License", "ISC licence", "License: ISC"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPL-2.1", "LGPLv2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"],
    "mit": ["MIT License", "MIT licence", "Expat License", "License: MIT"],
    "mpl-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
}
NOTICES = {
    "agpl-3.0": ["This program is free software under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License v3.0.", _GNU.format("program", "Affero General Public License", 3), "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This file is distributed under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", _CC.format(""), "SPDX-License-Identifier: CC-BY-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("-NonCommercial"), "SPDX-License-Identifier: CC-BY-NC-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("-ShareAlike"), "SPDX-License-Identifier: CC-BY-SA-4.0", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the GNU GPL v2.", _GNU.format("program", "General Public License", 2), _GNU_OLD.format("program", "General Public License", 2), "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3.", _GNU.format("program", "General Public License", 3), _GNU_OLD.format("program", "General Public License", 3), "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "lgpl-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL v2.1.", _GNU.format("library", "Lesser General Public License", 2.1), "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", _GIVEN],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
}
# Words that keep a line out of the sample of ordinary ones; frames for names; words to put around notices in training and in calibration.
CUES = ("license", "licensed", "licence", "licenced", "copyright", "spdx", "redistribution", "permission", "warranty")
FRAMES = ("{}", "Licensed under the {}.", "Released under {}", "This project is distributed under the terms of the {}.", "License: {}", "See the {} for details.", "This file is covered by the {}.", "The code is available under {}.")
AROUND = ("note", "the following applies to all files here", "see also", "2021 by the authors", "all rights reserved", "unless stated otherwise", "read this first", "part of the project")
KEPT_OUT = ("in this directory", "copyright 2019", "and its documentation", "as found in the archive", "please read carefully", "contributors welcome")
# Names of licences that no family covers, and lines with cue words that name no licence.
UNKNOWN_NAMES = ("Example Vendor Proprietary License, version 7", "Zlike Community License", "Open Widget Agreement, version 1", "Sample Source License", "Acme Commercial License v2.0", "Blue River Public License, version 3", "Example Data Terms 1.0", "Northern Archive Licence", "Internal Use License 4.0", "Quarry Free License, v. 1.1", "EX-1.0", "Maple-2.0-only")
OTHER = ("Copyright 2020 by the authors. All rights reserved.", "You need a licence to drive this car.", "No permission is given and there is no warranty.", "The license fee is due in March.", "The terms of the sale are subject to change.", "He asked for permission to use the library.", "Copies of the program were free of charge.")
NONE_ROWS, NONE_WORDS, STEPS, RATE, DECAY, ERROR, MISSED, CONFIRM, SEED = 400, 2000, 80, 1.0, 1e-4, 0.02, 0.02, 0.6, 5
#: Words that a region's marks may be apart, and by how many it is widened.
GAP, WIDER = 6, 3
FAMILIES = tuple(NOTICES)
STOPS = np.array([b in b".!?;:" for b in range(256)])


class Regions:
    """The marked regions of many texts: text and line of each, and its first and last word (one beyond).

    marks: sorted hashes of template grams by their length.
    """

    def __init__(self, texts: list[bytes], marks: dict[int, np.ndarray]):
        self.words = w = Words(texts, ALNUM, lower=True)
        n = len(w.start)
        b = np.frombuffer(w.data, np.uint8)
        cuts = np.flatnonzero(b == 10)
        line = np.searchsorted(cuts, w.start)
        text = np.searchsorted(w.begins, w.start, "right") - 1
        apart = np.ones(n + 1, bool)  # whether a paragraph begins at a word
        apart[1:n] = (np.diff(line) > 1) | (np.diff(text) > 0)
        after = np.zeros(len(b) + 2, bool)  # whether a stop stands at a byte
        after[: len(b)] = STOPS[b]
        stop = np.ones(n + 1, bool)  # whether a sentence or line may begin at a word
        if n:
            stop[1:n] = (after[w.end[:-1]] & ~ALNUM[np.append(b, 32)[np.minimum(w.end[:-1] + 1, len(b))]]) | (np.diff(line) > 0) | apart[1:n]
        paragraph = np.cumsum(apart[:n])
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        starts, ends = [], []
        for size in (1, 2, 3):
            at, key = w.grams(size)
            same = paragraph[at] == paragraph[at + size - 1] if len(at) else np.empty(0, bool)
            self.grams[size] = at, key = at[same], key[same]
            own = marks.get(size, np.empty(0, np.uint64))
            if len(own) and len(key):
                i = np.searchsorted(own, key)
                i[i == len(own)] = 0
                hit = at[own[i] == key]
                starts.append(hit)
                ends.append(hit + size)
        starts, ends = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (starts, ends))
        order = np.lexsort((ends, starts))
        starts, ends = starts[order], ends[order]
        ends = np.maximum.accumulate(ends) if len(ends) else ends
        stops = np.cumsum(stop)  # of word i and those before
        new = np.ones(len(starts), bool)
        if len(starts) > 1:
            gap = starts[1:] - ends[:-1]
            new[1:] = (paragraph[starts[1:]] != paragraph[starts[:-1]]) | (gap > GAP) | ((gap >= 0) & (stops[starts[1:]] > stops[np.maximum(ends[:-1] - 1, 0)]))
        first = np.flatnonzero(new)
        self.low, self.high = starts[first], ends[np.append(first[1:], len(starts)) - 1] if len(first) else ends
        for _ in range(WIDER):  # within the sentence, and not into a neighbour
            if len(self.low):
                before, behind = np.append(0, self.high[:-1]), np.append(self.low[1:], n)
                self.low = np.where(~stop[self.low] & (self.low > before), self.low - 1, self.low)
                self.high = np.where(~stop[self.high] & (self.high < behind), self.high + 1, self.high)
        self.text = text[self.low] if n else np.empty(0, np.int64)
        begins = np.searchsorted(cuts, w.begins[:-1])
        self.line = line[self.low] - begins[self.text] if n else np.empty(0, np.int64)

    def inside(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Region and hash of every gram of this size that lies in one."""
        at, key = self.grams[size]
        region = np.searchsorted(self.low, at, "right") - 1
        ok = region >= 0
        ok[ok] = at[ok] + size <= self.high[region[ok]]
        return region[ok], key[ok]


def _grams(text: str, size: int) -> np.ndarray:
    return np.unique(Words([text.encode()], ALNUM, lower=True).grams(size)[1])


def _variants(texts: list[str], around: tuple[str, ...], rng: np.random.Generator, times: int, damage: bool) -> list[str]:
    """Texts with other words before and after them, every second one wrapped; and, if damaged, a word left out of those of seven and more."""
    out = []
    for t in texts:
        for v in range(times):
            words = t.split()
            if damage and len(words) > 6:
                words.pop(int(rng.integers(len(words))))
            if v % 2:
                words.insert(int(rng.integers(len(words) + 1)), "\n")
            a, b = (around[int(i)] if rng.random() < 0.7 else "" for i in rng.integers(len(around), size=2))
            out.append(" ".join([a, *words, b]).strip())
    return out


class Classifier:
    """features: sorted gram hashes; weights and bias: one column for each family, then "unknown" and "none"."""

    def __init__(self, none: list[str]):
        rng = np.random.default_rng(SEED)
        self.templates: list[tuple[int, int, np.ndarray, bool]] = []  # family, gram length, hashes, whether it is a name
        for k, f in enumerate(FAMILIES):
            for t in [*NAMES[f], *NOTICES[f]]:
                size = min(3, len(Words([t.encode()], ALNUM).start))
                self.templates.append((k, size, _grams(t, size), t in NAMES[f]))
        self.marks = {size: np.unique(np.concatenate([t for _, s, t, _ in self.templates if s == size] or [np.empty(0, np.uint64)])) for size in (1, 2, 3)}
        none = [t for t in none if not np.isin(_grams(t, 3), self.marks[3]).any()]
        framed = {f: [*NOTICES[f], *(frame.format(n) for n in NAMES[f] for frame in FRAMES)] for f in FAMILIES}
        odd = [frame.format(n) for n in UNKNOWN_NAMES for frame in FRAMES]
        learnt, kept = [], []
        for out, around, times, damage in ((learnt, AROUND, 2, False), (kept, KEPT_OUT, 2, True)):
            for k, f in enumerate([*FAMILIES, None]):
                out += [(t, k) for t in _variants(framed[f] if f else odd, around, rng, times, damage)]
        learnt += [(t, len(FAMILIES) + 1) for t in (*OTHER, *none)]
        texts = [t for t, _ in learnt]
        grams = Words([t.encode() for t in texts if t not in none], ALNUM, lower=True)
        self.features = np.unique(np.concatenate([grams.grams(n)[1] for n in (1, 2, 3)]))
        x, y = self._rows(learnt)
        self.weights, self.bias = self._fit(x, y)
        z, held = self._rows(kept)
        p = _softmax(z @ self.weights + self.bias)
        wrong = [p[held == len(FAMILIES), :-2].max(1)]
        for k in range(len(FAMILIES)):  # the unseen: a family's variants under a model that never saw it
            w, b = self._fit(x[y != k], y[y != k], STEPS // 2)
            wrong.append(np.delete(_softmax(z[held == k] @ w + b), k, 1)[:, :-2].max(1))
        wrong = np.sort(np.concatenate(wrong))
        cut = float(wrong[min(len(wrong) - 1, int(np.ceil((1 - ERROR) * len(wrong))))])
        self.threshold = np.array([min(cut, float(np.quantile(p[held == k, k], MISSED))) for k in range(len(FAMILIES))])

    def _rows(self, labelled: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Features and labels of texts: of their longest region, or of a whole text that has none."""
        texts = [t.encode() for t, _ in labelled]
        r = Regions(texts, self.marks)
        size = r.high - r.low
        longest = {int(t): i for i, t in sorted(enumerate(r.text.tolist()), key=lambda x: size[x[0]])}
        x = np.zeros((len(texts), len(self.features)), np.float32)
        whole = np.array([t not in longest for t in range(len(texts))])
        row = np.full(len(r.low), -1)
        row[list(longest.values())] = list(longest)
        of = np.searchsorted(r.words.first, np.arange(len(r.words.start)), "right") - 1
        for n in (1, 2, 3):
            region, key = r.inside(n)
            at_text = row[region]
            self._count(x, at_text[at_text >= 0], key[at_text >= 0])
            at, key = r.grams[n]
            self._count(x, of[at][whole[of[at]]], key[whole[of[at]]])
        return x / np.maximum(1, np.sqrt((x * x).sum(1, keepdims=True))), np.array([k for _, k in labelled])

    def _count(self, x: np.ndarray, row: np.ndarray, key: np.ndarray) -> None:
        at, ok = self._find(key)
        np.add.at(x, (row[ok], at[ok]), 1.0)

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.features, key)
        at[at == len(self.features)] = 0
        return at, self.features[at] == key

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        k = len(FAMILIES) + 2
        w, b, gw, gb = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32), np.full((x.shape[1], k), 1e-8, np.float32), np.full(k, 1e-8, np.float32)
        weight = (1 / np.maximum(1, np.bincount(y, minlength=k)))[y]
        weight = (weight / weight.sum()).astype(np.float32)
        gold = np.eye(k, dtype=np.float32)[y]
        for _ in range(steps):
            d = (_softmax(x @ w + b) - gold) * weight[:, None]
            dw, db = x.T @ d + np.float32(DECAY) * w, d.sum(0)
            gw += dw * dw
            gb += db * db
            w -= RATE * 0.3 * dw / np.sqrt(gw)
            b -= RATE * 0.3 * db / np.sqrt(gb)
        return w, b

    def contained(self, grams: dict[int, np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """For each family the largest share of a template's grams that a region's grams, by length, hold; and the families that it names in full."""
        best, named = np.zeros(len(FAMILIES)), set()
        for k, size, t, name in self.templates:
            share = np.isin(t, grams[size]).mean()
            best[k] = max(best[k], share)
            if name and share == 1:
                named.add(k)
        return best, sorted(named)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, str, float]]]:
        """Each text's licence paragraphs: the line where one begins, family or "unknown", confidence."""
        out: list[list[tuple[int, str, float]]] = [[] for _ in texts]
        r = Regions(texts, self.marks)
        if not len(r.low):
            return out
        inside = {n: r.inside(n) for n in (1, 2, 3)}
        row, at = (np.concatenate(c) for c in zip(*((region[ok], at[ok]) for region, (at, ok) in ((region, self._find(key)) for region, key in inside.values()))))
        cell, n = np.unique(row * len(self.features) + at, return_counts=True)
        row, at = cell // len(self.features), cell % len(self.features)
        starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else row
        live = row[starts]
        norm = np.maximum(1, np.sqrt(np.add.reduceat(n * n, starts)))
        p = _softmax(np.add.reduceat(self.weights[at] * n[:, None], starts) / norm[:, None] + self.bias)
        cuts = {size: np.searchsorted(region, np.arange(len(r.low) + 1)) for size, (region, _) in inside.items()}
        for i, region in enumerate(live.tolist()):
            if p[i].argmax() == len(FAMILIES) + 1:
                continue
            k = int(p[i, :-2].argmax())
            held, named = self.contained({size: inside[size][1][c[region] : c[region + 1]] for size, c in cuts.items()})
            sure = p[i, k] >= self.threshold[k] and held[k] >= CONFIRM and held[k] >= held.max()
            found = [k, *(j for j in named if j != k)] if sure else []  # a text may offer a choice of licences
            out[r.text[region]] += [(int(r.line[region]), FAMILIES[j], float(p[i, j])) for j in found] or [(int(r.line[region]), "unknown", float(p[i, k]))]
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(docs: DataFrame, text_col: str = "text", rows: int = NONE_ROWS) -> Classifier:
    """Learns from the notices and a bounded sample of the corpus's lines without cue words, of at most NONE_WORDS bytes each."""
    line = docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).filter((F.length("line") > 0) & (F.octet_length("line") <= NONE_WORDS))
    plain = line.filter(~F.lower("line").rlike("|".join(CUES)))
    return Classifier([r["line"] for r in plain.orderBy(F.xxhash64("line"), "line").limit(rows).collect()])


SPANS = "array<struct<line:int,family:string,confidence:double>>"


def scan(df: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines and paragraphs (see SPANS; lines from 0) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                texts = raw(part.column(1))
                found = [[{"line": n, "family": f, "confidence": c} for n, f, c in x] for x in shared.value.scan(texts)]
                of = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("confidence", pa.float64())]))
                yield pa.record_batch([part.column(0), pa.array([t.count(b"\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array(found, of)], names=["doc_id", "n_lines", "paragraphs"])

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_lines long, paragraphs {SPANS}")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns doc_id, n_lines, n_confirmed, n_unknown, licenses (families, sorted, comma-joined), paragraphs (line:family, comma-joined)."""
    docs = table(spark, "documents")(sf_dir)
    found = scan(docs, train(docs))
    known = F.filter("paragraphs", lambda p: p["family"] != "unknown")
    return found.select(
        "doc_id",
        "n_lines",
        F.size(known).cast("long").alias("n_confirmed"),
        (F.size("paragraphs") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda p: p["family"]))), ",").alias("licenses"),
        F.array_join(F.transform("paragraphs", lambda p: F.concat_ws(":", p["line"].cast("string"), p["family"])), ",").alias("paragraphs"),
    )
