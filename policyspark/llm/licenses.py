"""Licence notices by a trained paragraph classifier.

A multinomial logistic regression over the sparse word n-grams of one to three words that notices
are made of tells a paragraph's licence family or `unknown`; its temperature is set on paragraphs
kept from training. A prediction counts as confirmed when the paragraph also holds enough of the
trigrams of one of the family's templates.

A paragraph is a line, and also lines that follow each other without a blank one, so wrapped
notices are read whole; longer ones are read by overlapping stretches. What the model could gain
at most over `unknown` is summed for all words of a text at once; only stretches that could reach
it are put through the model, which changes no answer.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from policyspark.llm.common import bounded_sample, typed

# Customary notices of public licences, by family.
NOTICES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "This article is distributed under the terms of the Creative Commons Attribution 4.0 License, which permits unrestricted use, distribution and reproduction in any medium, provided the original work is properly cited."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work may be shared and adapted for non-commercial purposes under the Creative Commons BY-NC license."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0", "This is free and unencumbered content released into the public domain.", "No rights reserved. Dedicated to the public domain under Creative Commons Zero."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU GPL v2 or later.", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Released under the LGPL."],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "MIT licensed, see the LICENSE file."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["Copyright. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.", "This document contains proprietary and confidential information. Do not distribute."],
}
# Sentences that speak of licences without granting any.
OTHERS = ["Her driving license expired in May.", "The bar lost its liquor license.", "All public works in the city are free of charge.", "The general published a work on the public.", "Please read the license before you start.", "A copy of the report is under review.", "Version 2.0 of the program comes in the spring.", "The software foundation met on Friday.", "Commons and lords debated attribution of the work."]
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
WIDE, STEP = 60, 30


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(ws: list[str]) -> set[str]:
    """n-grams of one to three words."""
    return {" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)}


def _trigrams(ws: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


TEMPLATES = {family: [_trigrams(words(n)) for n in notices] for family, notices in NOTICES.items()}


def similarity(family: str, ws: list[str]) -> float:
    """The largest share of a template's trigrams that the words hold."""
    shingles = {n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} for n in (1, 2, 3)}
    return max((len(t & shingles[len(next(iter(t)))]) / len(t) for t in TEMPLATES.get(family, []) if t), default=0.0)


@dataclass
class Model:
    families: list[str]
    index: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def predict(self, ws: list[str]) -> tuple[str, float]:
        at = [self.index[g] for g in grams(ws) if g in self.index]
        z = (self.bias + self.weights[at].sum(axis=0)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.families[k], float(p[k])

    def prepare(self) -> None:
        """Tables of what each n-gram gives some family over `unknown` at most, and what a family lacks without any."""
        u = self.families.index("unknown")
        others = [k for k in range(len(self.families)) if k != u]
        self.need = float((self.bias[u] - self.bias[others]).min()) if others else np.inf
        gain = np.maximum((self.weights[:, others] - self.weights[:, [u]]).max(axis=1), 0) if others else np.zeros(len(self.weights))
        self.words: dict[str, int] = {}
        for g in self.index:
            for w in g.split(" "):
                self.words.setdefault(w, len(self.words) + 1)
        base, tables = len(self.words) + 1, []
        for n in (1, 2, 3):
            found = sorted((sum(self.words[w] * base**i for i, w in enumerate(reversed(g.split(" ")))), gain[k]) for g, k in self.index.items() if g.count(" ") == n - 1)
            tables.append((np.array([k for k, _ in found] or [-1], np.int64), np.array([v for _, v in found] or [0.0])))
        self.base, self.tables = base, tables

    def gains(self, ws: list[str]) -> np.ndarray:
        """Running sums, one longer than ws, of the most that the n-grams which start at each word give."""
        ids = np.fromiter((self.words.get(w, 0) for w in ws), np.int64, len(ws))
        out, key, live = np.zeros(len(ws) + 1), ids, ids > 0
        for n, (keys, values) in enumerate(self.tables, 1):
            if n > 1:
                key = key[:-1] * self.base + ids[n - 1 :]
                live = live[:-1] & (ids[n - 1 :] > 0)
            at = np.flatnonzero(live)
            if len(at):
                place = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
                out[at + 1] += np.where(keys[place] == key[at], values[place], 0)
        return out.cumsum()


def fit(background: list[str], copies: int = 24, rounds: int = 150, l1: float = 2e-4, seed: int = 0) -> Model:
    """Trained on notices, whole, damaged and among other words, against other sentences and background paragraphs."""
    rng = random.Random(seed)
    plain = [ws for b in sorted(background) if (ws := words(b)[:WIDE]) and max(similarity(f, ws) for f in NOTICES) < 0.3]
    rows = [(ws, "unknown") for ws in plain] + [(words(o), "unknown") for o in OTHERS for _ in range(copies)]
    for family, notices in NOTICES.items():
        for n in notices:
            ws = words(n)
            for c in range(copies):
                kept = [w for w in ws if c == 0 or rng.random() > 0.08]
                around = rng.choice(plain) if plain else []
                cut = rng.randrange(len(around) + 1)
                rows.append((around[:cut][-rng.randrange(20) - 1 :] * (c % 2) + kept + around[cut:][: rng.randrange(20)] * (c % 3 == 1), family))
    rng.shuffle(rows)
    families = sorted({f for _, f in rows})
    held = rows[::5]
    rows = [r for i, r in enumerate(rows) if i % 5]
    index = {g: i for i, g in enumerate(sorted({g for notices in NOTICES.values() for n in notices for g in grams(words(n))}))}
    found = [[index[g] for g in sorted(grams(ws)) if g in index] for ws, _ in rows]
    x = np.zeros((len(rows), len(index)), np.float32)
    for i, at in enumerate(found):
        x[i, at] = 1
    y = np.eye(len(families))[[families.index(f) for _, f in rows]]
    w, b = np.zeros((len(index), len(families))), np.zeros(len(families))
    for _ in range(rounds):  # proximal gradient, so weights that do nothing end at zero
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) / len(rows)
        w -= 4.0 * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * l1, 0)
        b -= 4.0 * g.sum(axis=0)
    live = np.flatnonzero(np.abs(w).sum(axis=1))
    where = {int(k): i for i, k in enumerate(live)}
    model = Model(families, {g: where[k] for g, k in index.items() if k in where}, w[live], b)

    def loss(t: float) -> float:
        model.temperature, total = t, 0.0
        for ws, family in held:
            at = [model.index[g] for g in grams(ws) if g in model.index]
            z = (model.bias + model.weights[at].sum(axis=0)) / t
            total += np.log(np.exp(z - z.max()).sum()) + z.max() - z[families.index(family)]
        return total

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    model.prepare()
    return model


def learn(docs: DataFrame, paragraphs: int = 300) -> Model:
    """Background paragraphs: the longest line of each of `paragraphs` documents at most, the same at every run; chosen where the texts are."""
    ids = bounded_sample(docs.select("doc_id"), "doc_id", [], paragraphs)
    longest = F.expr("array_max(transform(split(text, '\\n'), x -> struct(length(x) as n, x as t))).t")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").where(F.col("text").isNotNull()).select(longest.alias("t")).distinct()
    return fit([r[0] for r in found.collect()])


def stretches(lines: list[list[str]]) -> Iterator[tuple[int, int, int, bool]]:
    """(line, first word, word after the last, whether it runs over lines) of all that is read as one, words counted through the text."""
    ends = np.cumsum([len(ws) for ws in lines]).tolist()
    block = None
    for k, ws in enumerate([*lines, []]):
        if ws:
            a, b = ends[k] - len(ws), ends[k]
            block = (a, b, k, 1) if block is None else (block[0], b, block[2], block[3] + 1)
            for at in [a] if len(ws) <= WIDE else range(a, b - STEP, STEP):
                yield k, at, min(at + WIDE, b), False
        elif block is not None:
            a, b, first, n = block
            if n > 1:
                for at in [a] if b - a <= WIDE else range(a, b - STEP, STEP):
                    while ends[first] <= at:
                        first += 1
                    yield first, at, min(at + WIDE, b), True
            block = None


def notices_of(text: str | None, m: Model, least: float) -> list[tuple[int, str, float, float]]:
    """(line, family, probability, similarity) of the notices of a text; one that runs over lines counts once, as a whole, if that is more like its template than any line of it."""
    lines = [words(x) for x in (text or "").split("\n")]
    ws = [w for line in lines for w in line]
    sums = m.gains(ws)
    if sums[-1] < m.need:
        return []
    best: dict[tuple[int, str], tuple[float, float]] = {}
    wide: dict[str, list[tuple[int, int, int, float, float]]] = {}
    held: list[tuple[int, int, str, int, float]] = []
    for k, a, b, over in stretches(lines):
        if sums[b] - sums[a] < m.need:
            continue
        family, p = m.predict(ws[a:b])
        if family == "unknown" or p < least:
            continue
        s = similarity(family, ws[a:b])
        if over:
            wide.setdefault(family, []).append((k, a, b, s, p))
        else:
            best[k, family] = max(best.get((k, family), (0.0, 0.0)), (s, p))
            held.append((a, b, family, k, s))
    for family, found in wide.items():
        taken: list[tuple[int, int]] = []
        for k, a, b, s, p in sorted(found, key=lambda x: (-x[3], -x[4], x[1])):
            inside = [h for h in held if h[2] == family and a < h[1] and h[0] < b]
            if any(y > a and x < b for x, y in taken) or any(h[4] >= s for h in inside):
                continue
            for h in inside:  # parts of the same notice
                best.pop((h[3], family), None)
            best[k, family] = max(best.get((k, family), (0.0, 0.0)), (s, p))
            taken.append((a, b))
    return [(k, f, p, s) for (k, f), (s, p) in sorted(best.items())]


def scan(docs: DataFrame, model: Model, least: float = 0.5, confirm: float = 0.6) -> DataFrame:
    """A row per line and family found: doc_id, paragraph (its line, the first if it runs over several), family, probability, similarity, confirmed.

    Null, empty and blank texts give no rows; repeated rows give theirs each; doc_id keeps its
    type; other columns of docs are not read. Ties of families go to the first in order.
    """
    shared, kind = docs.sparkSession.sparkContext.broadcast(model), to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        types = (kind, pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_())
        for batch in batches:
            rows = [(doc, k, f, p, s, s >= confirm) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, f, p, s in notices_of(text, m, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    schema = typed(docs, "doc_id", paragraph=T.IntegerType(), family=T.StringType(), probability=T.DoubleType(), similarity=T.DoubleType(), confirmed=T.BooleanType())
    return docs.select("doc_id", "text").mapInArrow(run, schema)
