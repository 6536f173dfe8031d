"""Licence scans: a trained paragraph classifier, confirmed against templates.

A paragraph (a line of a text) is read as lower-cased runs of letters and digits.
A multinomial logistic regression on the presence of word 1-grams and 2-grams
names a licence family or ``unknown``.  It is trained on windows of the template
paragraphs below and, for ``unknown``, on a bounded sample of the corpus: the
lines of ``negative_docs`` documents of lowest id hash, at most ``negative_lines``
of them, without those that repeat much of a template.  Calibration: a first fit
leaves out whole paragraphs (every third of a family) and whole documents (a third, by
hash), so that no window of what is held out was trained on; the temperature that fits
the probabilities of these rows best, those of ``unknown`` among them, is kept for the
fit on all rows.

A prediction is confirmed when the share of the paragraph's word 2-grams that
occur in one template of that family is at least ``confirm``.

Every line of every text is scored; words outside the template vocabulary have no
weight.  Defined results: null and empty texts have no hits; repeated rows repeat
their hits; only the id and the text are read; an empty corpus trains without
negatives and has no hits.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

#: Notices and passages by which licences are known.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}

_WORD = re.compile(r"[^\W_]+").findall


def _words(paragraph: str) -> list[str]:
    return _WORD(paragraph.lower())


@dataclass
class Scanner:
    """The trained model: vocabulary, weights by feature and family, and template 2-grams."""

    families: list[str]
    words: dict[str, int]
    pairs: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[list[np.ndarray]]
    reliability: tuple[float, float] = (0.0, 0.0)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(line, feature)`` once for each feature of a line, and ``(line, 2-gram)`` of each place; unknown 2-grams are -1."""
        lines = [_words(x) for x in text.split("\n")]
        get = self.words.get
        ids = np.array([get(w, -1) for x in lines for w in x], np.int64)
        at = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
        near = at[1:] == at[:-1]
        left, right, at2 = ids[:-1][near], ids[1:][near], at[1:][near]
        code = np.where((left >= 0) & (right >= 0), left * len(self.words) + right, -1)
        found = np.searchsorted(self.pairs, code)
        found[found == len(self.pairs)] = 0
        pair = np.where(self.pairs[found] == code, found, -1)
        n = len(self.words) + len(self.pairs)
        both = np.concatenate((at[ids >= 0] * n + ids[ids >= 0], at2[pair >= 0] * n + len(self.words) + pair[pair >= 0]))
        both = np.unique(both)
        return both // n, both % n, at2, pair

    def scan(self, text: str | None, confirm: float) -> list[tuple[int, str, float, float, bool]]:
        """``(line, family, probability, overlap, confirmed)`` of the lines that a family is predicted for."""
        if not text:
            return []
        line, feature, at2, pair = self.features(text)
        if not len(line):
            return []
        lines, start = np.unique(line, return_index=True)
        logits = (np.add.reduceat(self.weights[feature], start) + self.bias) / self.temperature
        best = logits.argmax(axis=1)
        out = []
        for i in np.flatnonzero(best > 0):
            p = 1 / np.exp(logits[i] - logits[i, best[i]]).sum()
            own = np.unique(pair[at2 == lines[i]])
            size = max(1, int((at2 == lines[i]).sum()))
            places = pair[at2 == lines[i]]
            overlap = max(float(np.isin(places, t).sum()) / size for t in self.templates[best[i]]) if len(own) else 0.0
            out.append((int(lines[i]), self.families[best[i]], float(p), overlap, overlap >= confirm))
        return out


def _windows(words: list[str]) -> list[list[str]]:
    """A paragraph and its halves, thirds and word-by-word shortened forms."""
    n, out = len(words), [words]
    for parts in (2, 3):
        size = n // parts
        if size >= 6:
            out += [words[i : i + size] for i in range(0, n - size + 1, max(1, size // 2))]
    out += [words[:i] + words[i + 1 :] for i in range(n)]
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", negative_docs: int = 400, negative_lines: int = 3000) -> Scanner:
    """A scanner trained on the templates and a bounded sample of ``docs``."""
    spark = docs.sparkSession
    paragraphs = [(f, _words(p)) for f, ps in TEMPLATES.items() for p in ps]
    words = {w: i for i, w in enumerate(sorted({w for _, p in paragraphs for w in p}))}
    code = lambda p: [words[a] * len(words) + words[b] for a, b in zip(p, p[1:], strict=False)]
    pairs = np.array(sorted({c for _, p in paragraphs for c in code(p)}), np.int64)
    families = [UNKNOWN, *TEMPLATES]
    templates = [[], *[[np.searchsorted(pairs, code(_words(p))) for p in ps] for ps in TEMPLATES.values()]]
    n = len(words) + len(pairs)
    scanner = Scanner(families, words, pairs, np.zeros((n, len(families))), np.zeros(len(families)), 1.0, templates)

    def row(label: int, text: str) -> tuple[int, list[int], float]:
        """Label, features, and the share of 2-grams known from templates."""
        _, feature, _, pair = scanner.features(text)
        return label, feature.tolist(), float((pair >= 0).mean()) if len(pair) else 0.0

    place: dict[str, int] = {}
    rows, held = [], []
    for f, p in paragraphs:
        place[f] = place.get(f, -1) + 1
        windows = [row(families.index(f), " ".join(w)) for w in _windows(p)]
        rows += windows
        held += [place[f] % 3 == 2] * len(windows)
    # a share of about four times what is wanted is cut first, so that no task sends more to the sort than it must
    key = F.pmod(F.xxhash64(id_col), F.lit(1 << 40))
    most = min(1.0, 4 * negative_docs / max(1, docs.count())) * (1 << 40)
    drawn = docs.filter(F.col(text_col).isNotNull() & (key < most)).select(id_col, text_col).orderBy(key, id_col).limit(negative_docs)
    lines = drawn.select(F.explode(F.split(text_col, "\n")).alias("line"), (F.pmod(F.xxhash64(text_col), F.lit(3)) == 0).alias("out")).filter(F.length("line") > 0).limit(negative_lines).collect()  # bounded by negative_lines
    for x in lines:
        if (r := row(0, x.line))[2] < 0.5:
            rows.append(r)
            held.append(x.out)
    # single words say nothing: a family needs its 2-grams
    single = [(0, [i], 0.0) for i in range(len(words))] + [(0, [], 0.0)] * 20
    rows += single
    held += [False] * len(single)

    def fit(some: list[tuple[int, list[int], float]]) -> tuple[np.ndarray, np.ndarray]:
        frame = spark.createDataFrame([(float(y), Vectors.sparse(n, {i: 1.0 for i in f})) for y, f, _ in some], ["label", "features"])
        fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, standardization=False).fit(frame)
        return fitted.coefficientMatrix.toArray().T.copy(), fitted.interceptVector.toArray()

    weights, bias = fit([r for r, h in zip(rows, held, strict=True) if not h])
    test = [r for r, h in zip(rows, held, strict=True) if h]
    scores = np.array([weights[f].sum(axis=0) + bias for _, f, _ in test])
    truth = np.array([y for y, _, _ in test])

    def loss(t: float) -> float:
        z = scores / t
        return float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(z)), truth]).mean())

    scanner.temperature = min((0.25 * 1.2**i for i in range(24)), key=loss)
    z = scores / scanner.temperature
    sure = np.exp(z - z.max(axis=1, keepdims=True))
    sure /= sure.sum(axis=1, keepdims=True)
    #: Held-out reliability: mean probability of the predicted class, and how often it was right.
    scanner.reliability = (float(sure.max(axis=1).mean()), float((sure.argmax(axis=1) == truth).mean()))
    scanner.weights, scanner.bias = fit(rows)
    return scanner


def scan(docs: DataFrame, scanner: Scanner, *, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.6) -> DataFrame:
    """``id, line_no, family, probability, overlap, confirmed`` of every line predicted to be a licence."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner)

    @F.pandas_udf("array<struct<line_no:int,family:string,probability:double,overlap:double,confirmed:boolean>>")
    def hits(texts: pd.Series) -> pd.Series:
        names = ("line_no", "family", "probability", "overlap", "confirmed")
        return pd.Series([[dict(zip(names, h, strict=True)) for h in shared.value.scan(t, confirm)] for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("id"), F.explode(hits(F.col(text_col))).alias("h")).select("id", "h.*")
