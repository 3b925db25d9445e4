"""License scans: a trained paragraph classifier over licence families, confirmed by comparison with templates.

Features are hashed word unigrams and bigrams. The classifier is a sparse multinomial logistic regression,
trained here on the templates with words dropped and surrounded by ordinary words, alone and two of them joined, against an unknown
class: paragraphs of a bounded sample of the corpus, phrases that only mention licences, and the templates denied ("is
not licensed under ..."). A temperature fitted on held-out examples calibrates the probabilities. A paragraph is read in
overlapping windows of WINDOW words, so a notice in the middle of a long paragraph counts as much as one that stands
alone. Paragraphs end at blank lines and at the ends of texts; windows and word pairs go across single newlines, so a
wrapped notice is read as a whole.

The classifier predicts and the templates confirm; no family is reported that it doesn't predict. A window's predictions
are the families whose calibrated probability against the unknown class is P_LEAST at least, the most probable one first:
a window with two notices has two families. The first prediction is confirmed when the window holds CONFIRM of one
of the family's templates' word pairs, no more of another family's, and not merely a part of a notice of another family;
it and any later one also when the window holds CONFIRM of a template's pairs and CONFIRM of those among them that no other family has.

Defined cases: null and empty texts have no paragraphs and no family. Very long texts and paragraphs are read
whole. Several families in a document: the one with the highest probability is `family`, all are in `families`, sorted. Repeated rows get a
row each. An empty table trains against the built-in phrases alone and gives no rows. Extra columns aren't
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _common as c, _text as t

#: Documents whose paragraphs are examples of the unknown class, at most.
SAMPLES = 400
#: Lines of a sampled document that training reads, and characters of a line: what reaches the driver is bounded.
LINES, LINE_CHARS = 8, 4000
WINDOW, STEP = 24, 12
P_LEAST, CONFIRM = 0.5, 0.6
EPOCHS, COPIES, JOINED = 30, 40, 400

#: Usual short notices, titles, identifiers and short forms of licence families.
TEMPLATES = {
    "AGPL": ("licensed under the GNU Affero General Public License version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License Version 3, 19 November 2007", "licensed under AGPLv3", "License: AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "released under the Apache 2.0 license", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "License: Apache-2.0", "uses the Apache License", "SPDX-License-Identifier: Apache-2.0"),
    "BSD": ("licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "released under the BSD license", "BSD License", "BSD 2-Clause License", "License: BSD-2-Clause", "License: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY": ("licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Text is available under the Creative Commons Attribution-ShareAlike License", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0": ("Released under CC0 1.0", "dedicated to the public domain under the Creative Commons Zero CC0 1.0 Universal dedication", "SPDX-License-Identifier: CC0-1.0"),
    "GPL": ("This work is licensed under the GNU General Public License, version 3", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "licensed under the GPL version 2 or later", "GNU General Public License Version 3, 29 June 2007", "GNU General Public License Version 2, June 1991", "licensed under GPLv3", "licensed under GPLv2", "License: GPL-3.0", "License: GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "licensed under the ISC License", "ISC License", "License: ISC", "SPDX-License-Identifier: ISC"),
    "LGPL": ("licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License Version 3, 29 June 2007", "licensed under LGPLv3", "License: LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "MIT License", "The MIT License (MIT)", "License: MIT", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License 2.0", "Mozilla Public License Version 2.0", "License: MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    "Proprietary": ("All rights reserved", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher", "This software is proprietary and confidential. Unauthorized copying is strictly prohibited"),
    "Unlicense": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary", "released under the Unlicense", "License: Unlicense", "SPDX-License-Identifier: Unlicense"),
}
#: Phrases that mention licences without granting one, and how a notice is denied.
DECOYS = (
    "you need a driver license to rent a car", "the license plate of the vehicle was stolen", "she is a licensed nurse in this state", "the city issued a liquor license to the bar", "read the license before you use the software",
    "the general public was invited to the free concert", "under the terms of the agreement the company paid", "the apache helicopter landed near the village", "he studied at mit before he moved", "version 2 of the report was released today",
    "a work of creative people and common sense", "the foundation published a free guide", "this work was released to the public in may", "permission to enter was granted to the person", "all rights of the citizens are protected by law",
)
DENIALS = ("not", "is not", "are not", "isn't", "aren't", "wasn't", "never", "was never", "no longer", "is no longer")
VERBS = ("licensed", "released", "uses", "available")
FAMILIES = ("unknown", *sorted(TEMPLATES))

_WORDY = np.ones(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_NEWLINE = 10
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _paragraph_ends(b: np.ndarray) -> np.ndarray:
    """Where a blank line ends."""
    lines = np.flatnonzero(b == _NEWLINE)
    seen = np.cumsum(~_BLANK[b])[lines]
    out = np.zeros(len(b), bool)
    out[lines[1:][seen[1:] == seen[:-1]]] = True
    return out


def _grams(b: np.ndarray, off: np.ndarray):
    """Word starts, and hashes of each word and of each word with the next (0 where the paragraph ends)."""
    low = t._FOLD[b]
    word = ~_WORDY[low]
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    before = np.r_[False, word[:-1]]
    after = np.r_[word[1:], False]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return starts, none, none, np.zeros(0, np.int64)
    one = t.Hashes(low).of(starts, ends)
    breaks = np.cumsum(_paragraph_ends(b) | edge[:-1])
    paragraph = breaks[starts]
    two = np.zeros(len(one), np.uint64)
    same = paragraph[1:] == paragraph[:-1]
    two[:-1][same] = t.mix(one[:-1][same] * np.uint64(3) + one[1:][same])
    return starts, one, two, paragraph


def _of_text(text: str) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(text.encode(), np.uint8)
    _, one, two, _ = _grams(b, np.array([0, len(b)]))
    return one, two[two > 0]


class Model:
    """Hashes of the features that have a weight, their weights for each family, the biases and the templates' pairs."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float, templates: list[tuple[int, np.ndarray]]):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias, self.temperature, self.templates = keys[order], weights[order], bias, temperature, templates
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & np.uint64(65535)).astype(np.int64)] = True
        others = {f: np.concatenate([p for g, p in templates if g != f] or [keys[:0]]) for f, _ in templates}
        #: Of each template, the pairs that no other family has.
        self.own = [np.setdiff1d(p, others[f]) for f, p in templates]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are features, and which ones."""
        at = np.flatnonzero(self.maybe[(hashes & np.uint64(65535)).astype(np.int64)])
        row = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        real = self.keys[row] == hashes[at]
        return at[real], row[real]

    def against_unknown(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probability of each family, if it is that family or the unknown class."""
        return 1 / (1 + np.exp(np.clip((logits[:, :1] - logits) / self.temperature, -500, 500)))

    def confirmed(self, family: int, pairs: np.ndarray) -> bool:
        """Whether the window holds enough of one of the family's templates, and no more of another family's longer one."""
        best, other = 0.0, 0.0
        for f, own in self.templates:
            share = len(np.intersect1d(own, pairs)) / len(own) * (1 + len(own) / 1000)
            best, other = (max(best, share), other) if f == family else (best, max(other, share))
        return best >= CONFIRM and best >= other

    def held(self, pairs: np.ndarray) -> set[int]:
        """The families of which the window holds enough of a template, and enough of what no other family has."""
        out = set()
        for (f, every), own in zip(self.templates, self.own, strict=True):
            if f not in out and len(own) and all(len(np.intersect1d(x, pairs)) >= CONFIRM * len(x) for x in (own, every)):
                out.add(f)
        return out

    def explained(self, family: int, pairs: np.ndarray, held: set[int]) -> bool:
        """Whether all that the window has of the family's templates is in templates of the families that are held."""
        parts = {g: np.concatenate([p for f, p in self.templates if f == g]) for g in held | {family}}
        if family in held or not held:
            return False
        mine = np.intersect1d(parts[family], pairs)
        return bool(np.isin(mine, np.concatenate([parts[g] for g in held])).all())


def examples(negatives: list[str], seed: int = 4) -> list[tuple[int, str]]:
    """(family, text): noisy templates with up to a window of words around them, what belongs to no family, and denied templates."""
    rng = np.random.default_rng(seed)
    filler = np.array([w for x in negatives for w in x.split()][:20_000] or ["and"])
    out = [(0, x) for x in negatives] + [(0, x) for x in DECOYS for _ in range(8)]

    def among(words: list[str], most: int) -> str:
        (before, after), (i, j) = rng.integers(0, most // 2 + 1, 2), rng.integers(0, len(filler), 2)
        return " ".join([*filler[i : i + before], *words, *filler[j : j + after]])  # as they follow each other in the corpus

    for f, family in enumerate(FAMILIES[1:], 1):
        for template in TEMPLATES[family]:
            words = template.split()
            for i in range(COPIES):
                kept = [w for w in words if rng.random() > 0.06] if i else words
                out.append((f, among(kept, 18 if i % 2 else max(18, WINDOW - len(words))) if i else template))
            said = [i for i, w in enumerate(words) if w.lower() in VERBS]
            at = said[0] if said else 0
            how = words[at:] if said else ["licensed", "under", "the", *words]
            for denial in DENIALS:
                out.append((0, among([*denial.split(), *how], 18)))
    every = [(f, x.split()) for f, family in enumerate(FAMILIES) if f for x in TEMPLATES[family]]
    for _ in range(JOINED):
        (f, x), (g, y) = (every[i] for i in rng.integers(0, len(every), 2))
        text = among([*x, ("or", "and")[rng.integers(0, 2)], *y], 8)
        out += [(f, text), (g, text)]
    return out


def train(docs: DataFrame, samples: int = SAMPLES, epochs: int = EPOCHS, lines: int = LINES) -> Model:
    """The classifier. The bounded sample it is fitted on: of at most `samples` documents, those with the smallest hash of their
    id, `lines` lines, the first ones, with 2 * WINDOW words (and LINE_CHARS characters) of each give paragraphs of no family.

    Hashes that about 4 * samples of all rows have are asked for, so that what the tasks send doesn't grow with their number.
    """
    rows = docs.where(F.col("doc_id").isNotNull()).count()
    last = -(2**63) + min(2**64 - 1, 2**64 * 4 * samples // max(rows, 1))
    usable = docs.where((F.length("text") > 0) & F.col("doc_id").isNotNull() & (F.xxhash64("doc_id") <= last))
    picked = usable.select("doc_id", F.xxhash64("doc_id").alias("m"), F.transform(F.slice(F.split("text", "\n"), 1, lines), lambda x: F.substring(x, 1, LINE_CHARS)).alias("p")).orderBy("m", "doc_id", "p").limit(samples).collect()
    return fitted([p for _, p in sorted({r["doc_id"]: r["p"] for r in reversed(picked)}.items())], epochs)


def fitted(sample: list[list[str]], epochs: int = EPOCHS) -> Model:
    """The classifier fitted on the templates and the lines of the sampled documents."""
    pairs = [(f, _of_text(x)[1]) for f, family in enumerate(FAMILIES) if f for x in TEMPLATES[family]]
    known = np.unique(np.concatenate([p for _, p in pairs]))
    negatives = []
    for lines in sample:
        for x in lines:
            words = x.split()[: 2 * WINDOW]
            if words and len(np.intersect1d(_of_text(" ".join(words))[1], known)) < 2:
                negatives.append(" ".join(words))
    every = examples(negatives)
    rng = np.random.default_rng(11)
    order = rng.permutation(len(every))
    sets = [np.unique(np.concatenate(_of_text(x))) for _, x in every]
    label = np.array([f for f, _ in every])
    # features are what notices, decoys and denials are made of: the words around a notice have no say
    said = [x for f in TEMPLATES.values() for x in f] + list(DECOYS) + [f"{d} {v}" for d in DENIALS for v in VERBS]
    keys = np.unique(np.concatenate([g for x in said for g in _of_text(x)]))
    index = [np.searchsorted(keys, s[np.isin(s, keys)]) for s in sets]
    held, fit = order[: len(order) // 5], order[len(order) // 5 :]
    weights, bias = np.zeros((len(keys), len(FAMILIES))), np.zeros(len(FAMILIES))
    grads, bias_grads = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(epochs):
        for i in rng.permutation(fit)[:4000]:
            x = index[i]
            z = bias + weights[x].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label[i]] -= 1
            if np.abs(p).max() < 0.02:
                continue
            grads[x] += p * p
            bias_grads += p * p
            weights[x] -= 0.1 * p / np.sqrt(grads[x])
            bias -= 0.1 * p / np.sqrt(bias_grads)
    weights[np.abs(weights) < 0.05] = 0
    some = np.flatnonzero((np.abs(weights).max(axis=1) > 0) | np.isin(keys, known))  # templates' pairs are looked for in any case
    logits = np.array([bias + weights[index[i]].sum(axis=0) for i in held])
    temperature = min(np.linspace(0.5, 8, 31), key=lambda s: _loss(logits / s, label[held]))
    return Model(keys[some], weights[some], bias, float(temperature), [(f, np.unique(p)) for f, p in pairs if len(p)])


def _loss(z: np.ndarray, label: np.ndarray) -> float:
    z = z - z.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), label]).mean())


def predicted(model: Model, logits: np.ndarray) -> list[tuple[int, float]]:
    """The families a window is predicted to have, the most probable first, each with its probability against the unknown class."""
    chance = model.against_unknown(logits[None])[0]
    return [(int(f), float(chance[f])) for f in np.argsort(-logits, kind="stable") if f and chance[f] >= P_LEAST]


def _found(model: Model, b: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, family, probability) of the families of the windows of the rows of b."""
    starts, one, two, paragraph = _grams(b, off)
    at1, f1 = model.find(one)
    at2, f2 = model.find(two)
    if not len(at2):  # without one pair of a template nothing can be confirmed
        return []
    at, feature = np.concatenate([at1, at2]), np.concatenate([f1, f2])
    first = np.searchsorted(paragraph, paragraph[at])
    place = at - first
    out = []
    for shift in (0, STEP):  # two tilings of each paragraph
        window = (first << 32) + (place + shift) // WINDOW
        names, inverse = np.unique(window, return_inverse=True)
        # a feature counts once in a window
        w_of, f_of = np.divmod(np.unique(inverse * len(model.keys) + feature), len(model.keys))
        logits = model.bias + np.add.reduceat(model.weights[f_of], np.searchsorted(w_of, np.arange(len(names))), axis=0)
        for w in np.flatnonzero((model.against_unknown(logits)[:, 1:] >= P_LEAST).any(axis=1)):
            mine = at[inverse == w]
            lo, hi = mine.min(), mine.max() + 1
            pairs = np.unique(two[lo:hi])
            held = model.held(pairs)
            row = int(np.searchsorted(off, starts[lo], side="right")) - 1
            for rank, (f, chance) in enumerate(predicted(model, logits[w])):
                sure = f in held
                if not sure and rank == 0 and model.confirmed(f, pairs):
                    near = slice(max(0, lo - STEP), hi + STEP)  # a window may hold only a part of another family's notice
                    around = np.unique(two[near][paragraph[near] == paragraph[lo]])
                    sure = not model.explained(f, pairs, model.held(around))
                if sure:
                    out.append((row, f, chance))
    return out


_SCHEMA = "doc_id long, n_paragraphs long, family string, probability double, families array<string>, n_windows long"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, family, probability, families and n_windows (confirmed ones) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = t.bytes_of(batch.column("text"))
            n = len(off) - 1
            family, score, every, windows = [None] * n, [0.0] * n, [set() for _ in range(n)], [0] * n
            paragraphs = np.zeros(n, np.int64)
            for lo, hi in t.slices(off):
                own, o = b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, _, _, paragraph = _grams(own, o) if len(own) else (np.zeros(0, np.int64),) * 4
                new = np.flatnonzero(np.diff(paragraph, prepend=-1) != 0) if len(paragraph) else np.zeros(0, np.int64)
                paragraphs[lo:hi] = np.diff(np.searchsorted(starts[new], o))
                for row, f, p in _found(model, own, o):
                    row += lo
                    every[row].add(FAMILIES[f])
                    windows[row] += 1
                    if p > score[row] or (p == score[row] and (family[row] is None or FAMILIES[f] < family[row])):
                        family[row], score[row] = FAMILIES[f], p
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(paragraphs), pa.array(family, pa.string()), pa.array(score, pa.float64()), pa.array([sorted(x) for x in every], pa.list_(pa.string())), pa.array(windows, pa.int64())], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select("doc_id", "text").transform(c.in_arrow, run, _SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents")
    return scan(docs, train(docs))
