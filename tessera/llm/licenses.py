"""Licence scan: a paragraph classifier over sparse word n-grams, trained here, confirmed against templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import map_arrow
from tessera.llm.textkit import NON_ALNUM, doc_slices, hash_words, mix64, string_buffers

#: Names of each family as notices write them, and sentences of its text.
FAMILIES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("MIT", "the MIT License", "the Expat License", "MIT License"), (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    )),
    "Apache-2.0": (("the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "the Apache 2.0 license", "the Apache Software License"), (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    )),
    "BSD": (("the BSD License", "BSD-3-Clause", "BSD-2-Clause", "the 3-clause BSD license", "the New BSD License", "the simplified BSD license"), (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    )),
    "GPL": (("the GNU General Public License, version 3", "the GNU General Public License", "GPL-3.0-or-later", "GPL-2.0-only", "GPLv3", "the GNU GPL version 2", "GPL-3.0"), (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    )),
    "LGPL": (("the GNU Lesser General Public License", "LGPL-2.1-or-later", "LGPL-3.0", "LGPLv3", "the GNU Lesser General Public License, version 2.1"), (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    )),
    "AGPL": (("the GNU Affero General Public License", "AGPL-3.0", "AGPLv3", "the GNU Affero General Public License, version 3"), (
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Remote network interaction: if you modify the program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the corresponding source.",
    )),
    "MPL-2.0": (("the Mozilla Public License, v. 2.0", "MPL-2.0", "the Mozilla Public License 2.0"), (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    )),
    "CC-BY": (("CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "a Creative Commons Attribution license"), (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    )),
    "CC-BY-SA": (("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 License", "CC-BY-SA-4.0", "CC BY-SA 3.0"), (
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original.",
    )),
    "CC-BY-NC": (("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 License", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0"), (
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. You may not use the material for commercial purposes.",
    )),
    "Public-Domain": (("CC0 1.0", "CC0", "the Unlicense", "the public domain", "Creative Commons Zero"), (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under CC0.",
    )),
    "ISC": (("the ISC License", "ISC"), (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    )),
    "Proprietary": (("a proprietary license", "a commercial license"), (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "All rights reserved.", "All rights reserved worldwide.", "(c) All rights reserved.", "Copyright (c) the authors. All rights reserved.", "Copyright 2019 Example Inc. All rights reserved.", "Copyright (c) 2021 by the publisher, all rights reserved.",
    )),
}
NOTICES = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This software is released under {}.", "Distributed under {}.", "License: {}", "SPDX-License-Identifier: {}", "This file is made available under {}.", "The code is available under the terms of {}.")
#: Paragraphs that speak of such things without licensing anything.
OTHER = (
    "The driver must carry a valid license and the license plate must be visible at all times.", "He lost his fishing license when the agency changed its terms.",
    "The software was released in version 3 with many new features for users of the work.", "Please see the documentation for details about the license server and its port.",
    "Permission denied: the file could not be opened without the required rights.", "The general public may visit the museum free of charge on Sundays.",
    "The foundation published its annual report, and the conditions of the work are described in it.", "This is the second version of the program and it was distributed to all persons in the school.",
    "Apache helicopters were seen over the field, and the public was warned.", "She studied at MIT before joining the company as a contributor.",
    "The commons were open to all, and creative people met there to share work under the trees.", "The warranty of the car covers parts for any purpose except racing.",
    "You may not enter the building without written agreement from the owner.", "The copyright office moved to a new building and its notice was printed in the paper.",
    "It is the use of words, with or without meaning, that the author describes in all the books.", "A copy of the letter was sent to the family, and they should have received it by now.",
    "Use the source, and see the list of following items for the name of each.", "In the hope that it will be useful to the reader, the text is printed in full with the kind help of a friend.",
    "The terms of trade were under discussion, and any person could obtain a seat.", "Public domain experts and license managers met to discuss conditions of sale.",
)
UNKNOWN = "unknown"


def _grams(words: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the 1-, 2- and 3-grams and where each starts; grams do not leave their paragraph."""
    out = [(words, np.arange(len(words)))]
    h = words
    with np.errstate(over="ignore"):
        for n in (2, 3):
            if len(words) < n:
                break
            h = mix64(h[:-1] * np.uint64(3) + words[n - 1 :])
            inside = np.flatnonzero(owner[: len(h)] == owner[n - 1 :])
            out.append((h[inside], inside))
    return out


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = string_buffers(pa.array([t.lower() for t in texts], pa.string()))
    h, doc, _, _ = hash_words(data, offsets, NON_ALNUM)
    return h, doc


def templates() -> list[tuple[str, str]]:
    """(family, text): every notice with every name, and the sentences."""
    return [(f, t) for f, (names, texts) in FAMILIES.items() for t in (*(n.format(x) for x in names for n in NOTICES), *texts)]


@dataclass
class Model:
    classes: list[str]  # the last is UNKNOWN
    keys: np.ndarray  # hashes of the features, sorted
    weights: np.ndarray  # (features, classes)
    bias: np.ndarray
    floor: float  # a family needs this probability
    known: dict[str, list[np.ndarray]]  # each family's templates as sorted hashes of 2-grams and lone words

    def probabilities(self, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Class probabilities of the stretches words[start:end]; features are the counts of their 1-, 2- and 3-grams over the square root of all.

        Stretches may overlap: weights are summed once along the words, and a stretch is a difference of two sums.
        """
        total, logits = np.zeros(len(start)), np.zeros((len(start), len(self.classes)))
        h = words
        with np.errstate(over="ignore"):
            for n in (1, 2, 3):
                if n > 1:
                    h = mix64(h[:-1] * np.uint64(3) + words[n - 1 :])
                if not len(h):
                    break
                place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[place] == h)
                sums = np.concatenate([np.zeros((1, len(self.classes))), np.cumsum(self.weights[place[hit]], axis=0)])
                last = np.maximum(end - n + 1, start)
                total += last - start
                logits += sums[np.searchsorted(hit, last)] - sums[np.searchsorted(hit, start)]
        logits = logits / np.sqrt(np.maximum(total, 1))[:, None] + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def similarity(self, family: str, words: np.ndarray) -> float:
        """The greatest share of the paragraph's 2-grams that a template of the family holds."""
        own = np.unique(_pairs(words))
        return max((np.isin(own, t).sum() / max(len(own), 1) for t in self.known[family]), default=0.0)


def _pairs(words: np.ndarray) -> np.ndarray:
    if len(words) < 2:
        return words
    with np.errstate(over="ignore"):
        return mix64(words[:-1] * np.uint64(3) + words[1:])


def train(seed: int = 11, copies: int = 4, steps: int = 250, rate: float = 4.0, decay: float = 2e-4, false_rate: float = 0.002) -> Model:
    """Multinomial logistic regression on varied templates; a third of the examples calibrates the floor.

    Variants drop words, cut beginnings and ends and append prose. The unknown
    class learns prose, and template words out of their order. The floor is the
    probability of a family that only false_rate of the held-out unknown paragraphs reach.
    """
    rng = np.random.default_rng(seed)
    classes = [*FAMILIES, UNKNOWN]
    texts, y = [], []
    prose = " ".join(OTHER).split()
    every = [t for _, t in templates()]
    for family, text in templates():
        for c in range(copies if len(text) > 90 else 2):
            words = text.split()
            if c and len(words) > 12:
                a = rng.integers(0, len(words) // 3)
                words = words[a : a + max(10, int(len(words) * rng.uniform(0.5, 1)))]
            if c:
                words = [w for w in words if rng.random() > 0.04]
                if rng.random() < 0.3:
                    k = rng.integers(0, len(prose) - 12)
                    words = [*words, *prose[k : k + rng.integers(3, 12)]]
            texts.append(" ".join(words))
            y.append(classes.index(family))
    pool = " ".join(every).split()
    for text in OTHER:
        for _ in range(12):
            words = text.split()
            rng.shuffle(words)
            texts.extend([text, " ".join(words[: rng.integers(2, len(words) + 1)])])
            y.extend([len(classes) - 1] * 2)
    for _ in range(900):
        k = int(rng.integers(1, 40))
        mixed = [pool[i] for i in rng.integers(0, len(pool), k)] + [prose[i] for i in rng.integers(0, len(prose), k)]
        rng.shuffle(mixed)
        texts.append(" ".join(mixed))
        y.append(len(classes) - 1)
    y = np.array(y)
    h, doc = _words(texts)
    grams = _grams(h, doc)
    seen = np.concatenate([g for g, _ in grams])
    keys, back, count = np.unique(seen, return_inverse=True, return_counts=True)
    who = np.concatenate([doc[at] for _, at in grams])
    frequent = np.flatnonzero(count >= 4)
    new = np.full(len(keys), -1)
    new[frequent] = np.arange(len(frequent))
    x = np.zeros((len(texts), len(frequent)), np.float32)
    used = new[back] >= 0
    np.add.at(x, (who[used], new[back][used]), 1)
    x /= np.sqrt(np.maximum(np.bincount(who, minlength=len(texts)), 1))[:, None]
    held = np.arange(len(texts)) % 3 == 0
    goal = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    xt, gt = np.ascontiguousarray(x[~held]), goal[~held]

    def soft(m):
        z = m @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    for _ in range(steps):
        d = (soft(xt) - gt) / len(xt)
        vw = 0.9 * vw - rate * (xt.T @ d + decay * w)
        vb = 0.9 * vb - rate * d.sum(0)
        w, b = w + vw, b + vb
    p = soft(x[held])
    false = np.sort(p[y[held] == len(classes) - 1][:, :-1].max(1))
    floor = float(np.clip(false[len(false) - 1 - int(false_rate * len(false))], 0.5, 0.95))
    known: dict[str, list[np.ndarray]] = {f: [] for f in FAMILIES}
    for family, text in templates():
        known[family].append(np.unique(_pairs(_words([text])[0])))
    return Model(classes, keys[frequent], w.astype(np.float64), b.astype(np.float64), floor, known)


#: Words of windows; the next begins a third of them later. Notices and the sentences of licences are as long as one of them or another.
WINDOWS = (12, 24, 48)
STOPS = np.zeros(256, bool)
STOPS[[33, 46, 63]] = True  # ! . ?
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def stretches(data: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, paragraph) of what is classified in texts whose words lie at data[start:end].

    Paragraphs are parted by lines without words. A stretch is a whole paragraph, one of its lines or sentences (which
    end at .!? before white space, and may run over lines), or a window of one of the WINDOWS in a longer paragraph, so that a wrapped notice,
    one among other lines and one inside a long line are each seen without much else.
    """
    n = len(start)
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none
    upto = lambda marks: np.concatenate([[0], np.cumsum(marks[data])])
    newline = np.zeros(256, bool)
    newline[10] = True
    a, b = end[:-1], start[1:]
    lines, stops, blanks = (c[b] - c[a] for c in map(upto, (newline, STOPS, BLANK)))
    other = doc[1:] != doc[:-1]

    def bounds(breaks):
        first = np.flatnonzero(np.r_[True, breaks])
        return first, np.r_[first[1:], n]

    p0, p1 = bounds(other | (lines > 1))
    paragraph_of = np.repeat(np.arange(len(p0)), p1 - p0)
    parts = [(p0, p1), bounds(other | (lines > 0)), bounds(other | (lines > 1) | (stops > 0) & (blanks > 0))]
    for width in WINDOWS:
        long = np.flatnonzero(p1 - p0 > width)
        step = width // 3
        each = -(-(p1 - p0)[long] // step)
        where = np.repeat(p0[long], each) + step * (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each))
        parts.append((where, np.minimum(where + width, np.repeat(p1[long], each))))
    first, last = (np.concatenate(x) for x in zip(*parts))
    _, keep = np.unique(first * (n + 1) + last, return_index=True)
    return first[keep], last[keep], paragraph_of[first[keep]]


SCHEMA = "doc_id long, paragraph int, family string, probability double, similarity double"


def scan_licenses(docs: DataFrame, model: Model | None = None, confirm_at: float = 0.5) -> DataFrame:
    """The paragraphs of documents (doc_id, text) that licence something: a row for each family found in one.

    A family is found in a paragraph where in one of its stretches (see stretches) the family's probability is the greatest and
    reaches the calibrated floor, and a template of the family confirms it: it holds at least confirm_at of
    the stretch's 2-grams. ``probability`` is that of the likeliest such stretch, ``similarity`` that stretch's share; all else is unknown and has no row.
    ``paragraph`` counts the text's paragraphs from 0. Null and empty texts give no rows, and an empty table none; a very long text is read whole,
    alone in its turn; repeated rows repeat theirs; a null doc_id stays null; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        model = shared.value
        for batch in batches:
            column = pc.utf8_lower(batch.column(1).cast(pa.large_string()))
            ids = batch.column(0).to_pylist()
            _, all_offsets = string_buffers(column)
            rows = []
            for i, j in doc_slices(all_offsets, 1 << 19):
                data, offsets = string_buffers(column.slice(i, j - i))
                words, doc, start, end = hash_words(data, offsets, NON_ALNUM)
                first, last, paragraph = stretches(data, doc, start, end)
                if not len(first):
                    continue
                p = model.probabilities(words, first, last)
                best = p.argmax(1)
                found: dict[tuple[int, int], tuple[float, float]] = {}
                for k in np.flatnonzero((best < len(model.classes) - 1) & (p.max(1) >= model.floor)):
                    near = float(model.similarity(model.classes[best[k]], words[first[k] : last[k]]))
                    if near >= confirm_at:
                        own = (int(paragraph[k]), int(best[k]))
                        found[own] = max(found.get(own, (0.0, 0.0)), (round(float(p[k, best[k]]), 9), near))
                for (number, c), (probability, near) in sorted(found.items()):
                    d = int(doc[first[np.searchsorted(paragraph, number)]])
                    before = int(paragraph[np.searchsorted(first, np.searchsorted(doc, d))])
                    rows.append((ids[i + d], number - before, model.classes[c], probability, near))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, SCHEMA)
