"""License scans: paragraphs are classified, and a template has to confirm the family.

A sparse logistic regression over word n-grams (1 to 3; those seen at least
MIN_SEEN times, others weigh nothing) is trained on the
driver with paragraphs generated from the templates below (`per_class`, the
bound of its training data): worded differently, with words lost or added,
against prose, and against licences of unlisted families, the unknown class.
A held-out part calibrates the temperature. A stretch is a finding if the
calibrated probability that it is no licence is below one half. A family in it
counts if one of its templates shares enough word pairs with the stretch, the
words that name the licence among them, and the family's probability there, or
in the words that the template covers, reaches `confident`. If none counts, the
stretch is "unknown"; disclaimers that many licences share are a family of
their own. Of findings that overlap, the one that shares most stays; of equal
ones the surer, the longer and the first.

Paragraphs are the lines between blank lines; they are read across their line
ends, and each of their lines is read alone too. Of more than SEGMENT words,
stretches of that many are read, overlapping by half, so all words of a very long
text are read. Nothing is shuffled. Defined cases: null text has no paragraphs;
repeated rows are scanned each; an empty table gives no rows; columns named lc_*
are replaced, others pass through.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronry.llm.common import add_arrays, pack_bounds, text_buffers, with_columns
from heronry.llm.decontaminate import hash_words
from heronry.llm.lm_score import grams

#: Statements of each family (fixed values); the words in brackets name the licence and have to stand in the text.
TEMPLATES = {
    "agpl": ["licensed under the [GNU Affero General Public] License version 3", "under the terms of the [GNU Affero General Public] License as published by the Free Software Foundation", "See the [GNU Affero General Public] License for more details", "You should have received a copy of the [GNU Affero General Public] License along with this program", "This program is distributed under the [AGPL]-3.0", "SPDX-License-Identifier: [AGPL]-3.0-or-later"],
    "apache": [
        "Licensed under the [Apache License], Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.[apache].org/licenses/LICENSE-2.0", "SPDX-License-Identifier: [Apache]-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "See the License for the specific language governing permissions and limitations under the License",
    ],
    "boost": ["Distributed under the [Boost Software License], Version 1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "SPDX-License-Identifier: [BSL]-1.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the [BSD] 3-Clause License", "This code is governed by a [BSD]-style license", "SPDX-License-Identifier: [BSD]-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "released under [CC0] 1.0 Universal public domain dedication", "dedicated to the public domain under [CC0]"],
    "cc_by": ["Licensed under [CC BY] 4.0", "This work is licensed under a [Creative Commons] Attribution 4.0 International License", "available under the terms of the [Creative Commons] Attribution License"],
    "cc_by_nc": ["Licensed under [CC BY NC] 4.0", "This work is licensed under a [Creative Commons] Attribution-[NonCommercial] 4.0 International License", "for non-commercial use under [CC BY NC]-SA"],
    "cc_by_sa": ["Licensed under [CC BY SA] 4.0", "This work is licensed under a [Creative Commons] Attribution-[ShareAlike] 4.0 International License", "text is available under the [Creative Commons] Attribution-[ShareAlike] License"],
    "disclaimer": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        "ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ],
    "epl": ["made available under the terms of the [Eclipse Public] License v2.0", "This program and the accompanying materials are made available under the terms of the [Eclipse Public] License which accompanies this distribution", "SPDX-License-Identifier: [EPL]-2.0"],
    "gpl": [
        "This work is licensed under the [GNU General Public] License, version 3", "you can redistribute it and/or modify it under the terms of the [GNU General Public] License as published by the Free Software Foundation", "SPDX-License-Identifier: [GPL]-2.0-or-later",
        "See the [GNU General Public] License for more details", "You should have received a copy of the [GNU General Public] License along with this program", "either version 2 of the License, or (at your option) any later version", "distributed under the [GPL] version 2",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS", "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE", "Released under the [ISC License]", "SPDX-License-Identifier: [ISC]",
    ],
    "lgpl": [
        "under the terms of the [GNU Lesser General Public] License as published by the Free Software Foundation", "licensed under the [GNU Lesser General Public] License version 2.1", "distributed under the [LGPL]-2.1", "SPDX-License-Identifier: [LGPL]-2.1-or-later",
        "See the [GNU Lesser General Public] License for more details", "You should have received a copy of the [GNU Lesser General Public] License along with this library",
    ],
    "mit": [
        "Released under the [MIT] License", "the [MIT License]", "and to permit persons to whom the Software is furnished to do so, subject to the following conditions", "SPDX-License-Identifier: [MIT]", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the [Mozilla Public] License, v. 2.0", "licensed under the [Mozilla Public] License Version 2.0", "If a copy of the [MPL] was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: [MPL]-2.0"],
    "reserved": ["All rights reserved", "Copyright reserved by the author, no part of this publication may be reproduced without permission", "Unauthorized copying of this file is strictly prohibited, proprietary and confidential"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means", "SPDX-License-Identifier: [Unlicense]"],
    "wtfpl": ["This program is free software. It comes without any warranty, to the extent permitted by applicable law", "redistribute it and/or modify it under the terms of the Do [What The Fuck] You Want To Public License, Version 2", "SPDX-License-Identifier: [WTFPL]", "licensed under the [WTFPL]"],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "SPDX-License-Identifier: [Zlib]"],
}
#: Words of licences that no family lists, and sentences that are none (fixed values).
OTHER_LICENCE = ["licensed under the {} License version 1.0", "This work is distributed under the terms of the {} Public License", "released under the {} Community License agreement", "subject to the {} Open Data License", "Permission to copy is granted under the {} license terms", "see the {} license for the terms of use and redistribution"]
PLAIN = ["the driver applied for a license at the office in town", "all rights and duties of the members are listed in the first chapter", "she asked permission to use the old software of the public library", "version 2.0 of the report was published on monday", "the general public was free to visit the work in progress", "copies of the book were distributed by the foundation at no cost", "the source of the river lies under the mountain", "terms of the contract were modified under new conditions", "he reserved a table for the author and the publisher", "attribution of the painting to the master is not certain", "the commercial code of the country was changed", "in this file we obtain the result of the form above"]
NONE, UNKNOWN = "none", "unknown"
CLASSES = [NONE, UNKNOWN, *TEMPLATES]
MIN_SEEN = 3
SEGMENT = 48
#: Share of a template's word pairs that a paragraph has to have for its family.
MIN_SHARED = 0.6

ADDED = [
    T.StructField("lc_paragraphs", T.LongType()),
    T.StructField("lc_findings", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("shared", T.DoubleType())]))),
]


def features(words: np.ndarray, segment: np.ndarray):
    """(hash, segment) of the n-grams inside each segment."""
    found, owner = [], []
    for h in grams(words, segment, 3):
        there = h != 0
        found.append(h[there])
        owner.append(segment[there])
    f, s = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(s, kind="stable")
    return f[order], s[order]


class Model:
    """Weights of the known n-grams by class; `sieve` lets most unknown ones be passed over at once."""

    def __init__(self, hashes: np.ndarray):
        known, n = np.unique(hashes, return_counts=True)
        self.known = known[n >= MIN_SEEN]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.known >> np.uint64(42)] = True
        self.w = np.zeros((len(self.known), len(CLASSES)), np.float32)
        self.b = np.zeros(len(CLASSES), np.float32)
        self.temperature = 1.0

    def lookup(self, f: np.ndarray, s: np.ndarray):
        """(index, segment) of the known n-grams."""
        maybe = np.nonzero(self.sieve[f >> np.uint64(42)])[0]
        at = np.minimum(np.searchsorted(self.known, f[maybe]), len(self.known) - 1)
        good = self.known[at] == f[maybe]
        return at[good], s[maybe[good]]

    def logits(self, f: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        """Sum of weights over the square root of the number of n-grams of each segment."""
        size = np.bincount(s, minlength=n)
        at, own = self.lookup(f, s)
        count = np.bincount(own, minlength=n)
        out = np.zeros((n, len(CLASSES)), np.float32)
        full = np.nonzero(count)[0]
        if len(full):
            out[full] = np.add.reduceat(self.w[at], (np.cumsum(count) - count)[full], axis=0) / np.sqrt(size[full, None])
        return out + self.b

    def probability(self, f: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        z = self.logits(f, s, n) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, f: np.ndarray, s: np.ndarray, y: np.ndarray, epochs: int) -> None:
        n, count = len(y), np.bincount(s, minlength=len(y))
        target = np.eye(len(CLASSES), dtype=np.float32)[y]
        at, own = self.lookup(f, s)
        order = np.argsort(at, kind="stable")
        first = np.searchsorted(at[order], np.arange(len(self.known)))
        past_w, past_b = np.full(self.w.shape, 1e-6, np.float32), np.full(len(CLASSES), 1e-6, np.float32)
        for _ in range(epochs):
            d = (self.probability(f, s, n) - target) / n
            per = d / np.sqrt(np.maximum(count, 1))[:, None]
            g = np.add.reduceat(per[own[order]], first, axis=0) + 1e-5 * self.w
            past_w += g * g
            past_b += d.sum(axis=0) ** 2
            self.w -= 0.5 * g / np.sqrt(past_w)
            self.b -= 0.1 * d.sum(axis=0) / np.sqrt(past_b)

    def calibrate(self, f: np.ndarray, s: np.ndarray, y: np.ndarray) -> None:
        """The temperature with the least held-out loss."""
        z = self.logits(f, s, len(y)).astype(np.float64)

        def loss(t: float) -> float:
            q = z / t
            q -= q.max(axis=1, keepdims=True)
            return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())

        self.temperature = min(np.geomspace(0.2, 5, 60), key=loss)


def generated(per_class: int, seed: int) -> list[tuple[str, int]]:
    """Labelled paragraphs."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize()
    prose = lambda n: " ".join(name().lower() if rng.random() < 0.6 else rng.choice(" ".join(PLAIN).split()) for _ in range(n))

    small = lambda n: " ".join(name().lower() if rng.random() < 0.5 else rng.choice("the of to a in is by at be this it on for was with and that an are no".split()) for _ in range(n))

    common = "mit der die das und ein von den zu im es as s a t d l de la el los que y en un une et les des du pour il di che per na w z i o e".split()
    letters = lambda: "".join(rng.choice("enisratdhulcgmobwfkzpväüößéñ") for _ in range(rng.randint(1, 10)))
    foreign = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else letters() for _ in range(n))

    def worn(text: str) -> str:
        words = [w for w in text.split() if rng.random() > 0.06]
        if rng.random() < 0.3:
            words.insert(rng.randrange(len(words) + 1), name().lower())
        text = " ".join(words)
        around = rng.random()
        if around < 0.3:
            text = prose(rng.randint(1, 8)) + " " + text
        if 0.15 < around < 0.45:
            text += " " + prose(rng.randint(1, 8))
        return text.upper() if rng.random() < 0.05 else text

    out = []
    for k, family in enumerate(CLASSES):
        for _ in range(per_class * (4 if family == NONE else 1)):
            if family == NONE:
                out.append((rng.choice([lambda: worn(rng.choice(PLAIN)), lambda: prose(rng.randint(1, 45)), lambda: small(rng.randint(1, 12)), lambda: foreign(rng.randint(1, 45)), lambda: foreign(rng.randint(1, 4)), lambda: prose(rng.randint(1, 4))])(), k))
            elif family == UNKNOWN:
                out.append((worn(rng.choice(OTHER_LICENCE).format(name())), k))
            else:
                out.append((worn(plain_words(rng.choice(TEMPLATES[family]))), k))
    rng.shuffle(out)
    return out


def words_of(texts: list[str]):
    offsets, raw = text_buffers(pa.array(texts, pa.large_string()))
    return hash_words(raw, offsets)


@cache
def trained(per_class: int = 120, seed: int = 5, epochs: int = 60) -> Model:
    """Trained on three quarters of the generated paragraphs, calibrated on the rest."""
    rows = generated(per_class, seed)
    cut = 3 * len(rows) // 4
    (f, s), y = features(*words_of([t for t, _ in rows[:cut]])), np.array([k for _, k in rows[:cut]])
    model = Model(f)
    model.fit(f, s, y, epochs)
    model.calibrate(*features(*words_of([t for t, _ in rows[cut:]])), np.array([k for _, k in rows[cut:]]))
    return model


def plain_words(template: str) -> str:
    return template.replace("[", "").replace("]", "")


def pairs_of(text: str) -> np.ndarray:
    """Hashes of the word pairs of a text, of its single word where it has one."""
    one, two = grams(*words_of([text]), 2)
    return np.unique(two[two != 0]) if len(one) > 1 else one


@cache
def template_pairs() -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """(word pairs, pairs of the name) of each template."""
    out = {}
    for family, texts in (TEMPLATES | {UNKNOWN: [x.format("") for x in OTHER_LICENCE]}).items():
        names = [[pairs_of(x) for x in re.findall(r"\[(.*?)\]", t)] for t in texts]
        out[family] = [(pairs_of(plain_words(t)), np.concatenate(n) if n else np.zeros(0, np.uint64)) for t, n in zip(texts, names)]
    return out


def stretches(first: np.ndarray, size: np.ndarray):
    """(first word, number of words) of the overlapping stretches that cover each run of words."""
    half = SEGMENT // 2
    pieces = np.where(size <= SEGMENT, 1, -(-(size - SEGMENT) // half) + 1)
    owner = np.repeat(np.arange(len(first)), pieces)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[owner] + step * half
    return at, np.minimum(SEGMENT, first[owner] + size[owner] - at)


def runs(key: np.ndarray, doc: np.ndarray):
    """(first word, number of words) of the runs of words with the same key and document."""
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(key) != 0) | (np.diff(doc) != 0)
    first = np.nonzero(new)[0]
    return first, np.diff(np.append(first, len(doc)))


def segments(raw: np.ndarray, offsets: np.ndarray, words: np.ndarray, doc: np.ndarray, starts: np.ndarray):
    """Stretches of paragraphs and of their lines: (word indices, their segment), first word and size of each segment, paragraphs by document."""
    ends = np.nonzero(raw == 10)[0]
    inked = np.cumsum((raw != 32) & ((raw < 9) | (raw > 13)))
    blank = ends[1:][np.diff(inked[ends]) == 0]
    line, block = np.searchsorted(ends, starts), np.searchsorted(blank, starts)
    first, size = runs(block, doc)
    line_first, line_size = runs(line, doc)
    parted = ~np.isin(line_first, first) | ~np.isin(line_first + line_size, first + size)  # a paragraph of one line is read once
    at, n = (np.concatenate(x) for x in zip(stretches(first, size), stretches(line_first[parted], line_size[parted])))
    index = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return index, np.repeat(np.arange(len(at)), n), at, n, np.bincount(doc[first], minlength=len(offsets) - 1)


def apart(found: list[tuple]) -> list[tuple]:
    """Of findings (…, first and last word read, best class) that overlap in a document, the one that shares most; unknown ones give way.

    A stretch without a template is a part of the notice that it was read with if the model doesn't call it unknown, and of any notice
    of the family that the model takes it for. Findings of a family that follow closely are one notice.
    """
    kept: dict[int, list[tuple]] = {}
    for x in sorted(found, key=lambda x: (x[3] == UNKNOWN, -x[5], -x[4], -x[2], x)):
        own = kept.setdefault(x[0], [])
        if any(x[1] < y[1] + y[2] and y[1] < x[1] + x[2] for y in own):
            continue
        if x[3] == UNKNOWN and x[4] < 0.5 and any(y[3] == x[8] or (y[3] != UNKNOWN and y[6] <= x[1] and x[1] + x[2] <= y[7]) for y in own):
            continue
        own.append(x)
    out: list[tuple] = []
    for x in sorted(x[:6] for own in kept.values() for x in own):
        if out and x[3] != UNKNOWN and out[-1][0] == x[0] and out[-1][3] == x[3] and x[1] - out[-1][1] - out[-1][2] <= SEGMENT // 2:
            y = out.pop()
            x = (*y[:2], x[1] + x[2] - y[1], y[3], max(x[4], y[4]), max(x[5], y[5]))
        out.append(x)
    return out


def scan_part(raw: np.ndarray, offsets: np.ndarray, model: Model, confident: float):
    """Paragraphs per document and findings (document, word, words, family, probability, shared)."""
    words, doc, starts = hash_words(raw, offsets, places=True)
    if not len(words):
        return np.zeros(len(offsets) - 1, np.int64), []
    index, segment, at, n, lines = segments(raw, offsets, words, doc, starts)
    p = model.probability(*features(words[index], segment), len(at))
    found = []
    for k in np.nonzero(p[:, 0] < 0.5)[0].tolist():
        own = words[at[k] : at[k] + n[k]]
        one, two = grams(own, np.zeros(len(own), np.int64), 2)
        base, best, known, both = np.searchsorted(doc, doc[at[k]]), 0.0, [], np.concatenate([one, two])
        for family, templates in template_pairs().items():
            for t, name in templates:
                share = float(np.isin(t, both).mean()) if np.isin(name, both).all() else 0.0
                best = max(best, share if family in (UNKNOWN, CLASSES[2 + int(p[k, 2:].argmax())]) else 0.0)
                if family != UNKNOWN and share >= MIN_SHARED:
                    there = np.nonzero(np.isin(two, t) | np.isin(one, t))[0]
                    ends = np.searchsorted(there, there + 5 * (len(t) + 1) // 4 + 1)  # where most of it stands together
                    most = int((ends - np.arange(len(there))).argmax())
                    known.append((int(there[most]), min(len(own), int(there[ends[most] - 1]) + 2), CLASSES.index(family), share))
        counted, read = False, (int(at[k] - base), int(at[k] + n[k] - base), CLASSES[1 + int(p[k, 1:].argmax())])
        if known:
            pieces = [own[x:y] for x, y, _, _ in known]
            size = np.fromiter(map(len, pieces), np.int64, len(pieces))
            each = model.probability(*features(np.concatenate(pieces), np.repeat(np.arange(len(pieces)), size)), len(pieces))
            for (x, y, c, share), q in zip(known, each):
                sure = max(float(q[c]), float(p[k, c]))
                if sure >= confident:
                    counted = True
                    found.append((int(doc[at[k]]), int(at[k] + x - base), y - x, CLASSES[c], round(sure, 6), round(share, 6), *read))
        if not counted:
            found.append((int(doc[at[k]]), int(at[k] - base), int(n[k]), UNKNOWN, round(float(p[k, 1]), 6), round(best, 6), *read))
    return lines, apart(found)


def scan(docs: DataFrame, text_col: str = "text", confident: float = 0.5, **training) -> DataFrame:
    """`docs` with lc_paragraphs and lc_findings."""
    sent = docs.sparkSession.sparkContext.broadcast(trained(**training))
    schema = with_columns(docs.schema, ADDED)

    def run(batches):
        model = sent.value
        for batch in batches:
            offsets, raw = text_buffers(batch.column(batch.schema.names.index(text_col)))
            bounds = pack_bounds(np.diff(offsets), 1 << 20)
            for a, b in zip(bounds, bounds[1:]):
                part = offsets[a : b + 1]
                lines, found = scan_part(raw[part[0] : part[-1]], part - part[0], model, confident)
                rows: list[list] = [[] for _ in range(b - a)]
                for d, *finding in found:
                    rows[d].append(dict(zip(("word", "n_words", "family", "probability", "shared"), finding)))
                kind = pa.list_(pa.struct([("word", pa.int64()), ("n_words", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64())]))
                yield add_arrays(batch.slice(a, b - a), schema, {"lc_paragraphs": pa.array(lines.astype(np.int64)), "lc_findings": pa.array(rows, kind)})

    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, n_findings, n_unknown, families (sorted, comma-joined), least_probability."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    families = F.array_sort(F.array_distinct(F.col("lc_findings.family")))
    unknown = F.size(F.filter("lc_findings", lambda x: x["family"] == UNKNOWN)).cast("long")
    return found.select("doc_id", F.col("lc_paragraphs").alias("n_paragraphs"), F.size("lc_findings").cast("long").alias("n_findings"), unknown.alias("n_unknown"), F.array_join(families, ",").alias("families"), F.array_min("lc_findings.probability").alias("least_probability"))
