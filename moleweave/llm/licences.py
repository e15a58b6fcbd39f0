"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Multinomial logistic regression on the presence of word 1- to 3-grams scores the lines of a paragraph and windows over
it. Spark ML fits it on sentences made from the templates below and, for the unknown class, on neutral, mixed, broken,
negated and merely mentioning ones; a temperature fitted on held-out sentences calibrates the probabilities. A line or
window that is not unknown proposes the families that are probable in it, and only those are looked for: a family counts
if a stretch there contains most of one of its templates and, with the words around it, is not unknown either.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moleweave.llm.common import table

#: Sentences made for the fit for each template, and the share of all that calibrates. The fit sees no other rows.
PER_TEMPLATE, HELD_OUT = 24, 0.25
#: A line or window proposes a family from this probability on, so that each of two licences to choose from is; not if it is unknown with more than that.
LEAST_PROBABILITY, MOST_UNKNOWN = 0.1, 0.5
#: A proposed family is confirmed if this share of a template's word pairs is in a stretch.
LEAST_OVERLAP = 0.75
#: Words of a window over a paragraph, how far windows lie apart, and words around a stretch that are judged with it.
UNIT, STEP, AROUND = 24, 12, 5
UNKNOWN = "unknown"
WORDS = re.compile(r"[a-z0-9]+")

#: Notices and characteristic sentences of public licences.
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "agpl-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the 2-clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "all-rights-reserved": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "All rights reserved."],
}
#: Names of families in short notices and in choices of two, which are compared whole.
NAMES = {
    "mit": ["MIT", "MIT License"],
    "apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"],
    "gpl-2.0": ["GPL-2.0", "GPLv2", "GPL-2.0-only", "GPL-2.0-or-later"],
    "gpl-3.0": ["GPL-3.0", "GPLv3", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl": ["LGPL-2.1", "LGPL-3.0", "LGPLv3"],
    "agpl-3.0": ["AGPL-3.0", "AGPLv3"],
    "bsd": ["BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD License"],
    "mpl-2.0": ["MPL-2.0", "Mozilla Public License 2.0"],
    "isc": ["ISC", "ISC License"],
    "cc0": ["CC0-1.0", "CC0 1.0"],
    "unlicense": ["Unlicense"],
}
FORMS = ("licensed under {}", "licensed under the {} license", "licensed under the {}", "released under {}", "released under the {}", "SPDX-License-Identifier: {}")
CHOICES = ("{} or {}", "{} and {}", "{} {}", "{} or the {}", "{} and the {}", "{} license or {}", "{} license and {}")
#: Sentences that share words with notices and are none.
CONFUSABLE = (
    "He lost his driving license on the way to work.", "The university licensed the patent to a company last year.", "The band released a new version of the song under its own name.",
    "Version 2.0 of the public report was published by the foundation.", "The general public was not admitted to the work.", "A license to sell this software is held by the author.",
    "She studied at MIT and works in Boston.", "The Apache helicopter was released in an international version.", "Mozilla and the free software movement are discussed in the text.",
    "Creative work is common in this international field.", "The terms of the agreement were modified without fee.", "Copyright law is taught in the third year.", "They reserved a table for all.",
    "The source of this river is in the public park.", "Permission was granted to use the hall for any purpose.", "The following conditions are met in the north of the country.",
)
#: What is said of a licence that is not given.
DENIED = (
    "this is not licensed under {}", "is not licensed under the {} and never was", "it was never released under {}", "this work is not under the {} license", "not available under {}",
    "he gave a talk about {} last year", "we discussed {} and other texts", "they compared {} with the others", "the history of {} is long", "unlike {} it has no notice", "without {} there is none",
)
NEUTRAL = "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def made_sentences(seed: int, per_template: int = PER_TEMPLATE) -> list[tuple[str, str]]:
    """(family, sentence): templates whole or in part and among neutral words, and sentences of no family."""
    draw, out = random.Random(seed), []
    noise = lambda most: [draw.choice(NEUTRAL) for _ in range(draw.randint(0, most))]
    every = [words_of(t) for texts in TEMPLATES.values() for t in texts]
    for family, texts in TEMPLATES.items():
        for words in map(words_of, texts):
            for k in range(per_template):
                keep = words if k < 8 or len(words) < 9 else words[(at := draw.randint(0, len(words) // 5)):at + len(words) - draw.randint(0, len(words) // 5)]
                out.append((family, " ".join(noise(12 * (k % 3)) + keep + noise(12 * (k % 2)))))
    for k in range(len(out)):
        words = draw.choice(every)
        pieces = (words_of(draw.choice(CONFUSABLE)), words[:max(1, len(words) // 4)], draw.sample(words, len(words)), noise(30))
        out.append((UNKNOWN, " ".join(noise(20) + list(pieces[k % 4]) + noise(20))))
    return out


def made_names(seed: int) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(family, sentence): short notices by name and, of no family, what denies or mentions a name; and choices of two, once for each."""
    draw, out, choices = random.Random(seed), [], []
    noise = lambda most: " ".join(draw.choice(NEUTRAL) for _ in range(draw.randint(0, most)))
    said = [(f, x) for f, names in NAMES.items() for x in names]
    for family, name in said:
        out += [(family, f"{noise(8 * (k % 2))} {form.format(name)} {noise(8 * (k % 3))}") for k, form in enumerate(FORMS)]
        out += [(UNKNOWN, f"{noise(8 * (k % 2))} {form.format(name)} {noise(8 * (k % 3))}") for k, form in enumerate(DENIED)]
        for other, second in said:
            if other != family:
                text = f"{noise(4)} {draw.choice(('', 'licensed under', 'SPDX-License-Identifier:', 'dual licensed under'))} {draw.choice(CHOICES).format(name, second)}"
                choices += [(family, text), (other, text)]
    for texts in TEMPLATES.values():
        out += [(UNKNOWN, f"{noise(6)} {form.format(draw.choice(texts)[:60])} {noise(6)}") for form in DENIED]
    return out, choices


class Model(NamedTuple):
    """Words are numbered from 1; a feature's code is its words' numbers as digits in base len(vocabulary) + 1."""

    classes: list[str]
    vocabulary: dict[str, int]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def features(self, paragraphs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Paragraph and feature number of each known n-gram's presence."""
        base = len(self.vocabulary) + 1
        get = self.vocabulary.get
        flat = np.array([get(w, 0) for words in paragraphs for w in [*words, ""]] + [0, 0], np.int64)
        owner = np.repeat(np.arange(len(paragraphs)), [len(words) + 1 for words in paragraphs])
        at = np.flatnonzero(flat[:-2])
        one, two, three = flat[at], flat[at + 1], flat[at + 2]
        pair = two > 0
        triple = pair & (three > 0)
        codes = np.concatenate([one, (one * base + two)[pair], ((one * base + two) * base + three)[triple]])
        rows = np.concatenate([owner[at], owner[at][pair], owner[at][triple]])
        found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[found] == codes
        both = np.unique(rows[known] * len(self.codes) + found[known])
        return both // len(self.codes), both % len(self.codes)

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        rows, features = self.features(paragraphs)
        scores = np.tile(self.bias, (len(paragraphs), 1))
        np.add.at(scores, rows, self.weights[features])
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def fit(spark: SparkSession, seed: int = 7) -> Model:
    """Fit on made sentences and calibrate on the held-out share of them."""
    names, choices = made_names(seed)
    made = made_sentences(seed) + names
    random.Random(seed).shuffle(made)
    # A choice is of two families, so it tells nothing about calibration.
    held, used = made[: int(HELD_OUT * len(made))], made[int(HELD_OUT * len(made)):] + choices
    classes = [UNKNOWN, *TEMPLATES]
    known = {g for texts in TEMPLATES.values() for t in texts for g in grams(words_of(t))} | {g for t in CONFUSABLE for g in grams(words_of(t))} | set(NEUTRAL)
    known |= {g for family, text in names + choices for g in grams(words_of(text)) if family == UNKNOWN or len(g.split()) < 3}
    vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for g in known for w in g.split()}))}
    base = len(vocabulary) + 1
    code = lambda g: sum(vocabulary[w] * base**k for k, w in enumerate(reversed(g.split())))
    model = Model(classes, vocabulary, np.array(sorted(map(code, known)), np.int64), np.empty(0), np.empty(0))
    rows, features = model.features([words_of(s) for _, s in used])
    ends = np.searchsorted(rows, np.arange(len(used) + 1))
    data = [(float(classes.index(f)), Vectors.sparse(len(known), [(int(x), 1.0) for x in features[ends[i]:ends[i + 1]]])) for i, (f, _) in enumerate(used)]
    fitted = LogisticRegression(family="multinomial", regParam=2e-4, maxIter=60, standardization=False).fit(spark.createDataFrame(data, ["label", "features"]).coalesce(2))
    model = model._replace(weights=fitted.coefficientMatrix.toArray().T.copy(), bias=fitted.interceptVector.toArray())
    truth = np.array([classes.index(f) for f, _ in held])
    words = [words_of(s) for _, s in held]

    def loss(heat: float) -> float:
        cooled = model._replace(weights=model.weights / heat, bias=model.bias / heat)
        return -np.log(np.maximum(cooled.probabilities(words)[np.arange(len(held)), truth], 1e-12)).sum()

    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model._replace(weights=model.weights / heat, bias=model.bias / heat)


class Template(NamedTuple):
    family: str
    pairs: frozenset[tuple[str, str]]
    size: int
    least: float


def templates() -> list[Template]:
    pair = lambda w: frozenset(zip(w, w[1:]))
    out = {(family, pair(w)): Template(family, pair(w), len(w), LEAST_OVERLAP) for family, texts in TEMPLATES.items() for w in map(words_of, texts)}
    short = [(family, form.format(name)) for family, names in NAMES.items() for name in names for form in FORMS]
    for a, b in ((a, b) for a in NAMES for b in NAMES if a != b):
        short += [(family, form.format(x, y)) for x in NAMES[a] for y in NAMES[b] for form in CHOICES for family in (a, b)]
    for family, text in short:
        w = words_of(text)
        out.setdefault((family, pair(w)), Template(family, pair(w), len(w), 1.0))
    return list(out.values())


class Notices:
    """The templates by their rarest pairs: one that is contained to its least share has one of a few of its pairs."""

    def __init__(self) -> None:
        found = templates()
        often = Counter(p for t in found for p in t.pairs)
        self.by_pair: dict[tuple[str, str], list[Template]] = {}
        for t in found:
            rare = sorted(t.pairs, key=lambda p: (often[p], p))
            # So many pairs may be missing; with one more, one of them is there.
            for p in rare[: int(len(rare) * (1 - t.least) + 1e-9) + 1]:
                self.by_pair.setdefault(p, []).append(t)
        self.keys = frozenset(self.by_pair)

    def near(self, words: list[str]) -> list[tuple[float, str, int, int]]:
        """(share, family, begin, end): the stretches of words, little longer than a template, with the largest shares."""
        pairs = set(zip(words, words[1:]))
        some = {id(t): t for p in self.keys & pairs for t in self.by_pair[p]}
        some = [t for t in some.values() if len(t.pairs & pairs) >= t.least * len(t.pairs)]
        if not some:
            return []
        out, asked = [], frozenset().union(*(t.pairs for t in some))
        at = [(i, p) for i, p in enumerate(zip(words, words[1:])) if p in asked]
        for t in some:
            room = t.size if t.least == 1 else t.size + t.size // 3 + 2
            have, first, hits = Counter(), 0, [(i, p) for i, p in at if p in t.pairs]
            best: tuple[float, int, int] | None = None
            for i, p in hits:
                have[p] += 1
                while hits[first][0] + room < i + 2:
                    have -= Counter([hits[first][1]])
                    first += 1
                share = len(have) / len(t.pairs)
                stretch = (share, hits[first][0], i + 2)
                if share >= t.least and (best is None or stretch[1] >= best[2]):
                    out += [(best[0], t.family, *best[1:])] if best else []
                    best = stretch
                elif best and share > best[0]:
                    best = stretch
            out += [(best[0], t.family, *best[1:])] if best else []
        return out


def proposed(lines: list[list[str]], model: Model) -> list[tuple[int, int, frozenset[str]]]:
    """(begin, end, families) of the lines of a paragraph, and of windows over it, that are not unknown."""
    words, units, at = sum(map(len, lines)), [], 0
    for line in lines:
        units.append((at, at + len(line)))
        at += len(line)
    units += [(i, min(i + UNIT, words)) for i in range(0, max(1, words - UNIT + STEP), STEP)]
    flat = [w for line in lines for w in line]
    p = model.probabilities([flat[i:j] for i, j in units])
    some = np.flatnonzero(p[:, 0] <= MOST_UNKNOWN)
    return [(*units[k], frozenset(model.classes[c] for c in np.flatnonzero(p[k] >= LEAST_PROBABILITY) if c)) for k in some]


def confirmed(lines: list[list[str]], notices: Notices, model: Model) -> list[tuple[float, float, str]]:
    """(probability, share, family) of the families that the classifier proposes in a paragraph and templates confirm.

    Of families at one place the nearest counts; probabilities are of the stretch with the words around it.
    """
    places = proposed(lines, model)
    if not places:
        return []
    words = [w for line in lines for w in line]
    asked = lambda family, begin, end: any(family in families and i < end and begin < j for i, j, families in places)
    near = [x for x in notices.near(words) if asked(*x[1:])]
    if not near:
        return []
    p = model.probabilities([words[max(0, begin - AROUND):end + AROUND] for _, _, begin, end in near])
    own = [p[k, model.classes.index(family)] for k, (_, family, _, _) in enumerate(near)]
    scored = sorted(((share, float(own[k]), family, begin, end) for k, (share, family, begin, end) in enumerate(near) if own[k] >= LEAST_PROBABILITY and p[k, 0] <= MOST_UNKNOWN), reverse=True)
    taken: list[tuple[float, float, str, int, int]] = []
    for x in scored:
        rival = (t for t in taken if t[2] != x[2] and t[3] < x[4] and x[3] < t[4])
        if all(t[0] == x[0] == 1 for t in rival):
            taken.append(x)
    return [(round(chance, 6), round(share, 6), family) for share, chance, family, *_ in taken]


RESULT = "n_paragraphs long, n_licence_paragraphs long, families string, family string, probability double, similarity double"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, n_paragraphs, n_licence_paragraphs, families, family, probability, similarity.

    Paragraphs are parted by lines without a word. families lists all that are proposed and confirmed; family,
    probability and similarity are of the most probable confirmed one, null without any. Null and empty texts have no paragraphs;
    repeated rows each get their row; other columns are ignored; an empty table gives an empty result.
    """

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        notices = Notices()
        for batch in batches:
            rows = []
            for text in batch:
                lines = [words_of(line) for line in (text or "").split("\n")]
                paragraphs = [list(group) for some, group in groupby(lines, bool) if some]
                found = [(*x, k) for k, paragraph in enumerate(paragraphs) for x in confirmed(paragraph, notices, model)]
                top = max(found, default=(None, None, None))
                rows.append((len(paragraphs), len({k for *_, k in found}), ",".join(sorted({f for _, _, f, _ in found})), top[2], top[0], top[1]))
            yield pd.DataFrame(rows, columns=["n_paragraphs", "n_licence_paragraphs", "families", "family", "probability", "similarity"])

    return docs.select("doc_id", F.explode(F.array(run("text"))).alias("x")).select("doc_id", "x.*")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), fit(spark))


QUERIES = {"op5_licence_scan": op5_licence_scan}
ORACLES: dict[str, str] = {}
