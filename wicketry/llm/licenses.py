"""Licence notices by a paragraph classifier: sparse word n-gram logistic regression, confirmed by template comparison.

Paragraphs are blocks between blank lines, with wrapped lines joined. They are scored in overlapping windows of ``WINDOW`` words,
so a notice is met whole inside a long paragraph. A window's features are its distinct words and word pairs; one logistic
regression for each licence family and one for ``unknown`` give probabilities, so that notices of two families that stand
together are both found; a temperature fitted on notices and sentences that took no part in training calibrates them. A
family stands if its probability is at least ``MIN_PROBABILITY``, above that of ``unknown``, and the window holds
``MIN_TEMPLATE`` of the n-grams of one of its templates.

The model is fitted on the driver from the fixed texts below, not from the corpus. Scoring is DataFrame functions only.
No window without one of the ``CUES`` can hold enough of a template (they are derived from the templates for that), so only
paragraphs that have one are taken apart into n-grams, which are joined with the weights (a table bounded by the templates'
vocabulary, so it is broadcast).

Defined results: null and empty texts have no notice; repeated rows get equal results; rows without a doc_id are scanned too;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, doc_id, keyed, table

# Public notices and sentences of public licence texts, by family.
NOTICES = {
    "AGPL": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "See the License for the specific language governing permissions and limitations under the License", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Licensed under the 3-clause BSD license",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is dedicated to the public domain.", "SPDX-License-Identifier: CC0-1.0"],
    "EPL": ["made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-only"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages", "SPDX-License-Identifier: Zlib"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. No part may be reproduced without permission."],
}
# Other wordings, for calibration only.
HELD = {
    "AGPL": ["is free software: you can redistribute it under the GNU Affero General Public License version 3 or later"], "Apache-2.0": ["This project is made available under the Apache License 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "BSD": ["Use of this source code is governed by a BSD-style license", "Redistribution and use in source and binary forms, with or without modification, are permitted"], "BSL-1.0": ["Use is subject to the Boost Software License 1.0"],
    "CC-BY": ["Text is available under CC BY 4.0", "released under the Creative Commons Attribution 4.0 license"], "CC-BY-NC": ["Images are licensed under CC BY-NC 4.0"], "CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License 4.0"],
    "CC0": ["released under CC0 1.0, dedicated to the public domain"], "EPL": ["This program is under the Eclipse Public License v2.0"], "GPL": ["is free software: you can redistribute it and/or modify it under the GNU General Public License, version 3 or later"],
    "ISC": ["This package is under the ISC License"], "LGPL": ["you can redistribute it under the GNU Lesser General Public License, either version 2.1"], "MIT": ["This project is licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy"],
    "MPL": ["covered by the Mozilla Public License 2.0"], "Unlicense": ["free and unencumbered software in the public domain"], "zlib": ["This software is provided 'as-is', without any express or implied warranty"], "proprietary": ["Copyright 2019 Example. All rights reserved", "(c) The authors. All Rights Reserved."],
}
# Sentences that aren't notices.
ORDINARY = [
    "The general met the public in the version of the story that we know.", "Under the bridge the work went on without a pause.", "A driver's license was found in the river.", "She has a license to sell fish in the market.",
    "The software was slow and the library was closed.", "All of them reserved a table.", "The rights of the public were discussed in general terms.", "He released the bird under the tree.",
    "The terms of the contract were changed without notice.", "Attribution of the painting to the old master is in doubt.", "Use the second form for the source of income.", "Version two of the plan was permitted by law.",
    "The foundation was laid in spring.", "This work is hard and the pay is low.", "Free of charge, the guide took us to a hill.", "They licensed the song for a film.", "Copyright law was on the list of subjects.",
    "No part of the city was without water.", "You can read it or sell it for any purpose.", "The name of the holder is on the copy.",
]
# Sentences for calibration only.
ORDINARY_HELD = [
    "The public license office opens at nine.", "He sold copies of the book and the software.", "All rights of way were closed in the storm.", "The commons is open to the public.", "Permission to enter the park was given by the general.",
    "It is to be used in the form in which it was made.", "The source of the river is in the hills.", "A notice on the door said that the library is closed.",
]
FAMILIES = [*NOTICES, "unknown"]
WORD = re.compile(r"[a-z0-9]+")
MIN_PROBABILITY, MIN_TEMPLATE = 0.5, 0.6
#: Words of a window, and words from one to the next; a template has at most WINDOW - STEP words.
WINDOW, STEP = 64, 32
BLANK_LINES = r"\n[ \t\r]*\n"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def grams(words: list[str]) -> set[int]:
    """Hashes of words and word pairs, as Spark's xxhash64 gives them."""
    import xxhash

    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    two = [xxhash.xxh64_intdigest(w.encode(), h) for h, w in zip(one, words[1:], strict=False)]
    return {signed(h) for h in one + two}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


# Fixed value: a template that only windows with this word confirm ("all rights" alone, three fifths of its n-grams, is no notice).
NEEDED = {"All rights reserved.": "reserved"}
# Words that are no cues if others do.
COMMON = set("a all an and any are as at be by for has in into is its may no not of on only or part see that the this to under use used will with work you".split())


def cues() -> list[str]:
    """Words of which every window that holds MIN_TEMPLATE of a template's n-grams has one.

    For each template so many of its words, common ones last and long ones first, that its n-grams without any of them are too
    few to pass. So paragraphs without a cue are left out without a change of the result.
    """
    out: set[str] = set()
    for text in (x for texts in NOTICES.values() for x in texts):
        template = words_of(text)
        if text in NEEDED:
            out.add(NEEDED[text])
            continue
        every = {(w,) for w in template} | set(zip(template, template[1:], strict=False))
        passes = lambda chosen: sum(not chosen & set(g) for g in every) >= MIN_TEMPLATE * len(every)  # noqa: E731, B023
        chosen: set[str] = set()
        for w in sorted(set(template), key=lambda w: (w in COMMON, w not in out, -len(w), w)):
            if not passes(chosen):
                break
            chosen.add(w)
        for w in sorted(chosen, key=lambda w: (w not in COMMON, len(w), w)):
            if not passes(chosen - {w}):
                chosen.discard(w)
        out |= chosen
    return sorted(out)


CUES = cues()


class Classifier:
    """n-grams, weights and biases by family (divided by the temperature), and templates."""

    def __init__(self):
        rng = np.random.RandomState(17)
        sentences = [words_of(x) for x in ORDINARY]
        templates = [(f, words_of(x)) for f, texts in NOTICES.items() for x in texts]
        if max(len(w) for _, w in templates) > WINDOW - STEP:
            raise ValueError("a template is longer than what windows overlap by")
        self.templates = [(f, sorted(grams(w))) for f, w in templates]
        self.vocabulary = sorted({g for _, t in self.templates for g in t})
        self.place = {g: i for i, g in enumerate(self.vocabulary)}

        def around(parts: list[list[str]], prose: list[list[str]]) -> list[str]:
            """The parts in order, with ordinary sentences before, between and after."""
            out: list[str] = []
            for p in [*parts, None]:
                for _ in range(rng.randint(0, 3)):
                    out += prose[rng.randint(len(prose))]
                out += p or []
            return out

        def rows(notices: dict[str, list[str]], prose: list[list[str]], times: int) -> tuple[np.ndarray, np.ndarray]:
            x, y = [], []
            every = [(FAMILIES.index(f), words_of(t)) for f, texts in notices.items() for t in texts]
            for k, w in every:
                for i in range(times):
                    part = [v for v in w if i == 0 or rng.rand() > 0.1] or w
                    both = [(k, part), every[rng.randint(len(every))]] if i % 4 == 3 else [(k, part)]
                    x.append(self.row(around([v for _, v in both], prose) if i else part))
                    y.append(np.isin(np.arange(len(FAMILIES)), [c for c, _ in both]).astype(float))
            for i in range(times * 12):
                x.append(self.row(around([prose[i % len(prose)]], prose)))
                y.append((np.arange(len(FAMILIES)) == len(FAMILIES) - 1).astype(float))
            return np.array(x), np.array(y)

        def shuffled(times: int) -> tuple[np.ndarray, np.ndarray]:
            """Words of notices out of order, among ordinary sentences: no notices."""
            every = sorted({v for _, w in templates for v in w})
            x = [self.row(around([[every[k] for k in rng.randint(0, len(every), rng.randint(1, 9))]], sentences)) for _ in range(times)]
            return np.array(x), np.tile((np.arange(len(FAMILIES)) == len(FAMILIES) - 1).astype(float), (times, 1))

        x, y = map(np.concatenate, zip(rows(NOTICES, sentences, 16), shuffled(400), strict=True))
        w, b = np.zeros((x.shape[1], y.shape[1])), np.full(y.shape[1], -2.0)
        weight = 1 + 4 * y  # a family has few of the rows
        for _ in range(400):
            err = weight * (1 / (1 + np.exp(-(x @ w + b))) - y) / len(x)
            w -= 8.0 * (x.T @ err + 2e-5 * w)
            b -= 8.0 * err.sum(0)
        hx, hy = rows(HELD, [words_of(s) for s in ORDINARY_HELD], 8)
        loss = {t: -np.log(np.clip(np.where(hy > 0, p := 1 / (1 + np.exp(-(hx @ w + b) / t)), 1 - p), 1e-12, 1)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
        t = min(loss, key=loss.get)
        self.w, self.b, self.held = w / t, b / t, (hx, hy)

    def row(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.vocabulary))
        out[[self.place[g] for g in grams(words) if g in self.place]] = 1
        return out


@lru_cache(maxsize=1)
def fitted() -> Classifier:
    return Classifier()


def notices(docs: DataFrame) -> DataFrame:
    """d, h, paragraph (from 0), window, family, probability and template_share of every window and family that passes; ``docs`` as common.keyed gives them."""
    m = fitted()
    spark = docs.sparkSession
    names = [f"w{k}" for k in range(len(FAMILIES))]
    weights = spark.createDataFrame([(g, *map(float, m.w[i])) for i, g in enumerate(m.vocabulary)], ", ".join(["gram bigint", *(f"{n} double" for n in names)]))
    parts = docs.select("d", "h", F.posexplode(F.split(F.lower("text"), BLANK_LINES)).alias("paragraph", "text"))
    words = parts.select("d", "h", "paragraph", F.array_remove(F.split("text", "[^a-z0-9]+"), "").alias("a")).filter(F.arrays_overlap("a", F.array(*map(F.lit, CUES))))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("a") - 1 - STEP), F.lit(STEP))
    windows = words.select("d", "h", "paragraph", "a", F.posexplode(starts).alias("window", "at")).select("d", "h", "paragraph", "window", F.slice("a", F.col("at") + 1, WINDOW).alias("a"))
    windows = windows.distinct()  # rows of equal d and h are one document
    keys = ["d", "h", "paragraph", "window"]
    pairs = windows.select(*keys, F.explode(F.arrays_zip(F.col("a").alias("a"), F.slice("a", 2, F.greatest(F.size("a"), F.lit(1))).alias("b"))).alias("p"))
    both = pairs.select(*keys, F.explode(F.array(F.xxhash64("p.a"), F.when(F.col("p.b").isNotNull(), F.xxhash64("p.a", "p.b")))).alias("gram"))
    once = both.join(F.broadcast(weights), "gram").dropDuplicates([*keys, "gram"])  # weights are bounded by the templates' vocabulary
    sums = once.groupBy(*keys).agg(*(F.sum(F.round(F.col(n), 9)).alias(n) for n in names), F.collect_set("gram").alias("grams"))
    needed = {tuple(sorted(grams(words_of(t)))): next(iter(grams([w]))) for t, w in NEEDED.items()}

    def share(g: list[int]) -> Column:
        part = F.round(F.size(F.array_intersect("grams", F.array(*map(F.lit, g)))) / float(len(g)), 6)
        return F.when(F.array_contains("grams", needed[tuple(g)]), part).otherwise(0.0) if tuple(g) in needed else part

    chance = lambda k: F.round(1 / (1 + F.exp(-(F.col(names[k]) + float(m.b[k])))), 6)
    each = F.array(*(F.struct(F.lit(f).alias("family"), chance(k).alias("probability"), F.greatest(F.lit(0.0), *(
        share(g) for own, g in m.templates if own == f)).alias("template_share")) for k, f in enumerate(FAMILIES[:-1])))
    found = sums.select(*keys, chance(len(FAMILIES) - 1).alias("unknown"), F.explode(each).alias("x")).select(*keys, "unknown", "x.*")
    passes = (F.col("probability") >= MIN_PROBABILITY) & (F.col("probability") > F.col("unknown")) & (F.col("template_share") >= MIN_TEMPLATE)
    return found.filter(passes).drop("unknown")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, families (sorted, comma-joined; 'unknown' without any), n_notices (paragraphs and families), best_probability."""
    docs = keyed(docs)
    found = cut(notices(docs).groupBy("d", "h", "paragraph", "family").agg(F.max("probability").alias("probability")), "notices")
    each = found.groupBy("d", "h").agg(
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.count("*").alias("n_notices"), F.max("probability").alias("best_probability"))
    return docs.select("d", "h").join(each, ["d", "h"], "left").select(
        doc_id(), F.coalesce("families", F.lit("unknown")).alias("families"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("best_probability", F.lit(0.0)).alias("best_probability"))


def op5_licenses(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
