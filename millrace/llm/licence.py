"""Licence scan: a trained paragraph classifier in SQL, confirmed against templates.

Paragraphs are the lines of a text and, since notices are wrapped, runs of up to ``JOIN`` adjacent lines of at most
``WRAP`` signs without a blank line between them. A sparse n-gram logistic regression (words and word pairs, one class
for each family and one for anything else) is trained here on ``TEMPLATES`` with cut, reworded and joined variants; the
unknown class is ordinary sentences and notices that name a made-up licence, so that the words that all notices share
speak for no family. Its temperature is calibrated on held-out variants of both. Scoring is one SQL expression over
each paragraph: features that are in the model's vocabulary are looked up in a broadcast weight table of fixed size and
summed by paragraph. The best family counts if its calibrated probability is ``MIN_PROBABILITY`` or more and the best of
its templates confirms it: the paragraph has ``MIN_OVERLAP`` of the template's n-grams, weighted by how few families use
them. Training is plain driver arithmetic over constants, so the model does not depend on the corpus.

Before that, plain strings narrow the paragraphs down (``HINTS``, then ``TRIGGERS``): all templates have them, and a
notice worded without any of them is not found. This is the one step that does not follow the trained model; scoring
the n-grams of every line of every text costs several times as much.

Defined results: null and empty texts have no licence; each paragraph is judged alone; a text's families are listed
once each in order; between families of equal score the first in order of name wins; repeated documents and null ids
are kept row by row; texts of any length are read whole; an empty table gives no rows; other columns than doc_id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UNKNOWN = "unknown"
MIN_PROBABILITY = 0.6
JOIN, WRAP = 4, 160
MIN_OVERLAP = 0.5
EPOCHS, RATE, RIDGE = 40, 0.5, 1e-4
#: Common abbreviated notices and the opening words of the licences' own notices, by family.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "Licensed under Apache 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under GPL version 2 or later.", "Licensed under GPL-3.0.", "Licensed under the GPLv3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Licensed under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the 2-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under CC BY 3.0."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0."],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under AGPL version 3."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense.", "SPDX-License-Identifier: Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright the authors. All rights reserved.", "This document is confidential and proprietary. No part may be reproduced without permission."],
}
ORDINARY = [
    "The driver must hold a valid license at all times.", "He asked for permission to leave the room early.", "A version of the story was told in the city.", "The public library is open on general holidays.", "This work is about a river and its people.",
    "They released a new record last spring.", "You may use the tool under the table.", "The apache helicopter landed in the field.", "Students at the institute in Massachusetts met.", "All of the rights of the king were reserved for the sons.", "The terms of the contract were read aloud.",
    "Free software was the subject of the talk.", "Copyright law has changed over the years.", "The creative team and the commons committee met.", "It was a general and public matter of the state.", "The foundation of the house is old.", "And the cat sat on the mat under the sun.", "We can redistribute the seats if you modify the plan.",
    "MIT is a school near the river.", "He studied at MIT under a famous teacher.", "Version 2 of the form is here.", "The restaurant lost its liquor license in May.", "A permission slip is required for the trip.", "Their license plate was from another state.",
]
#: Notices of licences that are in no family; the name is made up for each variant.
GENERIC = ["Licensed under the {} License.", "Released under the {} license, version {}.", "Distributed under the terms of the {} Public License.", "SPDX-License-Identifier: {}-{}", "This work is licensed under the {} Licence {}.", "This software is free software under the {} Software License {}.", "You may copy and modify this file under the terms of the {} General License, version {}."]
#: Only paragraphs that hold one of these are candidates: all templates do, and a line without them names no licence.
TRIGGERS = r"licen[sc]|gpl|\bgnu\b|\bmit\b.*under|under.*\bmit\b|\bbsd\b|\bmpl\b|apache|creative commons|\bcc[ 0-]|redistribut|permission|rights reserved|confidential|spdx|copyright|public domain|unencumbered|free software"
#: Plain strings of which each trigger needs one set; looked for first, since that costs far less than the pattern.
HINTS = [("licens",), ("licenc",), ("gpl",), ("gnu",), ("mit", "under"), ("bsd",), ("mpl",), ("apache",), ("creative commons",), ("cc ",), ("cc0",), ("cc-",), ("redistribut",), ("permission",), ("rights reserved",), ("confidential",), ("spdx",), ("copyright",), ("public domain",), ("unencumbered",), ("free software",)]
_WORD = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")


def grams(text: str) -> list[str]:
    """Distinct words and word pairs of a paragraph."""
    words = _WORD.findall(text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _variants(rng: random.Random, text: str, fill: list[str], n: int) -> list[str]:
    out = [text, text.upper(), text.lower()]
    words = text.split()
    for _ in range(n):
        own = [w for w in words if rng.random() > 0.12] if len(words) > 6 else list(words)
        if rng.random() < 0.5:
            own = rng.choices(fill, k=rng.randint(1, 8)) + own
        if rng.random() < 0.5:
            own = own + rng.choices(fill, k=rng.randint(1, 8))
        out.append(" ".join(own))
    return out


class Model:
    """Weights by n-gram (one number for each class), intercepts, temperature and the templates' n-grams."""

    def __init__(self, classes: list[str], weights: dict[str, list[float]], bias: list[float], temperature: float):
        self.classes, self.weights, self.bias, self.temperature = classes, weights, bias, temperature
        users: dict[str, set[str]] = {}
        for family, texts in TEMPLATES.items():
            for g in (g for t in texts for g in grams(t)):
                users.setdefault(g, set()).add(family)
        rare = {g: math.log((1 + len(TEMPLATES)) / len(own)) for g, own in users.items()}
        #: (family, share of each n-gram) of each template; an n-gram that fewer families use has a larger share.
        self.templates = [(family, {g: rare[g] / sum(rare[x] for x in own) for g in own}) for family, texts in TEMPLATES.items() for own in map(grams, texts)]

    def probabilities(self, text: str) -> list[float]:
        found = [self.weights[g] for g in grams(text) if g in self.weights]
        size = math.sqrt(max(1, len(found)))
        z = [(b + sum(w[k] for w in found) / size) / self.temperature for k, b in enumerate(self.bias)]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        return [x / sum(e) for x in e]

    def judge(self, text: str) -> tuple[str, float, float]:
        """Family (or unknown), its probability, and the best template's share that the paragraph has."""
        p = self.probabilities(text)
        k = max(range(len(p)), key=lambda i: (p[i], -i))
        own = set(grams(text))
        overlap = max((sum(share for g, share in t.items() if g in own) for family, t in self.templates if family == self.classes[k]), default=0.0)
        sure = self.classes[k] != UNKNOWN and p[k] >= MIN_PROBABILITY and overlap >= MIN_OVERLAP - 1e-9 and re.search(TRIGGERS, text.lower())
        return (self.classes[k] if sure else UNKNOWN), p[k], overlap


@lru_cache(1)
def train() -> Model:
    """Multinomial logistic regression by stochastic gradients over the variants; every fifth is held out to calibrate."""
    rng = random.Random(7)
    fill = [w for t in ORDINARY for w in t.split()]
    rows = [(family, v) for family, texts in TEMPLATES.items() for t in texts for v in _variants(rng, t, fill, 24)]
    rows += [(UNKNOWN, v) for t in ORDINARY for v in _variants(rng, t, fill, 12)] + [(UNKNOWN, " ".join(rng.choices(fill, k=rng.randint(1, 30)))) for _ in range(300)]
    for _ in range(40):
        for t in GENERIC:
            name = "".join(rng.choices("abcdefghiklmnoprstuvwyz", k=rng.randint(3, 9)))
            rows += [(UNKNOWN, _variants(rng, t.format(name, rng.choice(("1.0", "2.0", "2.1", "3", "3.0", "4.0"))), fill, 1)[-1])]
    rng.shuffle(rows)
    classes = [*sorted(TEMPLATES), UNKNOWN]
    vocabulary = {g for texts in TEMPLATES.values() for t in texts for g in grams(t)} | {g for t in ORDINARY + GENERIC for g in grams(t)}
    weights = {g: [0.0] * len(classes) for g in sorted(vocabulary)}
    bias = [0.0] * len(classes)
    bias[-1] = 1.0
    model = Model(classes, weights, bias, 1.0)
    held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    data = [(classes.index(y), [weights[g] for g in grams(t) if g in weights], t) for y, t in used]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 5)
        for y, found, _ in data:
            size = math.sqrt(max(1, len(found)))
            z = [b + sum(w[k] for w in found) / size for k, b in enumerate(bias)]
            top = max(z)
            e = [math.exp(x - top) for x in z]
            total = sum(e)
            for k in range(len(classes)):
                step = rate * ((k == y) - e[k] / total)
                if abs(step) > 1e-4:
                    bias[k] += 0.1 * step
                    step /= size
                    for w in found:
                        w[k] += step - rate * RIDGE * w[k]
    best = (math.inf, 1.0)
    for temperature in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        model.temperature = temperature
        loss = -sum(math.log(max(1e-12, model.probabilities(t)[classes.index(y)])) for y, t in held)
        best = min(best, (loss, temperature))
    model.temperature = best[1]
    return model


def hinted(column: str) -> Column:
    """Whether a lower-case text holds the strings of a trigger."""
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (F.col(column).contains(x) for x in hint)) for hint in HINTS))


def paragraphs(low: str) -> list[str]:
    """The paragraphs of a lower-case text that hold a trigger on a line of their own: the line, and the runs around it."""
    lines = low.split("\n")
    out = []
    for i, line in enumerate(lines):
        if any(all(h in line for h in hint) for hint in HINTS) and re.search(TRIGGERS, line):
            for first in range(i - JOIN + 1, i + 1):
                for last in range(i, first + JOIN):
                    run = lines[max(first, 0) : last + 1]
                    if first >= 0 and last < len(lines) and (len(run) == 1 or all(x.strip(" ") and len(x) <= WRAP for x in run)):
                        out.append(" ".join(run))
    return out


def triggered(docs: DataFrame) -> DataFrame:
    """key (digest of the text), line (lower case), for the paragraphs with a trigger of each different text; written."""
    texts = docs.select("text", F.lower("text").alias("low")).where(hinted("low")).select(F.md5("text").alias("key"), F.split("low", "\n").alias("lines"))
    # each line beside the JOIN - 1 lines before and behind it: the array, shifted
    reach = JOIN - 1
    edge = F.array(*[F.lit(None).cast("string")] * reach)
    padded = texts.select("key", F.concat(edge, "lines", edge).alias("lines"), F.size("lines").alias("n"))
    shifted = F.arrays_zip(*(F.slice("lines", F.lit(d + 1), F.col("n")).alias(f"l{d}") for d in range(2 * reach + 1)))
    near = padded.select("key", F.explode(shifted).alias("x")).select("key", "x.*").where(hinted(f"l{reach}")).where(F.col(f"l{reach}").rlike(TRIGGERS))
    runs = [F.col(f"l{reach}")]
    for first in range(reach + 1):
        for last in range(reach, first + JOIN):
            if first < last:
                run = [F.col(f"l{d}") for d in range(first, last + 1)]
                fits = reduce(lambda a, b: a & b, ((F.length(x) <= WRAP) & (F.trim(x) != "") for x in run))
                runs.append(F.when(fits, F.concat_ws(" ", *run)))
    return written(near.select("key", F.explode(F.array_compact(F.array(*runs))).alias("line")).distinct(), "licence-lines", compact=True)


def features(lines: DataFrame) -> DataFrame:
    """line and g, its distinct words and word pairs, for each different line."""
    rows = lines.select("line").distinct().withColumn("w", F.regexp_extract_all("line", F.lit(r"[a-z0-9]+(?:[.][0-9]+)*"), F.lit(0))).where("size(w) > 0")
    return rows.select("line", F.expr("array_distinct(concat(w, zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b))))").alias("g"))


def _constant(spark: SparkSession, rows: list[dict], fields: str) -> DataFrame:
    """A table of constants, as a literal in the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")))


def classify(spark: SparkSession, lines: DataFrame, model: Model) -> DataFrame:
    """line, family, probability and overlap of distinct paragraphs (line, g)."""
    n = len(model.classes)
    weights = _constant(spark, [{"gram": g, "w": w} for g, w in model.weights.items()], "gram:string,w:array<double>")
    templates = _constant(spark, [{"gram": g, "template": i, "own": family, "part": share} for i, (family, t) in enumerate(model.templates) for g, share in t.items()], "gram:string,template:int,own:string,part:double")
    found = lines.select("line", F.explode("g").alias("gram"))
    sums = [F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(n)]
    score = found.join(F.broadcast(weights), "gram").groupBy("line").agg(*sums, F.count("*").alias("n"))
    z = F.array(*((F.lit(model.bias[k]) + F.col(f"z{k}") / F.sqrt("n")) / model.temperature for k in range(n)))
    score = score.withColumn("z", z).withColumn("top", F.array_max("z"))
    score = score.select("line", F.element_at(F.array(*map(F.lit, model.classes)), F.array_position("z", F.col("top")).cast("int")).alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("probability"))
    share = found.join(F.broadcast(templates), "gram").groupBy("line", "template", "own").agg(F.sum("part").alias("part")).groupBy("line", F.col("own").alias("family")).agg(F.max("part").alias("overlap"))
    return score.join(share, ["line", "family"]).where((F.col("family") != UNKNOWN) & (F.col("probability") >= MIN_PROBABILITY) & (F.col("overlap") >= MIN_OVERLAP - 1e-9))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (families in order, comma-joined), n_families and the least probability among the families' best paragraphs."""
    lines = triggered(docs)
    sure = classify(docs.sparkSession, features(lines), train())
    best = lines.join(sure, "line").groupBy("key", "family").agg(F.max("probability").alias("probability"))
    by_text = best.groupBy("key").agg(F.array_sort(F.collect_list("family")).alias("families"), F.min("probability").alias("least"))
    out = docs.select("doc_id", F.md5("text").alias("key")).join(written(by_text, "licences"), "key", "left")
    return out.select("doc_id", F.coalesce(F.array_join("families", ","), F.lit("")).alias("licences"), F.greatest(F.size("families"), F.lit(0)).cast("long").alias("n_families"), F.round("least", 6).alias("least_probability"))


def op9_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families of every document."""
    return scan(table(spark, sf_dir, "documents"))
