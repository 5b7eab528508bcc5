"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a line that holds at least one cue word, and a run of two or more such lines (a notice that is wrapped);
a run counts only where none of its lines names a family. Cue words are template words that the corpus's lines
(nearly) never use, counted over all of them but those with three words in a row of a template. Features are word
n-grams (one to three words) of the templates that hold a cue word. A multinomial logistic regression is trained on
pieces of the templates, one class a family, against a bounded sample of the corpus's distinct lines, the class
``unknown``. A part of both is held back from training: on it a temperature is fitted that calibrates the
probabilities, and a family is named above one half and above nearly all of what the model gives a family on the
held-back lines (a quantile). A named family stands if enough of the paragraph's n-grams are those of one of its
templates.

A paragraph without a cue word has no feature at all; the model calls that unknown (checked when it is fitted), so
only documents with a cue word are taken apart. Everything is DataFrame operations and JVM-side feature and
regression stages; nothing runs Python on the executors. Driver: the template words' counts, and the raw scores of the
held-back lines (at most the sample).

Defined results: null and empty texts have no licence. Rows are judged one by one, repeated rows and null ids
included. Extra columns are not read. Without documents there is no negative example, and no row either.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import numbered, store

UNKNOWN = "unknown"

#: Short notices and opening clauses of each family.
TEMPLATES = {
    "AGPL-3.0": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "ISC": (
        "Licensed under the ISC license.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
}


def words_of(text: Column) -> Column:
    """Runs of letters and digits, ASCII lower-cased; hyphens and dots within versions count as separators."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")


def grams_of(words: Column, longest: int = 3) -> Column:
    """Distinct word n-grams of one to ``longest`` words."""
    n = F.size(words)

    def part(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))
        return F.when(n >= k, runs).otherwise(F.array().cast("array<string>"))

    parts = [part(k) for k in range(1, longest + 1)]
    return F.array_distinct(F.concat(*parts))


def plain_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]


def plain_grams(words: list[str], longest: int = 3) -> list[str]:
    return sorted({" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)})


def pieces(text: str) -> list[list[str]]:
    """A template whole, and its windows of some lengths, as training examples."""
    w = plain_words(text)
    found = [w]
    for size in (8, 14, 22):
        found += [w[at : at + size] for at in range(0, max(0, len(w) - size), max(1, size // 3))]
    return found


@dataclass
class Scanner:
    cues: list[str]
    vectors: CountVectorizerModel
    model: LogisticRegressionModel
    classes: list[str]
    temperature: float
    least: float
    agree: float


def calibrated(raw: np.ndarray, temperature: float) -> np.ndarray:
    """Probabilities of raw scores (rows of classes) at a temperature."""
    x = np.exp((raw - raw.max(1, keepdims=True)) / temperature)
    return x / x.sum(1, keepdims=True)


def temperature_of(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of least weighted cross-entropy, on a grid from a quarter to 16 in steps of 2 ** 0.125."""
    grid = 2.0 ** np.arange(-2, 4.01, 0.125)
    loss = [-(weight * np.log(np.maximum(calibrated(raw, t)[np.arange(len(raw)), label], 1e-12))).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, negatives: int = 4000, rare: float = 0.002, agree: float = 0.6, quantile: float = 0.999) -> Scanner:
    """Train on the templates against at most ``negatives`` distinct lines of the corpus, those of the smallest hashes.

    Lines that hold three words in a row of a template count neither as negative examples nor against a cue word."""
    spark = docs.sparkSession
    every = {f: [plain_words(t) for t in texts] for f, texts in TEMPLATES.items()}
    threes = sorted({" ".join(w[i : i + 3]) for ws in every.values() for w in ws for i in range(len(w) - 2)})
    template_words = sorted({x for ws in every.values() for w in ws for x in w})
    starts, seconds = (sorted({t.split(" ")[k] for t in threes}) for k in (0, 1))

    def quoted(words: Column) -> Column:
        """Three words in a row of a template; the first two are looked up alone, which most places end at."""
        at = lambda i: (F.get(words, i).isin(*starts)) & (F.get(words, i + 1).isin(*seconds)) & F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).isin(*threes)
        return F.when(F.size(words) >= 3, F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), at)).otherwise(False)

    # Words are made within the generator: a filter on them would be pushed below a projection and make them anew
    # for every word that it looks at.
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    own = lambda words: F.array_distinct(F.filter(words, lambda w: w.isin(*template_words)))
    worded = docs.select(F.explode(F.transform(F.transform(lines, words_of), lambda w: F.struct(w.alias("words"), own(w).alias("own")))).alias("x")).select("x.*")
    worded = worded.where((F.size("own") < 3) | ~quoted(F.col("words")))
    # The empty word counts the lines.
    used = worded.select(F.explode(F.array_append("own", "")).alias("w")).groupBy("w").count()
    counts = {r.w: r["count"] for r in used.collect()}  # of the template words alone, so bounded by them
    n_lines = max(1, counts.pop("", 0))
    cues = [w for w in template_words if counts.get(w, 0) <= rare * n_lines and not w.isdigit() and len(w) > 1]
    cue_set = set(cues)
    share = min(1.0, 4 * negatives / n_lines)
    drawn = docs.select(F.explode(lines).alias("line")).withColumn("h", F.xxhash64("line")).where(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).distinct()
    drawn = drawn.select("line", "h", F.explode(F.array(words_of(F.col("line")))).alias("words")).where(~quoted(F.col("words"))).orderBy("h", "line").limit(negatives)
    sample = store(drawn.select(grams_of(F.col("words")).alias("grams"), F.pmod("h", F.lit(4)).alias("fold")).where(F.size("grams") > 0))
    vocabulary = sorted({g for ws in every.values() for w in ws for g in plain_grams(w) if cue_set & set(g.split(" "))})
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    # Each family weighs as much as the others, each template as the family's others, and a whole template as much
    # as its windows together; the negative examples weigh as much as all families. Every fourth window is held back.
    rows: list[tuple[list[str], float, float, bool]] = [([], 0.0, 1.0, False)]
    for f, texts in TEMPLATES.items():
        for t in texts:
            whole, *windows = [plain_grams(w) for w in pieces(t) if cue_set & set(w)] or [[]]
            part = 1 / len(texts) / (2 if windows else 1)
            rows += [(w, float(classes.index(f)), part / len(windows), k % 4 == 3) for k, w in enumerate(windows)]
            rows.append((whole, float(classes.index(f)), part, False))
    n_negative = sample.count()
    weight = len(TEMPLATES) / max(1, n_negative)
    examples = spark.createDataFrame(rows, "grams array<string>, label double, weight double, held boolean").unionByName(sample.select("grams", F.lit(0.0).alias("label"), F.lit(weight).alias("weight"), (F.col("fold") == 0).alias("held")))
    examples = store(vectors.transform(examples).select("features", "label", "weight", "held").coalesce(2))
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=1e-6, standardization=False, weightCol="weight").fit(examples.where("not held"))
    held = model.transform(examples.where("held")).select(vector_to_array("rawPrediction").alias("raw"), "label", "weight").collect()
    empty = model.transform(vectors.transform(spark.createDataFrame([([],)], "grams array<string>"))).first()
    if int(empty.prediction) != 0:
        raise ValueError("the classifier doesn't call a paragraph without features unknown")
    raw, label = np.array([r.raw for r in held]).reshape(-1, len(classes)), np.array([int(r.label) for r in held], dtype=int)
    temperature = temperature_of(raw, label, np.array([r.weight for r in held])) if len(held) else 1.0
    other = calibrated(raw, temperature)[label == 0, 1:].max(1) if (label == 0).any() else np.zeros(1)
    return Scanner(cues, vectors, model, classes, temperature, max(0.5, float(np.quantile(other, quantile))), agree)


def scan(docs: DataFrame, scanner: Scanner | None = None, **fitting) -> DataFrame:
    """doc_id and licences (array of line, lines, family, probability, agreement; in order of lines) for each row.

    ``line`` is the first of a paragraph, ``lines`` how many it has."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scanner = scanner or fit(docs, **fitting)
    has_cue = lambda words: F.exists(words, lambda w: w.isin(*scanner.cues))
    found = "array<struct<line:int,lines:int,family:string,probability:double,agreement:double>>"
    rows = docs.withColumn("cue", has_cue(words_of(F.col("text"))))
    rest = rows.where("not cue").select("doc_id", F.expr(f"cast(array() as {found})").alias("licences"))
    lines = numbered(rows.where("cue").select("doc_id", "text")).select("rid", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "paragraph"))
    lines = lines.select("rid", "doc_id", "line", words_of(F.col("paragraph")).alias("words")).where(has_cue(F.col("words")))
    at = Window.partitionBy("rid").orderBy("line")
    # Neighbouring lines have line numbers as far apart as their places among the lines with a cue.
    lines = lines.withColumn("run", F.col("line") - F.row_number().over(at))
    runs = lines.groupBy("rid", "doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("own")).where(F.size("own") > 1)
    runs = runs.select("rid", "doc_id", "run", F.get("own", F.lit(0))["line"].alias("line"), F.size("own").alias("lines"), F.flatten(F.transform("own", lambda x: x["words"])).alias("words"))
    both = lines.select("rid", "doc_id", "run", "line", F.lit(1).alias("lines"), "words").unionByName(runs)
    scored = scanner.model.transform(scanner.vectors.transform(both.select("rid", "doc_id", "run", "line", "lines", grams_of(F.col("words")).alias("grams"))))
    raw = vector_to_array("rawPrediction")
    top = F.array_max("raw")
    mass = F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp((x - top) / scanner.temperature))
    family = F.element_at(F.array(*map(F.lit, scanner.classes)), F.col("prediction").cast("int") + 1)
    scored = scored.select("rid", "doc_id", "run", "line", "lines", "grams", family.alias("family"), raw.alias("raw")).withColumn("probability", 1 / mass)
    templates = F.create_map(*(x for f, texts in TEMPLATES.items() for x in (F.lit(f), F.array(*(F.array(*map(F.lit, plain_grams(plain_words(t)))) for t in texts)))))
    shared = F.array_max(F.transform(F.element_at(templates, F.col("family")), lambda t: F.size(F.array_intersect("grams", t)) / F.least(F.size("grams"), F.size(t))))
    judged = scored.withColumn("agreement", F.when(F.col("family") != UNKNOWN, shared).otherwise(0.0))
    fine = (F.col("family") != UNKNOWN) & (F.col("probability") > scanner.least) & (F.col("agreement") >= scanner.agree)
    hit = F.when(fine, F.struct("line", "lines", "family", "probability", "agreement"))
    by_run = judged.withColumn("hit", hit).groupBy("rid", "doc_id", "run").agg(F.collect_list(F.when(F.col("lines") == 1, F.col("hit"))).alias("single"), F.collect_list(F.when(F.col("lines") > 1, F.col("hit"))).alias("whole"))
    some = by_run.select("rid", "doc_id", F.when(F.size("single") > 0, F.col("single")).otherwise(F.col("whole")).alias("hits"))
    some = some.groupBy("rid", "doc_id").agg(F.array_sort(F.flatten(F.collect_list("hits"))).cast(found).alias("licences"))
    return rest.unionByName(some.select("doc_id", "licences"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (that name a licence), families (distinct, in string order, joined by commas)."""
    return found.select("doc_id", F.size("licences").cast("long").alias("n_paragraphs"), F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"))
