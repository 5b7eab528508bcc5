import re

import numpy as np

from quillon.llm import license_scan
from tests.llm import cases

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {}
    for r in docs.collect():
        want[r.doc_id] = sorted({f for line in r.text.split("\n") for x, f in LINES.items() if x in line})
    scanned = license_scan.scan(docs)
    got = {r.doc_id: r.families for r in license_scan.digest(scanned).collect()}
    assert got == {d: ",".join(f) for d, f in want.items()}
    assert not re.search("Python|Pandas|Arrow", scanned._jdf.queryExecution().executedPlan().toString())


def test_variants_and_awkward_rows(spark):
    base = cases.documents(spark).select("doc_id", "text")
    extra = [
        (900, "x\nlicensed  under the apache license version 2.0\ny"),
        (901, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
        (902, "the license plate of a car under the bridge, version unknown"),
        (903, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        (904, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
        (905, "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0."),
        (906, "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without fee is hereby\ngranted, provided that the above copyright notice and\nthis permission notice appear in all copies."),
        (907, "You should have received a copy of the GNU Lesser General Public License along with this library."),
    ]
    docs = base.union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = license_scan.digest(license_scan.scan(docs)).collect()
    got = {r.doc_id: r.families for r in rows}
    assert len(rows) == docs.count()
    assert [got[900 + k] for k in range(8)] == ["Apache-2.0", "MIT", "", "BSD-3-Clause", "GPL-3.0", "CC-BY-4.0,CC-BY-SA-4.0", "ISC", "LGPL-3.0"]
    assert {f for d, f in got.items() if d is None or d < 900} == {""}
    assert license_scan.scan(cases.empty(spark)).collect() == []


def plain_scan(scanner, text):
    """(line, lines, family) of a text, from the model's coefficients, without Spark."""
    cues, vocabulary = set(scanner.cues), {g: k for k, g in enumerate(scanner.vectors.vocabulary)}
    weights, bias = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()

    def judge(words):
        grams = set(license_scan.plain_grams(words))
        raw = bias + sum((weights[:, vocabulary[g]] for g in grams if g in vocabulary), np.zeros(len(bias)))
        p = np.exp((raw - raw.max()) / scanner.temperature)
        k = int(raw.argmax())
        family = scanner.classes[k]
        if family == license_scan.UNKNOWN or p[k] / p.sum() <= scanner.least:
            return None
        templates = [set(license_scan.plain_grams(license_scan.plain_words(t))) for t in license_scan.TEMPLATES[family]]
        return family if max(len(grams & t) / min(len(grams), len(t)) for t in templates) >= scanner.agree else None

    lines = [(k, license_scan.plain_words(x)) for k, x in enumerate((text or "").split("\n"))]
    out, run = [], []
    for k, words in [*lines, (len(lines) + 1, [])]:
        if run and (not cues & set(words) or k != run[-1][0] + 1):
            single = [(at, 1, judge(w)) for at, w in run if judge(w)]
            whole = judge([x for _, w in run for x in w]) if len(run) > 1 else None
            out += single or ([(run[0][0], len(run), whole)] if whole else [])
            run = []
        if cues & set(words):
            run.append((k, words))
    return out


def test_against_the_model_recomputed(spark):
    """Every paragraph's class, calibrated probability, threshold and agreement, recomputed in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pieces = [" ".join(t.split()[a : a + n]) for texts in license_scan.TEMPLATES.values() for t in texts for a in (0, 3, 7) for n in (4, 9, 20)]
    wrapped = ["\n".join(" ".join(t.split()[k : k + 7]) for k in range(0, len(t.split()), 7)) for texts in license_scan.TEMPLATES.values() for t in texts]
    docs = docs.unionByName(spark.createDataFrame([(10**6 + k, x) for k, x in enumerate(pieces + wrapped)], "doc_id long, text string"))
    scanner = license_scan.fit(docs)
    assert 0.25 <= scanner.temperature <= 16 and 0.5 <= scanner.least < 1
    got = {r.doc_id: [(x.line, x.lines, x.family) for x in r.licences] for r in license_scan.scan(docs, scanner).collect()}
    want = {r.doc_id: plain_scan(scanner, r.text) for r in docs.collect()}
    assert got == want
    assert sum(len(x) for d, x in want.items() if d >= 10**6) > len(wrapped)


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    hot = "a line that a third of all documents hold\nand one more of them"
    docs = docs.unionByName(spark.range(600).selectExpr("id + 1000000 AS doc_id", f"'{hot}' AS text"))
    families = {r.doc_id: r.families for r in license_scan.digest(license_scan.scan(docs)).collect()}
    assert all(families[10**6 + k] == "" for k in range(600)) and len({f for f in families.values() if f}) >= 4
