"""Licence scan: a paragraph classifier over sparse word n-grams, with an unknown class and a template check.

A paragraph is a line, so a notice wrapped over several lines is judged line by line and may stay unconfirmed or unknown.  Its features are the word 1- to 3-grams of the vocabulary, present or not.  A multinomial logistic regression is
trained here, on the driver, from the templates below (worded by us after the notices in common use), variants of them with words dropped
and with ordinary words around them, and paragraphs that name no licence; small weights are set to zero.  A temperature and an intercept
shift for the unknown class are fitted on held-out variants, so that probabilities are calibrated.  A prediction is confirmed when the
paragraph holds at least ``MIN_TEMPLATE`` of the word pairs of one of the family's templates.

Scoring uses DataFrame functions only: the vocabulary is a literal map of some hundred entries, and only paragraphs with an anchor word,
without which every feature is absent, are looked at further.

Edge cases: null and empty texts have no paragraphs and give no rows; neither do paragraphs without an anchor word (their class is
unknown).  Very long paragraphs are scored whole.  Null ids are kept.  Repeated rows are scored each.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TEMPLATE, MIN_PROBABILITY = 0.5, 0.5
UNKNOWN = "unknown"
TEMPLATES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction.", "SPDX-License-Identifier: MIT"],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License, Version 2.0.", "Distributed under the Apache Software License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation.", "Licensed under the GPL, version 2 or later.", "SPDX-License-Identifier: GPL-3.0"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1"],
    "bsd": ["Distributed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under the terms of the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["This file is subject to the terms of the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "This work is released under the CC0 public domain dedication."],
    "proprietary": ["All rights reserved.", "Copyright by the owner. All rights reserved. No part may be reproduced without prior written permission."],
}
NONE = [
    "The driver renewed a license at the office in the city.", "A fishing license was issued to the club.", "The public library is free and open to any person.", "We reserved a table for all of the guests.", "Permission to enter the building was granted by the owner.",
    "The software was released in the spring and the new version is faster.", "He wrote an article about copyright law in general.", "The rights of the workers were discussed at length.", "An apache helicopter flew over the valley.", "She studied at MIT and later worked on compilers.", "The terms of the contract were published in May.",
    "This program starts at eight and ends at ten.", "Creative people work in the commons.", "The attribution of the painting is disputed.", "Commercial use of the road is forbidden.", "The version of the story that he told was different.", "Binary numbers and their source are described.", "The domain name is public.", "A copy of the letter was sent without restriction.", "General remarks about the foundation of the house.",
]
#: Words, one of which every feature holds.
ANCHORS = ["license", "licensed", "licenses", "licence", "mit", "apache", "gnu", "gpl", "lgpl", "bsd", "mozilla", "mpl", "cc", "cc0", "creative", "copyright", "rights", "reserved", "permission", "redistribution", "redistribute", "spdx", "permitted", "attribution", "noncommercial", "sharealike", "domain"]
FILLER = "the of and to in that it with for on as was by are this be from or at which one had not but what all were when we there can an your said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
WORD = "[a-z0-9]+(?:[.][0-9]+)*"


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def grams(words: list[str]) -> set[str]:
    anchors = set(ANCHORS)
    return {" ".join(g) for n in (1, 2, 3) for i in range(len(words) - n + 1) if anchors & set(g := words[i : i + n])}


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, list[float]], list[float]]:
    """Classes (the last is unknown), calibrated weights by n-gram, calibrated intercepts; the same on every call."""
    import numpy as np

    rng = np.random.default_rng(7)
    classes = [*TEMPLATES, UNKNOWN]
    rows: list[tuple[set[str], int]] = []
    for c, name in enumerate(classes):
        for text in NONE if name == UNKNOWN else TEMPLATES[name]:
            words = words_of(text)
            rows.append((grams(words), c))
            for _ in range(12):
                kept = [w for w in words if rng.random() > 0.08] or words
                around = [list(rng.choice(FILLER, int(rng.integers(0, 30)))) for _ in range(2)]
                rows.append((grams(around[0] + kept + around[1]), c))
    for _ in range(150):  # anchor words by themselves, in ordinary text
        words = list(rng.choice(FILLER, 40))
        for _ in range(int(rng.integers(0, 3))):
            words.insert(int(rng.integers(0, 40)), str(rng.choice(ANCHORS)))
        rows.append((grams(words), classes.index(UNKNOWN)))
    seen: dict[str, int] = {}
    for g, _ in rows:
        for x in g:
            seen[x] = seen.get(x, 0) + 1
    names = sorted(x for x, n in seen.items() if n >= 4)
    index = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    y = np.zeros((len(rows), len(classes)))
    for i, (g, c) in enumerate(rows):
        x[i, [index[k] for k in g if k in index]] = 1
        y[i, c] = 1
    test = np.arange(len(rows)) % 4 == 3
    w = np.zeros((len(names) + 1, len(classes)))
    step = 4.0 / np.linalg.norm(x[~test], 2) ** 2 * (~test).sum()
    at, t = w, 1.0
    for _ in range(600):  # accelerated proximal steps; the intercept isn't shrunk
        p = _softmax(x[~test] @ at)
        new = at - step * (x[~test].T @ (p - y[~test]) / (~test).sum())
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * 2e-4, 0)
        t, past = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        at, w = new + (past - 1) / t * (new - w), new
    best = min(((-np.log(_softmax((x[test] @ w + shift * (np.arange(len(classes)) == len(classes) - 1)) / heat)[y[test] > 0] + 1e-12).mean(), heat, shift) for heat in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0) for shift in (-1.0, -0.5, 0.0, 0.5, 1.0)))
    w = w / best[1]
    w[-1, -1] += best[2] / best[1]
    return classes, {n: [round(float(v), 4) for v in w[i]] for i, n in enumerate(names) if np.abs(w[i]).max() > 0.02}, [round(float(v), 4) for v in w[-1]]


def _softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _weights_map() -> Column:
    _, weights, _ = model()
    return F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in weights.items()) + "}"), "map<string,array<double>>")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` for each paragraph with an anchor word."""
    classes, _, intercepts = model()
    # an anchor word with nothing that goes on a word on either side, as the words' pattern cuts them; a wider test here only costs time
    has_anchor = F.lower("line").rlike("(?:^|[^a-z0-9])(?:" + "|".join(ANCHORS) + ")(?:[^a-z0-9]|$)")
    whole = F.lower(F.col(text)).rlike("(?:^|[^a-z0-9])(?:" + "|".join(ANCHORS) + ")(?:[^a-z0-9]|$)")
    lines = docs.where(whole).select("doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("paragraph", "line")).where(has_anchor)
    anchors = F.array(*map(F.lit, ANCHORS))
    parsed = lines.select("doc_id", "paragraph", F.regexp_extract_all(F.lower("line"), F.lit(f"({WORD})"), F.lit(1)).alias("words"))
    # only the words within two of an anchor can be in a feature
    near = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    spans = F.flatten(F.transform("at", lambda i: F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.filter(F.sequence(i - n + 1, i), lambda s: (s >= 0) & (s + n <= F.size("words"))), lambda s: F.array_join(F.slice("words", s + 1, n), " "))))))
    scored = parsed.withColumn("at", near).withColumn("grams", F.array_distinct(spans)).withColumn("found", F.filter(F.transform("grams", lambda g: F.element_at(_weights_map(), g)), lambda v: v.isNotNull()))
    logits = F.aggregate("found", F.array(*map(F.lit, intercepts)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    parts = scored.withColumn("logits", logits).withColumn("top", F.array_max("logits")).withColumn("parts", F.transform("logits", lambda z: F.exp(z - F.col("top"))))
    total = F.aggregate("parts", F.lit(0.0), lambda a, b: a + b)
    best = F.get(F.array(*map(F.lit, classes)), F.array_position("logits", F.col("top")).cast("int") - 1)
    chosen = parts.select("doc_id", "paragraph", "words", best.alias("best"), (1 / total).alias("p"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat(F.get("words", i), F.lit(" "), F.get("words", i + 1))))
    similarity = F.lit(0.0)
    for name, texts in TEMPLATES.items():
        held = [[f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for w in map(words_of, texts)]
        likeness = F.greatest(F.lit(0.0), *[F.size(F.array_intersect("pairs", F.array(*map(F.lit, h)))) / float(len(set(h))) for h in held])
        similarity = F.when(F.col("best") == name, likeness).otherwise(similarity)
    compared = chosen.withColumn("pairs", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))).withColumn("similarity", similarity)
    sure = (F.col("p") >= MIN_PROBABILITY) & (F.col("best") != UNKNOWN)
    return compared.select(
        "doc_id", F.col("paragraph").cast("int").alias("paragraph"), F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"), F.round("p", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), (sure & (F.col("similarity") >= MIN_TEMPLATE)).alias("confirmed")
    )


def plain(text: str | None) -> list[tuple[int, str, float, bool]]:
    """What ``scan`` gives for one text, worked out in plain Python: (paragraph, family, similarity, confirmed)."""
    import numpy as np

    classes, weights, intercepts = model()
    out = []
    for i, line in enumerate((text or "").split("\n")):
        words = words_of(line)
        low = line.lower()
        if not re.search("(?:^|[^a-z0-9])(?:" + "|".join(ANCHORS) + ")(?:[^a-z0-9]|$)", low):
            continue
        z = np.array(intercepts) + sum((np.array(weights[g]) for g in grams(words) if g in weights), np.zeros(len(classes)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = classes[int(z.argmax())]
        have = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
        held = [{f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} for w in map(words_of, TEMPLATES.get(best, []))]
        near = max([len(have & h) / len(h) for h in held if h], default=0.0)
        sure = p.max() >= MIN_PROBABILITY and best != UNKNOWN
        out.append((i, best if sure else UNKNOWN, round(near, 6), bool(sure and near >= MIN_TEMPLATE)))
    return out
