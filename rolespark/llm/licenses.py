"""Licence scans: a sparse word n-gram logistic regression over paragraphs, scored with built-in functions only.

The classifier is trained here, on the templates below with variations and on a bounded sample of ordinary paragraphs
(class unknown). Its vocabulary and weights are small and fixed by the templates; scoring is one projection. A
prediction counts when its calibrated probability is above that of unknown and enough of a template's words are there. Texts
without any of the words that the weights require (Model.needed) are left out before the scoring: no paragraph of theirs
could reach the probability."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolespark.llm.common import let

# fixed values: short notices of public licences, by family
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "under CC BY 4.0"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "under CC BY-NC 4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "under CC BY-SA 4.0"),
    "cc0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "under GPLv3",
    ),
    "lgpl": ("This work is licensed under the GNU Lesser General Public License, version 3.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "proprietary": ("All rights reserved.", "Copyright. All rights reserved. No part of this publication may be reproduced without written permission of the publisher."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
}
UNKNOWN = "unknown"
#: Paragraphs with these words are returned as unknown where no family is probable.
LICENCE_WORDS = r"(?i)\b(?:licen[sc]|copyright)"
ORDERS = (1, 2, 3)
#: Words that say nothing of licences by themselves: n-grams of them alone, or of single digits, are no features.
FUNCTION_WORDS = frozenset("a all and any are as at be by can for from has in is it may no not of on or part that the this to under v version with without you".split())
FOLDS = 3
LEAST_CONTAINMENT = 0.6
#: Ordinary paragraphs to learn from, and characters of each.
SAMPLE_PARAGRAPHS = 400
SAMPLE_CHARS = 300
CUT = r"[^\p{L}\p{N}]+"
#: A paragraph ends before and after a line without letters and digits, and after a line that ends a sentence.
BREAKS = r"(?<=\n)(?:(?=[^\p{L}\p{N}\n]*+(?:\n|\z))|(?<=[.!?:][\"')\]]{0,3}[ \t\r]{0,8}\n)|(?<=\n[^\p{L}\p{N}\n]{0,99}\n))"
#: Longer paragraphs are judged in windows of two of these tiles, so that one tile lies in both; no template is longer.
TILE_WORDS = 32
TILES = r"(?s)(?:[^\p{L}\p{N}]*+[\p{L}\p{N}]++){1,%d}+[^\p{L}\p{N}]*+|[^\p{L}\p{N}]++" % TILE_WORDS


def _tells(word: str) -> bool:
    return word not in FUNCTION_WORDS and not word.isdigit()


def grams(text: str) -> list[str]:
    words = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    return [" ".join(words[i : i + n]) for n in ORDERS for i in range(len(words) - n + 1)]


@dataclass
class Model:
    families: list[str]  # UNKNOWN is the last
    vocabulary: list[str]
    weights: np.ndarray  # a row for each gram
    bias: np.ndarray
    temperature: float
    needed: list[str] = field(default_factory=list)  # a paragraph without these words is unknown


def _variations(text: str) -> list[str]:
    """A template whole, without its ends, and inside other words."""
    words = text.split()
    out = [text, f"Copyright (c) 2020 the authors. {text}", f"{text} See the file for details.", f"Note: {text}"]
    if len(words) > 8:
        out += [" ".join(words[: len(words) * 3 // 4]), " ".join(words[len(words) // 4 :])]
    return out


#: Ordinary phrases with words of licences.
PHRASES = ("", "permission", "the license", "under the terms", "public license", "rights", "copyright", "you can use this file", "licensed", "license plate", "human rights", "driving license", "with permission of the", "a licence to", "version 2.0", "version 3", "free of charge", "the software", "public domain", "by the author")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def needed_words(vocabulary: list[str], margin: np.ndarray, bias: np.ndarray, ordinary: list[str]) -> list[str]:
    """Words of which a paragraph has one or more whenever some family's logit reaches that of unknown. margin and bias
    hold each family's lead over unknown for each gram and without grams. Taken one after the other, the word that
    lowers the leads still possible most for how often ordinary has it, until no family can lead without them."""
    gain = np.maximum(margin, 0)
    inside = {w: np.array([w in g.split() for g in vocabulary]) for w in {w for g in vocabulary for w in g.split() if _tells(w)}}
    counts: dict[str, int] = {}
    for text in ordinary:
        for w in set(grams(text)) & inside.keys():
            counts[w] = counts.get(w, 0) + 1
    left, out = np.ones(len(vocabulary), dtype=bool), []
    while ((lead := gain[left].sum(axis=0) + bias) >= 0).any():
        best = max(sorted(inside), key=lambda w: gain[inside[w] & left][:, lead >= 0].sum() / (1 + counts.get(w, 0)))
        out.append(best)
        left &= ~inside.pop(best)
    return sorted(out)


def fit(ordinary: list[str]) -> Model:
    """Softmax regression by gradient descent with an l2 penalty. The temperature is that of least loss on texts unlike
    those that a fit has seen: each fold leaves out one template of every family, all its variations with it, and a
    third of the ordinary paragraphs."""
    families = [*sorted(TEMPLATES), UNKNOWN]
    unknown = len(families) - 1
    every = {g for texts in TEMPLATES.values() for t in texts for g in grams(t)}
    vocabulary = sorted(g for g in every if any(map(_tells, g.split())))
    number = {g: i for i, g in enumerate(vocabulary)}
    rows = [(v, k, n % FOLDS) for k, f in enumerate(families[:unknown]) for n, t in enumerate(TEMPLATES[f]) for v in _variations(t)]
    rows += [(t, unknown, i % FOLDS) for i, t in enumerate([*PHRASES, *ordinary])]
    x = np.zeros((len(rows), len(vocabulary)))
    for r, (t, _, _) in enumerate(rows):
        x[r, [number[g] for g in grams(t) if g in number]] = 1
    y = np.eye(len(families))[[k for _, k, _ in rows]]
    fold = np.array([f for _, _, f in rows])

    def descend(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
        each = (1 / np.maximum(y[part].sum(axis=0), 1))[y[part].argmax(axis=1)]  # classes weigh the same
        weight = (each / each.sum())[:, None]
        for _ in range(600):
            d = (softmax(x[part] @ w + b) - y[part]) * weight
            w -= 8.0 * (x[part].T @ d + 1e-4 * w)
            b -= 8.0 * d.sum(axis=0)
        return w, b

    losses = dict.fromkeys((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), 0.0)
    for f in range(FOLDS):
        w, b = descend(fold != f)
        z, truth = (x @ w + b)[fold == f], y[fold == f]
        each = (1 / np.maximum(truth.sum(axis=0), 1))[truth.argmax(axis=1)]
        for t in losses:
            losses[t] -= (np.log(softmax(z / t) + 1e-12) * truth).sum(axis=1) @ each
    w, b = descend(np.ones(len(rows), dtype=bool))
    lead_w, lead_b = w[:, :unknown] - w[:, [unknown]], b[:unknown] - b[unknown]
    return Model(families, vocabulary, w, b, min(losses, key=losses.get), needed_words(vocabulary, lead_w, lead_b, ordinary))


def _resembles(text: str) -> bool:
    """Whether a third of a template's grams are in text: no ordinary paragraph to learn from."""
    own = set(grams(text))
    return any(3 * len(own & (g := set(grams(t)))) >= len(g) for texts in TEMPLATES.values() for t in texts)


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """Fits with the SAMPLE_PARAGRAPHS distinct paragraphs of docs that have the least hashes, SAMPLE_CHARS characters
    of each, without those that resemble a template. The same whatever the size of docs and however often a paragraph
    repeats: the range of hashes that is looked at follows from the number of paragraphs, and widens where copies leave
    too few. The texts are only those with text; an empty table leaves PHRASES alone."""
    pieces = docs.select(F.explode(F.split(text_col, BREAKS)).alias("p")).select(F.regexp_replace("p", r"^\s+|\s+\z", "").alias("p")).filter("p <> ''")
    pieces = pieces.select(F.xxhash64("p").alias("h"), F.substring("p", 1, SAMPLE_CHARS).alias("p"))
    rows = docs.agg(F.sum(F.size(F.split(text_col, "\n")))).first()[0] or 0
    share = min(1.0, 4 * SAMPLE_PARAGRAPHS / max(1, rows))
    while True:
        near = pieces.filter(F.col("h") <= int(-(2**63) + share * (2**64 - 1024)) if share < 1 else F.lit(True))
        picked = near.groupBy("p").agg(F.min("h").alias("h")).orderBy("h", "p").limit(SAMPLE_PARAGRAPHS).collect()
        if len(picked) == SAMPLE_PARAGRAPHS or share == 1:
            return fit([r["p"] for r in picked if not _resembles(r["p"])])
        share = min(1.0, 8 * share)


def _grams(line: Column) -> Column:
    words = F.array_remove(F.split(F.lower(line), CUT), "")

    def of_order(w: Column, n: int) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(n))))

    return let(words, lambda w: F.concat(*[of_order(w, n) for n in ORDERS]))


def _numbers(values: np.ndarray) -> Column:
    """A constant array, folded when the query is planned."""
    return F.split(F.lit(",".join(f"{v:.6g}" for v in values.ravel())), ",").cast("array<double>")


def _units(text: Column, needed: str) -> Column:
    """The paragraphs of a text with a needed word, or the windows of longer ones: paragraph, start, line."""
    tiles = F.transform(
        F.split(text, BREAKS), lambda p, i: F.transform(F.regexp_extract_all(p, F.lit(TILES), 0), lambda t: F.struct(i.alias("paragraph"), t.alias("tile")))
    )

    def windows(flat: Column, ends: Column) -> Column:
        def one(t: Column, j: Column) -> Column:
            before, after = F.when(j > 0, F.get(flat, j - 1)), F.get(flat, j + 1)
            joined = F.coalesce(after["paragraph"] == t["paragraph"], F.lit(False))
            covered = ~joined & F.coalesce(before["paragraph"] == t["paragraph"], F.lit(False))  # by the window before
            line = F.concat(t["tile"], F.when(joined, after["tile"]).otherwise(""))
            start = F.when(j > 0, F.get(ends, j - 1)).otherwise(0)
            return F.when(~covered & line.rlike(needed), F.struct(t["paragraph"].alias("paragraph"), start.alias("start"), F.regexp_replace(line, r"\s+\z", "").alias("line")))

        return F.filter(F.transform(flat, one), lambda u: u.isNotNull())

    def ends_of(flat: Column) -> Column:
        return F.aggregate(flat, F.array().cast("array<int>"), lambda a, t: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + F.length(t["tile"]))))

    return let(F.flatten(tiles), lambda flat: let(ends_of(flat), lambda ends: windows(flat, ends)))


def scan(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each licence paragraph: doc_id, paragraph (its number in the text, from 0), start and end (code
    points, white space at its end left out), family, probability, template (its number in the family), containment,
    confirmed.

    A paragraph ends at a line without letters and digits, or at a line that ends a sentence, so that wrapped lines stay
    together; one of more than TILE_WORDS words is judged in windows of twice as many that overlap by half, a row each.
    family is unknown when no licence family has a higher calibrated probability than the unknown class; such
    paragraphs are returned too, unconfirmed, if they have one of LICENCE_WORDS. confirmed: a template of the family
    shares LEAST_CONTAINMENT of its n-grams. Null and empty texts and empty tables have no rows; repeated rows give
    repeated results; equal probabilities go to the first family in ascending order; other columns are not read."""
    n, unknown = len(model.families), len(model.families) - 1
    text = F.col(text_col)
    needed = "|".join([LICENCE_WORDS, *([rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(model.needed)})(?![\p{{L}}\p{{N}}])"] if model.needed else [])])
    found = docs.filter(text.rlike(needed)).select(F.col(id_col).cast("long").alias("doc_id"), F.explode(_units(text, needed)).alias("p"))
    found = found.select("doc_id", "p.paragraph", "p.start", "p.line", _grams(F.col("p.line")).alias("grams"))
    vocabulary = F.split(F.lit("|".join(model.vocabulary)), r"\|")
    hits = F.transform(F.array_intersect("grams", vocabulary), lambda g: F.array_position(vocabulary, g).cast("int") - 1)
    weights = _numbers(model.weights)

    def logits(h: Column) -> Column:
        return F.transform(
            _numbers(model.bias), lambda b, k: F.aggregate(h, b, lambda a, i: a + F.get(weights, i * n + k)) / F.lit(float(model.temperature))
        )

    def shares(z: Column) -> Column:
        e = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
        return let(e, lambda parts: F.transform(parts, lambda v: v / F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)))

    scored = found.withColumn("probabilities", let(hits, lambda h: let(logits(h), shares)))
    best = F.array_max("probabilities")
    names = F.array(*[F.lit(f) for f in [UNKNOWN, *model.families[:unknown]]])
    # a family ties with unknown: unknown
    order = F.concat(F.slice("probabilities", n, 1), F.slice("probabilities", 1, unknown))
    scored = scored.withColumns({"family": F.get(names, F.array_position(order, best).cast("int") - 1), "probability": best})
    shared = F.when(F.lit(False), F.array().cast("array<struct<containment:double,template:int>>"))
    for name in model.families[:unknown]:
        each = []
        for k, t in enumerate(TEMPLATES[name]):
            own = sorted(set(grams(t)))
            inside = F.size(F.array_intersect("grams", F.split(F.lit("|".join(own)), r"\|"))) / F.lit(float(len(own)))
            each.append(F.struct(inside.alias("containment"), F.lit(k).alias("template")))
        shared = shared.when(F.col("family") == name, F.array(*each))
    scored = scored.withColumn("match", F.array_max(shared))
    return scored.filter((F.col("family") != UNKNOWN) | F.col("line").rlike(LICENCE_WORDS)).select(
        "doc_id",
        "paragraph",
        "start",
        (F.col("start") + F.length("line")).alias("end"),
        "family",
        "probability",
        F.col("match.template").alias("template"),
        F.coalesce("match.containment", F.lit(0.0)).alias("containment"),
        (F.coalesce("match.containment", F.lit(0.0)) >= LEAST_CONTAINMENT).alias("confirmed"),
    )
