"""Licence scans by a trained paragraph classifier, on DataFrame functions alone.

A line, or a run of lines up to a blank one joined (hard-wrapped text), with a cue or a name is described by its word n-grams (one to three words). A sparse logistic
regression over them gives each licence family a probability, with ``unknown`` as a class of its own; the probabilities are calibrated by a temperature, and what is not likely enough is unknown. A comparison with the
family's templates (the share of a template's word pairs that the paragraph has) confirms the rest, if the paragraph has
the pairs that tell the template from those of other licences too. A family is refuted, and becomes unknown, where the
paragraph names another version, a clause that the family lacks, or says that the licence does not apply.

Texts of licences that are no family are unknown. Those in ``FOREIGN`` are fitted; those in ``HELD_OUT`` are not, and
with held-out variations of all classes they calibrate the temperature and how readily a paragraph is unknown.

The model is fitted on the driver, from the templates below and variations of them, and not from the corpus; it is
a table of fixed size, joined by broadcast. Equal paragraphs are classified once.

Every line with a cue or a name is listed. A run is listed at its first line where it is confirmed as a family that none
of its lines is confirmed as. What has neither isn't listed. Defined results: null and empty texts have no
paragraphs; repeated rows give repeated rows; a row without doc_id is listed without it; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import stored, table

#: Parts of words that make a paragraph worth classifying.
CUES = ("licen", "copyright", "rights", "warrant", "redistribut", "permission", "gpl", "apache", "bsd", "mozilla", "spdx", "commons", "domain")

#: Names of licences that have no cue in them. The German word is no licence, so MIT is in capitals only.
NAMES = r"\bMIT\b|(?i)\b(gnu|cc0|cc[\s-]+by|by[\s-]+(sa|nc)|mpl|affero|lesser\s+general|sharealike|noncommercial|[23][\s-]+clause|unencumbered|attribution\s+4\.0|person\s+obtaining|deal\s+in\s+the\s+software)\b"

TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "This project is released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU LGPL v3", "SPDX-License-Identifier: LGPL-3.0-only", "you can redistribute it and or modify it under the terms of the GNU Lesser General Public License"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL v3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Released under the new BSD license", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "Public-Domain": ("This work is dedicated to the public domain.", "Released into the public domain.", "Creative Commons CC0 1.0 public domain dedication", "This is free and unencumbered software released into the public domain."),
    "All-Rights-Reserved": ("All rights reserved.", "Copyright 2020. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher."),
}
#: Paragraphs with cues that are no licence, for the class unknown.
OTHERS = (
    "He lost his driving licence after the accident.", "The licence plate of the car was covered in mud.", "Human rights groups asked the government to act.", "A search warrant was issued for the house.", "She asked for permission to leave the room.",
    "The domain of the function is the set of real numbers.", "The house of commons debated the bill.", "An apache helicopter landed on the field.", "The copyright lawyer spoke about civil rights and voting rights.", "The licensed electrician came with a warranty for the work.",
    "The domain name was registered last year.", "The liquor license of the bar expired.", "Wealth was redistributed by the new tax.", "The licensing committee meets on Monday.", "The mozilla foundation held a conference.", "Copyright law is taught in the second year.",
)
#: Licences that are no family: they are fitted as unknown.
FOREIGN = (
    "Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 1.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC", "Released under the GNU GPL v2", "This program is licensed under the GNU General Public License, version 2.",
    "Released under the GNU LGPL v2.1", "Licensed under the Apache License, Version 1.1.", "Licensed under the BSD 2-Clause License.", "Licensed under the Mozilla Public License 1.1", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-SA 3.0.", "Licensed under CC BY-NC-SA 4.0.",
    "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the Artistic License 2.0", "Released under the zlib license",
)
#: Licences that are no family and are never fitted: they calibrate.
HELD_OUT = (
    "Licensed under the Common Development and Distribution License 1.0.", "Released under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence, version 1.2.", "Released under the WTFPL", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Microsoft Public License.", "Common Public License 1.0",
    "Released under the Open Software License v3", "This work is licensed under the Open Data Commons Open Database License.", "Licensed under the PostgreSQL License", "SPDX-License-Identifier: CDDL-1.0", "Released under the Educational Community License, Version 2.0", "Licensed under the SIL Open Font License, Version 1.1.",
)
#: The names of families that have versions, and their own version; clauses that a family lacks.
VERSIONS = {
    "GPL-3.0": (r"gpl|general public licen[cs]e", "3"), "LGPL-3.0": (r"lgpl|(?:lesser|library) general public licen[cs]e", "3"), "AGPL-3.0": (r"agpl|affero general public licen[cs]e", "3"),
    "Apache-2.0": (r"apache(?: software)?", "2"), "MPL-2.0": (r"mpl|mozilla public licen[cs]e", "2"), "BSD-3-Clause": ("bsd", "3"),
} | {f: (r"cc(?: by)?(?: nc| sa| nd)*|attribution(?: non ?commercial| share ?alike| no ?derivatives)*|creative commons", "4") for f in ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
#: Families whose own text doesn't name them; the others above are refuted where their name is missing.
NAMELESS = ("BSD-3-Clause",)
NC, SA, ND = r"by(?: sa| nd)* nc\b|\bnon ?commercial", r"by(?: nc)* sa\b|\bshare ?alike", r"by(?: nc)* nd\b|\bno ?deriv"
CLAUSES = {
    "GPL-3.0": r"(?:lesser|library|affero) general public|[la]gpl", "BSD-3-Clause": r"(?:[0124]|zero|one|two|four) clause|simplified bsd|original bsd",
    "CC-BY-4.0": f"{NC}|{SA}|{ND}", "CC-BY-SA-4.0": f"{NC}|{ND}", "CC-BY-NC-4.0": f"{SA}|{ND}",
}
#: Words that say of any licence that it does not apply.
DENIED = r"\b(?:not|never|no longer|neither)(?: \w+){0,2} (?:licen[cs]ed|released|distributed|available|covered|offered|provided|published|subject|dedicated|in)(?: \w+)? (?:under|to|by|into|public)\b"
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
NOISE = tuple("the of and a to in is it for on with as by at from this that are was be or an we our all not code file see text more here project library".split())
#: A family needs this probability, and a template this share of its word pairs, to be named and confirmed.
LIKELY, CONFIRMED = 0.5, 0.6
#: Of the pairs that only one family has, a confirmed paragraph has at least this share.
TELLING = 0.5
SAMPLES, ROUNDS, GRAMS = 60, 200, 3


def words_of(text: str) -> list[str]:
    return re.sub(r"\.(?= |$)", "", re.sub("[^a-z0-9.]+", " ", text.lower()).strip()).split()


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(words) - n + 1)}


def pairs_of(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + 2]) for k in range(max(1, len(words) - 1))}


@functools.lru_cache(1)
def fitted() -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Weights of n-grams by class, intercepts (the unknown class's is calibrated), and the temperature that calibrates them."""
    r = np.random.default_rng(9)
    texts, marks = [], []
    for k, family in enumerate(FAMILIES):
        sources = TEMPLATES.get(family, (*OTHERS, *FOREIGN))
        for j in range(SAMPLES * (4 if family == UNKNOWN else 1)):
            words = words_of(sources[j % len(sources)])
            if j >= len(sources):  # the first are as they stand
                words = [w for w in words if r.random() > 0.08 * (family != UNKNOWN)]
                words = [*r.choice(NOISE, r.integers(0, 8)), *words, *r.choice(NOISE, r.integers(0, 8))]
                if family == UNKNOWN and j % 3 == 0:  # words of licences out of their order
                    words = [str(w) for w in r.permutation(words)]
            texts.append(grams_of([str(w) for w in words]))
            marks.append(k)
    fit = r.random(len(texts)) < 0.75
    for j in range(SAMPLES):
        words = [*r.choice(NOISE, r.integers(0, 8)), *words_of(HELD_OUT[j % len(HELD_OUT)]), *r.choice(NOISE, r.integers(0, 8))]
        texts.append(grams_of([str(w) for w in words]))
        marks.append(FAMILIES.index(UNKNOWN))
    fit = np.append(fit, np.zeros(SAMPLES, bool))
    vocabulary = {g: n for n, g in enumerate(sorted(set().union(*(t for t, own in zip(texts, fit) if own))))}
    x = np.zeros((len(texts), len(vocabulary)))
    for row, grams in enumerate(texts):
        x[row, [vocabulary[g] for g in grams if g in vocabulary]] = 1
    y = np.eye(len(FAMILIES))[marks]
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    momentum = np.zeros_like(w)
    for _ in range(ROUNDS):
        p = softmax(x[fit] @ w + b)
        momentum = 0.9 * momentum + x[fit].T @ (p - y[fit]) / fit.sum()
        w = w - 0.5 * momentum
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.5 * 2e-4)  # keeps the model sparse
        b = b - 0.5 * (p - y[fit]).mean(0)
    z, unknown = x[~fit] @ w + b, np.eye(len(FAMILIES))[FAMILIES.index(UNKNOWN)]
    losses = {(float(t), float(shift)): -np.log(softmax(t * (z + shift * unknown))[y[~fit] == 1] + 1e-12).mean() for t in np.geomspace(0.25, 4, 33) for shift in np.linspace(-2, 4, 25)}
    temperature, shift = min(losses, key=losses.get)
    return {g: w[n] for g, n in vocabulary.items() if np.abs(w[n]).max() > 1e-9}, b + shift * unknown, temperature


def refutation(family: str) -> str:
    """A pattern over a plain paragraph that rules the family out."""
    name, own = VERSIONS.get(family, (None, None))
    filler = r"(?: (?:the|public|software|international|unported|licen[cs]e|version|ver|v)){0,4} ?v?"
    other = [rf"\b(?:{name}){filler}(?!{own}(?:\.0)*(?![.\d]))\d{{1,2}}(?:\.\d+)*(?!\d)"] if name else []
    nameless = [rf"^(?!.*\b(?:{name})\b)"] if name and family not in NAMELESS else []
    return "|".join([*nameless, *other, *([rf"\b(?:{CLAUSES[family]})"] if family in CLAUSES else []), DENIED])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def has_cue(text: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(c)) for c in CUES]) | F.rlike(text, F.lit(NAMES))


def plain_of(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9.]+", " ")), r"\.(?= |$)", "")


def runs_of(lines: Column) -> Column:
    """First line and lines of every run of two or more lines that aren't blank."""
    at = F.sequence(F.lit(0), F.size(lines) - 1)
    full = lambda k: F.coalesce(F.rlike(F.get(lines, k), F.lit(r"\S")), F.lit(False))
    ends = F.arrays_zip(F.filter(at, lambda k: full(k) & ~full(k - 1)).alias("first"), F.filter(at, lambda k: full(k) & ~full(k + 1)).alias("last"))
    return F.transform(F.filter(ends, lambda e: e["last"] > e["first"]), lambda e: F.struct(e["first"].alias("paragraph"), F.slice(lines, e["first"] + 1, e["last"] - e["first"] + 1).alias("lines")))


def keyed(plain: Column, names: str = "ab") -> dict[str, Column]:
    return {n: F.xxhash64(F.lit(k), plain) for n, k in zip(names, "ab")}


def n_grams(words: Column, n: int) -> Column:
    """The runs of ``n`` words, none if there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (its first line, from 0), family, probability, similarity and confirmed of lines and runs."""
    spark = docs.sparkSession
    weights, intercepts, temperature = fitted()
    model = F.broadcast(spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "gram string, weight array<double>"))
    pairs = {f: [pairs_of(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}
    foreign = set().union(*(pairs_of(words_of(t)) for t in (*FOREIGN, *OTHERS)))
    others = {f: foreign.union(*(p for g, ps in pairs.items() if g != f for p in ps)) for f in pairs}
    templates = F.broadcast(spark.createDataFrame([(f, sorted(p), sorted(p - others[f])) for f, ps in pairs.items() for p in ps], "named string, pairs array<string>, telling array<string>"))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(has_cue(F.col("text"))).select("doc_id", F.split("text", "\n").alias("lines"))
    single = F.transform("lines", lambda x, k: F.struct(k.alias("paragraph"), F.array(x).alias("lines")))
    parts = texts.select("doc_id", F.explode(F.concat(single, runs_of(F.col("lines")))).alias("part")).select("doc_id", "part.*").filter(has_cue(F.array_join("lines", " ")))
    read = parts.select("doc_id", "paragraph", F.transform("lines", plain_of).alias("lines"))
    hits = read.withColumn("plain", F.array_join(F.filter("lines", lambda x: x != ""), " ")).withColumns(keyed(F.col("plain")) | keyed(F.array_join("lines", "\n"), "cd"))
    hits = stored(hits, "licences")  # read four times below, so that the texts are read once
    different = hits.groupBy("a", "b").agg(F.first("plain").alias("plain")).select("a", "b", F.filter(F.split("plain", " "), lambda w: w != "").alias("words"))

    grams = F.array_distinct(F.concat(*[n_grams(F.col("words"), n) for n in range(1, GRAMS + 1)]))
    sums = different.select("a", "b", F.explode_outer(grams).alias("gram")).join(model, "gram", "left")
    scores = [(F.coalesce(F.sum(F.col("weight")[k]), F.lit(0.0)) + float(intercepts[k])) * temperature for k in range(len(FAMILIES))]
    logits = sums.groupBy("a", "b").agg(F.array(*scores).alias("z"))
    top = F.array_max("z")
    judged = logits.withColumns({"at": F.array_position("z", top), "probability": 1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - top))})
    likely = F.when(F.col("probability") >= LIKELY, F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("at").cast("int"))).otherwise(UNKNOWN)
    judged = judged.select("a", "b", likely.alias("family"), F.round("probability", 6).alias("probability"))

    own = F.when(F.size("words") < 2, F.array(F.array_join("words", " "))).otherwise(n_grams(F.col("words"), 2))
    plain = F.array_join("words", " ")
    refuted = functools.reduce(lambda c, f: c.when(F.col("family") == f, F.rlike(plain, F.lit(refutation(f)))), TEMPLATES, F.when(F.col("family") == UNKNOWN, F.lit(False)))
    named = different.join(judged, ["a", "b"]).select("a", "b", own.alias("own"), F.when(refuted, UNKNOWN).otherwise(F.col("family")).alias("family"), "probability")
    compared = named.join(templates, F.col("family") == F.col("named"), "left")
    share = F.size(F.array_intersect("pairs", "own")) / F.size("pairs")
    told_apart = F.size(F.array_intersect("telling", "own")) >= TELLING * F.size("telling")
    found = compared.groupBy("a", "b", "family", "probability").agg(F.round(F.max(share), 6).alias("similarity"), F.bool_or((F.round(share, 6) >= CONFIRMED) & told_apart).alias("confirmed"))
    found = found.withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))

    # Runs that say no more than one of their lines; a line (a run of one) is listed in any case.
    runs = hits.filter(F.size("lines") > 1).groupBy("c", "d").agg(F.first("lines").alias("lines"), F.first("a").alias("a"), F.first("b").alias("b"))
    new = runs.join(found.filter("confirmed").select("a", "b", F.col("family").alias("whole")), ["a", "b"])
    each = new.select("c", "d", "whole", F.explode("lines").alias("plain")).select("c", "d", "whole", *[x.alias(n) for n, x in keyed(F.col("plain")).items()])
    told = each.join(found.filter("confirmed"), ["a", "b"]).filter("family = whole").select("c", "d").distinct()
    listed = new.select("c", "d").join(told, ["c", "d"], "left_anti").withColumn("more", F.lit(True))
    kept = hits.select("doc_id", "paragraph", "a", "b", "c", "d", (F.size("lines") > 1).alias("run")).join(listed, ["c", "d"], "left").filter("NOT run OR more")
    return kept.join(found, ["a", "b"]).select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
