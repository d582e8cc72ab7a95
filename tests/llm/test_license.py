import re

import numpy as np
import pytest

from tests.llm.helpers import as_sf, docs, odd_rows, prose
from textloom.llm import license as lic


def shares_of(family, words):
    """For each template of a family the share of its pairs, and of those that no other licence has, in the words."""
    own, out = lic.pairs_of(words), []
    rest = [t for f, ts in lic.TEMPLATES.items() if f != family for t in ts] + [*lic.FOREIGN, *lic.OTHERS]
    elsewhere = {p for t in rest for p in lic.pairs_of(lic.words_of(t))}
    for t in lic.TEMPLATES.get(family, ()):
        pairs = lic.pairs_of(lic.words_of(t))
        telling = pairs - elsewhere
        out.append((len(pairs & own) / len(pairs), len(telling & own) >= lic.TELLING * len(telling)))
    return out


def brute(rows):
    weights, intercepts, temperature = lic.fitted()
    out = []
    for ident, text, *_ in rows:
        for k, line in enumerate((text or "").split("\n")):
            if any(c in line.lower() for c in lic.CUES):
                words = lic.words_of(line)
                z = temperature * (sum((weights[g] for g in lic.grams_of(words) if g in weights), np.zeros(len(lic.FAMILIES))) + intercepts)
                p = lic.softmax(z[None])[0]
                family = lic.FAMILIES[int(p.argmax())] if p.max() >= lic.LIKELY else "unknown"
                if family != "unknown" and re.search(lic.refutation(family), " ".join(words)):
                    family = "unknown"
                shares = shares_of(family, words)
                out.append((ident, k, family, float(p.max()), max(s for s, _ in shares) if shares else None, any(s >= lic.CONFIRMED and told for s, told in shares)))
    return out


def rows():
    lines = [t for ts in lic.TEMPLATES.values() for t in ts] + list(lic.OTHERS) + ["licence", "GPL", "der Text steht unter der MIT-Lizenz; license", "©Copyright\tAll  RIGHTS reserved!"]
    made = [(100 + k, f"{prose(8, k)}\n{t}\n\n{prose(5, k)}", "en", "a", 1) for k, t in enumerate(lines)]
    return [*odd_rows(), *made, made[0], (999, prose(4000, 5) + " released under the MIT license " + prose(4000, 6), "en", "a", 1), (None, "All rights reserved.", "en", "a", 1)]


def test_against_plain_python(spark, tmp_path):
    got = sorted((tuple(r) for r in lic.op9_license(spark, as_sf(docs(spark, rows()), tmp_path)).collect()), key=repr)
    want = sorted(brute(rows()), key=repr)
    assert [(*g[:3], g[5]) for g in got] == [(*w[:3], w[5]) for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 and (g[4] is None) == (w[4] is None) and abs((g[4] or 0) - (w[4] or 0)) < 1e-5 for g, w in zip(got, want))


@pytest.mark.parametrize("family", lic.TEMPLATES)
def test_families_are_found_inside_other_words(family):
    for t in lic.TEMPLATES[family]:
        (got,) = brute([(1, f"here {t.lower()} and more of it", "en", "a", 1)])
        assert got[2] == family and got[5], (t, got)


def test_other_paragraphs_are_not_confirmed():
    for text in (*lic.OTHERS, "The rights of the people and the licence of the pub in the domain of the duke", "Copyright infringement case heard in the apache county court"):
        assert not brute([(1, text, "en", "a", 1)])[0][5], text


def test_no_python_on_the_executors(spark, tmp_path):
    frame = lic.op9_license(spark, as_sf(docs(spark), tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD"))
    assert lic.scan(docs(spark, [])).count() == 0


WRAPPED = {
    "MIT": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files, to deal\n# in the Software without restriction",
    "GPL-3.0": " * This program is free software: you can redistribute it and or modify\r\n * it under the terms of the GNU General Public License as published by\r\n * the Free Software Foundation",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met",
}


@pytest.mark.parametrize("family", WRAPPED)
def test_hard_wrapped_texts_are_confirmed(spark, family):
    rows = [(1, f"{prose(5, 1)}\n \n\n{WRAPPED[family]}\n\n{prose(5, 2)}", "en", "a", 1), (2, WRAPPED[family].replace("\n", " "), "en", "a", 1)]
    got = {(r.doc_id, r.paragraph, r.family) for r in lic.scan(docs(spark, [*rows, rows[0]])).filter("confirmed").collect()}
    assert got == {(1, 3, family), (2, 0, family)}
    assert lic.scan(docs(spark, [rows[0], rows[0]])).filter("confirmed").count() == 2


def test_names_without_cues_are_listed(spark):
    lines = ["Text available under CC BY-SA 4.0", "CC0 1.0 Universal", "Distributed under the terms of the MIT/X11 terms", "GNU", "er ging mit dem Hund"]
    got = {r.paragraph: r for r in lic.scan(docs(spark, [(1, "\n\n".join(lines), "en", "a", 1)])).collect()}
    assert set(got) == {0, 2, 4, 6} and got[0].family == "CC-BY-SA-4.0" and got[0].confirmed and got[4].family == "MIT"


#: What a reader would say of each sentence. Versions and clauses among them are fitted as foreign licences; the names Illinois and Sleepycat are not.
LABELLED = {
    "This package is covered by the GNU General Public License, version 2": "unknown", "Released under the GNU GPL v2": "unknown", "This program is licensed under the GNU GPL version 2.0 only": "unknown", "Licensed under the BSD 2-Clause License": "unknown", "Licensed under the BSD 4-Clause License": "unknown",
    "Licensed under CC BY-NC-SA 4.0": "unknown", "Licensed under CC BY-SA 3.0": "unknown", "This work is licensed under a Creative Commons Attribution 2.5 International License.": "unknown", "Licensed under the Apache License, Version 1.1": "unknown", "Licensed under the Apache License 1.0": "unknown",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.": "unknown", "Released under the GNU LGPL v2.1": "unknown", "Licensed under the Eclipse Public License 2.0": "unknown", "This code is not licensed under the MIT license": "unknown", "It was never released under the MIT License.": "unknown",
    "The files are no longer available under the Apache License, Version 2.0": "unknown", "Licensed under the University of Illinois License": "unknown", "Licensed under the Sleepycat License": "unknown", "Licensed under CC BY-ND 4.0": "unknown", "The licence of the fishing boat was renewed": "unknown",
    "The source is released under the MIT License, see LICENSE": "MIT", "Our library is licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.0": "GPL-3.0", "Licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "The server is licensed under the GNU Affero General Public License, version 3": "AGPL-3.0", "It is licensed under the BSD 3-Clause License": "BSD-3-Clause", "Text and figures are licensed under CC BY 4.0": "CC-BY-4.0", "All pictures are licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "The wiki text is licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
    "The scans were released into the public domain": "Public-Domain", "Copyright 2014 by the heirs. All rights reserved.": "All-Rights-Reserved", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org licenses LICENSE-2.0": "Apache-2.0",
}


def test_a_labelled_set(spark):
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(LABELLED)]
    got = {r.doc_id: r for r in lic.scan(docs(spark, rows)).collect()}
    said = {t: (got[k].family, got[k].confirmed) if k in got else ("unknown", False) for k, t in enumerate(LABELLED)}
    assert said == {t: (f, f != "unknown") for t, f in LABELLED.items()}


@pytest.mark.parametrize("text", lic.HELD_OUT)
def test_licences_that_were_not_fitted_are_not_confirmed(text):
    assert not brute([(1, f"here {text} license and more of it", "en", "a", 1)])[0][5]
