import math
import re

import pytest

from quillspark.llm import licenses

BIG = "/root/testdata/sf0.01"
#: Licences that are none of the families, each next to one.
NEXT = [
    "GNU Lesser General Public License version 2.1", "Licensed under the GNU Lesser General Public License v2.1 or later", "GNU Affero General Public License v3", "SPDX-License-Identifier: LGPL-3.0-or-later",
    "SPDX-License-Identifier: AGPL-3.0-only", "Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under the Apache Software License, Version 1.1",
    "This file is licensed under the Mozilla Public License, Version 2.0; you may not use this file except in compliance with the License.", "under the terms of the GNU General Public License version 2",
    "Academic Free License 3.0", "SPDX-License-Identifier: GPL-2.0-or-later", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC BY 4.0", "Licensed under CC BY-NC 3.0", "BSD 2-Clause License", "ISC License",
    "Licensed under the EUPL 1.2", "Boost Software License 1.0", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "WTFPL version 2",
]
#: Sentences that are not among those learned from, and names of the families.
SAYS = [
    "Distributed under the terms of {}", "This library is licensed under {}", "Code: {}", "see {} in the file COPYING", "you may use it under {}", "The software is available under {}.", "All files here are under {}",
    "published by the authors under {} in 2019", "license = {}", "It comes with {} attached",
]
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache License Version 2.0", "the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 License", "CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU General Public License version 3 or later", "GNU General Public License v3", "SPDX-License-Identifier: GPL-3.0-or-later", "the GNU GENERAL PUBLIC LICENSE Version 3"],
    "mit": ["the MIT License", "the MIT license", "MIT License", "the MIT License (MIT)", "SPDX-License-Identifier: MIT"],
    "proprietary": ["all rights reserved", "All Rights Reserved.", "ALL RIGHTS RESERVED", "a copyright notice, all rights reserved", "Copyright 2019. All rights reserved."],
}


@pytest.fixture(scope="module")
def model(spark):
    return licenses.learn(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text"))


def judged(spark, model, lines):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan_paragraphs(docs, model).collect()}


def test_neighbours_are_unknown(spark, model):
    got = judged(spark, model, NEXT)
    named = [(t, got[i]["family"], round(got[i]["confidence"], 2)) for i, t in enumerate(NEXT) if i in got and got[i]["family"] != "unknown"]
    assert not named


def test_fifty_wordings_a_family(spark, model):
    cases = [(f, s.format(n)) for f, names in NAMES.items() for n in names for s in SAYS]
    other = [s.format(n) for n in licenses.OTHER_NAMES[1::2] for s in SAYS]
    got = judged(spark, model, [t for _, t in cases] + other)
    right = {f: sum(got.get(i) is not None and got[i]["family"] == f for i, (g, _) in enumerate(cases) if g == f) for f in NAMES}
    named = [i for i in got if got[i]["family"] != "unknown"]
    wrong = [(t, got[i]["family"]) for i, t in enumerate([*(t for _, t in cases), *other]) if i in named and (i >= len(cases) or got[i]["family"] != cases[i][0])]
    lost = [t for i, (f, t) in enumerate(cases) if i not in got or got[i]["family"] != f]
    print("lost:", lost[:12])
    print("right of 50:", right, "named wrongly:", len(wrong), "of", len(named), wrong[:5], "floor", model.floor, "calibrated on", model.calibrated_on)
    assert min(right.values()) >= 45 and len(wrong) <= 0.02 * len(named)


def test_calibration_needs_lines(model):
    assert model.calibrated_on >= licenses.LEAST_LINES
    learned, held = licenses.generated(True), licenses.generated(False)
    assert not set(learned[0]) & set(held[0]) and not set(learned[1]) & set(held[1])


def test_scores_equal_plain_regression(spark, model):
    """The same weights, words and pairs, logistic regression in plain Python."""
    lines = ["Released under the MIT License.", "under the GNU General Public License, version 3 of a thing", "plain words only", "", "GNU Lesser General Public License", "All rights reserved. 2.0"]
    places = {w: i for i, w in enumerate(model.vocabulary.vocabulary)}
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    got = {r["line"]: r for r in model.with_scores(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    for line in lines:
        words = re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", line.lower())
        grams = {places[g] for g in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))] if g in places}
        raw = [bias[k] + sum(weights[k][g] for g in grams) for k in range(len(model.families))]
        soft = [math.exp(x - max(raw)) for x in raw]
        p = {f: x / sum(soft) for f, x in zip(model.families, soft, strict=True)}
        best = max((f for f in p if f not in ("none", "other")), key=lambda f: p[f])
        assert got[line]["family"] == best and abs(got[line]["confidence"] - p[best]) < 1e-9
        assert got[line]["none"] == (p["none"] == max(p.values())) and got[line]["other"] == (p["other"] >= p[best])
