"""Licence scans: a trained paragraph classifier, confirmed by templates, in DataFrame operations only.

Lines are sparse vectors of word n-grams (one and two words). Multinomial logistic regression learns the licence
families from PHRASES and their fragments, and class none from all lines of all documents that hold no wording of licences:
lines of equal vectors are learned as one row that weighs what they do, and all of them weigh ORDINARY_WEIGHT at most together,
so that they do not drown the families. Every line of every document is scored, by Spark's own transformers in the JVM; a line that speaks for a family, or holds a wording of
licences in general (ANCHORS), is judged. Licences next to the known ones (other versions, Lesser, Affero, ShareAlike and
so on, and licences of other names) are a class of their own, learned from NEIGHBOURS and half of the lines that OTHER_NAMES
and WRAPPERS generate; what falls there is unknown. The class unknown is calibrated: the least confidence at which a family
is accepted is set so that at most FALSE_SHARE of lines that are not learned from and fit no template would pass, namely the
other half of the generated ones, OTHERS, and all judged lines of the corpus with a wording of licences (the rest are learned
from), and so that no greater share of those that are not of the corpus would, however many the corpus has; with fewer than
LEAST_LINES lines the floor is not called calibrated and learning fails. A family is accepted only where its MARKS hold, what sets it apart from its
neighbours: the name, the version, NC without SA, no Lesser. A prediction is confirmed when, besides, enough of the words
of one of the family's templates stand in the text.

A paragraph is a run of judged lines that follow one another, until one of another accepted family begins; its lines
are put together and classified and confirmed once more as one text, so a notice that is wrapped over several lines is
found whole.

Defined cases: null and empty texts have no paragraphs; lines with licence words that no family claims are unknown;
ties of confidence go to the first family by name; rows that repeat are scanned each; on a small corpus the
generated lines alone calibrate; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, materialize, value_at

#: Labelled paragraphs of each family (fixed values): the learning set and the templates.
PHRASES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ],
}
#: Lines of licences next to the families (fixed values): learned as other.
NEIGHBOURS = [
    "Licensed under the Apache License, Version 1.1.", "The Apache Software License, Version 1.1", "SPDX-License-Identifier: Apache-1.1", "Apache License Version 1.0",
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1", "GNU Lesser General Public License, version 3",
    "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU Library General Public License version 2", "SPDX-License-Identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-2.1-only",
    "GNU Affero General Public License, version 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later",
    "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "either version 2 of the License, or any later version", "SPDX-License-Identifier: GPL-2.0-only",
    "You should have received a copy of the GNU General Public License along with this program.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "GNU Free Documentation License Version 1.3", "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International", "Creative Commons Attribution-NoDerivatives 4.0", "Licensed under CC BY-ND 4.0.", "CC0 1.0 Universal",
    "Licensed under CC BY-NC 3.0.", "Creative Commons Attribution-NonCommercial 2.5", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Licensed under the Mozilla Public License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 1.1",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD license.", "BSD 3-Clause License",
    "SPDX-License-Identifier: BSD-2-Clause", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License", "SPDX-License-Identifier: ISC",
    "Academic Free License 3.0", "Licensed under the Academic Free License version 3.0", "Eclipse Public License, version 1.0", "Released under the Boost Software License, Version 1.0.",
]
#: Names of licences that are no family (fixed values); every second one is learned as other, the rest calibrates.
OTHER_NAMES = [
    "Artistic License 2.0", "European Union Public Licence 1.2", "Common Development and Distribution License 1.0", "zlib License", "SIL Open Font License 1.1", "Open Software License 3.0", "PostgreSQL License", "Ruby License",
    "Python Software Foundation License Version 2", "Vim License", "Microsoft Public License", "Sleepycat License", "Educational Community License 2.0", "Common Public Attribution License 1.0", "CeCILL License 2.1", "Mulan Permissive Software License 2",
    "Open Database License 1.0", "Universal Permissive License 1.0", "Server Side Public License 1", "Business Source License 1.1", "Elastic License 2.0", "Unlicense", "LaTeX Project Public License 1.3", "NASA Open Source Agreement 1.3",
    "Reciprocal Public License 1.5", "Q Public License 1.0", "Lucent Public License 1.02", "IBM Public License 1.0", "Common Public License 1.0", "Nokia Open Source License 1.0",
]
#: Sentences around a licence's name, and sentences of other matters with words of licences.
WRAPPERS = ["Licensed under the {}.", "Released under the {}", "This work is licensed under the {}.", "{}", "This project is released under the {}.", "distributed under the terms of the {}", "See the {} for details.", "Copyright the authors, {}"]
ORDINARY = ["the {} of a song", "She renewed her fishing {}.", "a driving {} from the city", "the {} fee of a television set", "without a {} no trade was allowed", "he lost the {} to sell wine", "an old {} on yellow paper", "the mayor signed every {}"]
ORDINARY_WORDS = ["licence", "license", "copyright", "permission", "rights"]
#: Names of the families (fixed values), learned in the sentences of WRAPPERS besides PHRASES.
FAMILY_NAMES = {
    "apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 license"], "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Attribution-NonCommercial 4.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3 or later"], "mit": ["MIT License", "MIT license (MIT)"], "proprietary": ["All rights reserved"],
}
#: What sets a family apart (fixed values): patterns that must, and must not, be in a text in lower case.
_NOT_GNU = r"lesser|library general|affero|\b[la]gpl|documentation"
MARKS = {
    "apache-2.0": (r"apache[\s\S]*?(?<![0-9.])2(?:\.0)?(?![0-9.]*[0-9])|license-2\.0", r"mozilla|\bmpl|version 1\.|-1\.[01]"),
    "cc-by-nc-4.0": (r"(?:\bcc|commons)[\s\S]*(?:\bnc\b|non[- ]?commercial)[\s\S]*?(?<![0-9.])4(?:\.0)?(?![0-9])", r"\bsa\b|share[- ]?alike|\bnd\b|no[- ]?deriv"),
    "gpl-3.0": (r"(?:\bgpl|gnu general public)[\s\S]*?(?<![0-9.])v?3(?:\.0)?(?![0-9])", _NOT_GNU),
    "mit": (r"\bmit\b|permission is hereby granted, free of charge|obtaining a copy|associated documentation files|without restriction|sublicense", r"\bfee\b|\bisc\b|apache|gnu|mozilla|\bbsd\b"),
    "proprietary": (r"rights reserved|proprietary|confidential|strictly prohibited", r"\bgnu\b|apache|mozilla|creative commons|\bbsd\b|\bmit license"),
}
#: Lines that calibration must see at least.
LEAST_LINES = 100
#: Wordings of licences in general, in lower case: a line with one is returned as unknown where no family claims it.
ANCHORS = (
    r"licen[cs]|copyright|spdx|gnu[\W_]+general|\bgpl|apache[\W_]+2|cc[\W_]+by|creative[\W_]+commons|rights[\W_]+reserved"
    r"|permission[\W_]+is[\W_]+hereby|proprietary[\W_]+and|redistribute[\W_]+it"
)
#: Lines of no family (fixed values) that the class unknown is calibrated on besides those of the corpus.
OTHERS = [
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license.",
    "Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: MPL-2.0",
    "Mozilla Public License", "BSD license", "ISC License", "Boost Software License", "This file is in the public domain.",
    "the licence fee of a television set", "a driving licence from the city", "She renewed her fishing license.", "the copyright of a song",
]
#: What all ordinary lines weigh together in learning, at most (a line by itself weighs one).
ORDINARY_WEIGHT = 1500
FALSE_SHARE = 0.01
FLOOR = 0.5
CONFIRM = 0.6
_NONE, _OTHER = "none", "other"


_WORD = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"


def words_of(line: Column) -> Column:
    """Lower-case runs of letters, digits and dots between digits."""
    return F.regexp_extract_all(F.lower(line), F.lit(_WORD), F.lit(0))


def _with_grams(lines: DataFrame) -> DataFrame:
    """lines with their words and grams: all words and pairs of neighbours."""
    from pyspark.ml.feature import NGram, RegexTokenizer

    worded = RegexTokenizer(inputCol="line", outputCol="_words", pattern=_WORD, gaps=False, toLowercase=True).transform(lines)
    # Made by explode, the words are made once a line, whatever is filtered on later.
    once = worded.select("*", F.explode(F.array("_words")).alias("words")).drop("_words")
    return NGram(n=2, inputCol="words", outputCol="pairs").transform(once).withColumn("grams", F.concat("words", "pairs")).drop("pairs")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no (from 0), line of all lines; row tells the rows of docs apart."""
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return numbered.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _holds_anchor(text: Column) -> Column:
    return F.lower(text).rlike(ANCHORS)


def _phrase_rows(spark) -> DataFrame:
    return spark.createDataFrame([(f, p) for f, ps in PHRASES.items() for p in ps], "family string, line string")


def fragments() -> list[tuple[str, str]]:
    """(family, line): runs of words of phrases that only one family has, as wrapped and short forms hold them."""
    found: dict[str, set[str]] = {}
    for family, phrases in PHRASES.items():
        for words in (re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", p.lower()) for p in phrases):
            for n in (2, 4, 8):
                for i in range(len(words) - n + 1):
                    found.setdefault(" ".join(words[i : i + n]), set()).add(family)
    return sorted((min(fs), line) for line, fs in found.items() if len(fs) == 1)


def ordinary_lines(docs: DataFrame) -> DataFrame:
    """The lines (line) without an anchor of all documents."""
    return _lines(docs).where((F.length("line") > 0) & ~_holds_anchor(F.col("line"))).select("line")


def marked(family: Column, line: Column) -> Column:
    """Whether a text holds what sets a family apart."""
    low, out = F.lower(line), F.lit(False)
    for name, (needs, bars) in MARKS.items():
        out = F.when(family == name, low.rlike(needs) & ~low.rlike(bars)).otherwise(out)
    return out


def _overlap(family: str) -> Column:
    """The largest share of the words of one of a family's templates that stand in words."""
    sets = [F.array_distinct(words_of(F.lit(p))) for p in PHRASES[family]]
    return F.greatest(*(F.size(F.array_intersect(F.col("words"), s)) / F.size(s) for s in sets))


def generated(learned: bool) -> tuple[list[str], list[str]]:
    """(lines of other licences, ordinary lines with licence words) that are learned from, or the others."""
    names = OTHER_NAMES[0 if learned else 1 :: 2]
    words = [(o, w) for i, o in enumerate(ORDINARY) for j, w in enumerate(ORDINARY_WORDS) if ((i + j) % 2 == 0) == learned]
    return [x.format(n) for n in names for x in WRAPPERS], [o.format(w) for o, w in words]


class Classifier:
    """Vocabulary and model, families (none and other among them), the marks of families, and the least confidence at which a family is accepted."""

    def __init__(self, vocabulary, model, families: list[str], floor: float):
        self.vocabulary, self.model, self.families, self.floor, self.calibrated_on, self.false_share = vocabulary, model, families, floor, 0, 1.0

    def with_scores(self, lines: DataFrame) -> DataFrame:
        """lines with words, none (whether that class is the likeliest), family and confidence (of the best family that is not none)."""
        from pyspark.ml.functions import vector_to_array

        found = self.model.transform(self.vocabulary.transform(_with_grams(lines))).withColumn("_all", vector_to_array("probability"))
        found = found.drop("grams", "features", "rawPrediction", "probability", "prediction").select("*", F.explode(F.array("_all")).alias("_p")).drop("_all")
        none, other = self.families.index(_NONE), self.families.index(_OTHER)
        known = [i for i in range(len(self.families)) if i not in (none, other)]
        # One struct: the greatest confidence, and on a tie the first family.
        best = F.greatest(*(F.struct(F.col("_p")[i].alias("c"), F.lit(-i).alias("i"), F.lit(self.families[i]).alias("f")) for i in known))
        found = found.withColumn("none", F.array_max("_p") == F.col("_p")[none]).withColumn("other", F.col("_p")[other] >= best["c"])
        return found.withColumn("_b", best).withColumn("family", F.col("_b.f")).withColumn("confidence", F.col("_b.c")).drop("_p", "_b")

    def sure(self) -> Column:
        return (F.col("confidence") > self.floor) & ~F.col("none") & ~F.col("other") & marked(F.col("family"), F.col("line"))


def train(docs: DataFrame) -> Classifier:
    """A classifier from PHRASES and all ordinary lines, not yet calibrated."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    spark = docs.sparkSession
    phrases = _with_grams(_phrase_rows(spark))
    # Each phrase as often as keeps the families from drowning in ordinary lines.
    lifted = phrases.withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("times")
    others, ordinary = generated(True)
    # Fragments of the families that neighbours hold as well speak for none of them.
    shared = " | ".join(" ".join(re.findall(_WORD, x.lower())) for x in [*NEIGHBOURS, *others])
    own = [(f, x) for f, x in fragments() if x not in shared]
    named = [(f, w.format(n)) for f, names in FAMILY_NAMES.items() for n in names for w in WRAPPERS for _ in range(3)]
    near = _with_grams(spark.createDataFrame([*named] + [(_OTHER, x) for x in NEIGHBOURS for _ in range(10)] + [(_OTHER, x) for x in others] + [(_NONE, x) for x in ordinary], "family string, line string"))
    parts = _with_grams(spark.createDataFrame(own, "family string, line string"))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=4096).fit(phrases.unionByName(near))
    # The vocabulary has the words of licences only, so vectors of ordinary lines are short and often equal.
    plain = materialize(vocabulary.transform(_with_grams(ordinary_lines(docs))).groupBy("features").agg(F.count("*").alias("lines")), "plain")
    each = min(1.0, ORDINARY_WEIGHT / (plain.agg(F.sum("lines")).first()[0] or 1))
    families = sorted([*PHRASES, _NONE, _OTHER])
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    # A corpus without a line still has the class none, by an empty line.
    empty = _with_grams(spark.createDataFrame([(_NONE, " ")], "family string, line string"))
    rows = vocabulary.transform(lifted.unionByName(parts).unionByName(near).unionByName(empty)).select("family", "features", F.lit(1.0).alias("weight"))
    rows = rows.unionByName(plain.select(F.lit(_NONE).alias("family"), "features", (F.col("lines") * each).alias("weight")))
    train = rows.select("features", label.cast("double").alias("label"), "weight")
    model = LogisticRegression(family="multinomial", regParam=0.001, maxIter=100, standardization=False, weightCol="weight").fit(train)
    discard(plain)
    return Classifier(vocabulary, model, families, FLOOR)


def calibrate(made: Classifier, judged: DataFrame) -> Classifier:
    """Sets the floor by all judged lines of the corpus and OTHERS that fit no family's templates and are not learned from."""
    # Lines without an anchor are learned from.
    worded = judged.where(_holds_anchor(F.col("line"))).select("line", F.explode(F.array(words_of(F.col("line")))).alias("words"))
    strange = worded.where(F.greatest(*map(_overlap, PHRASES)) < CONFIRM).select("line", F.lit(False).alias("made_up"))
    made_up = [(x, True) for xs in ([*OTHERS], *generated(False)) for x in xs]
    lines = strange.union(judged.sparkSession.createDataFrame(made_up, "line string, made_up boolean"))
    held = materialize(made.with_scores(lines).select("made_up", "confidence", (~F.col("none") & ~F.col("other")).alias("passed")), "held")
    made.calibrated_on = held.count()
    if made.calibrated_on < LEAST_LINES:
        raise ValueError(f"only {made.calibrated_on} lines to calibrate on, {LEAST_LINES} are needed")
    # Of held-out lines, those that none and other do not take, from the surest on: a share of FALSE_SHARE may pass.
    made.floor = FLOOR
    for lines, n in ((held, made.calibrated_on), (held.where("made_up"), len(made_up))):
        passed = lines.where("passed").select("confidence")
        after = passed.count() - 1 - int(FALSE_SHARE * n)
        if after >= 0:
            made.floor = max(made.floor, value_at(passed, after))
    made.false_share = held.where(F.col("passed") & (F.col("confidence") > made.floor)).count() / made.calibrated_on
    discard(held)
    return made


def learn(docs: DataFrame) -> Classifier:
    """A trained and calibrated classifier."""
    made = train(docs)
    return calibrate(made, materialize(_judged_lines(docs, made), "judged"))


def _judged_lines(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, row, line_no, line, words, none, family, confidence of the lines that speak for a family or hold an anchor."""
    return model.with_scores(_lines(docs).where(F.length("line") > 0)).where(~F.col("none") | _holds_anchor(F.col("line")))


def _with_verdict(found: DataFrame, model: Classifier) -> DataFrame:
    overlap = F.lit(0.0)
    for family in PHRASES:
        overlap = F.when(F.col("family") == family, _overlap(family)).otherwise(overlap)
    judged = found.withColumn("template_overlap", overlap).withColumn("_sure", model.sure())
    judged = judged.withColumn("family", F.when(F.col("_sure"), F.col("family")).otherwise("unknown"))
    return judged.withColumn("confirmed", F.col("_sure") & (F.col("template_overlap") >= CONFIRM)).drop("_sure", "none", "other", "words")


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, line_no, family (or unknown), confidence, template_overlap, confirmed of each judged line."""
    model = classifier or learn(docs)
    return _with_verdict(_judged_lines(docs, model), model).select("doc_id", "line_no", "family", "confidence", "template_overlap", "confirmed")


def scan_paragraphs(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, line_no (of the first line), n_lines, family (or unknown), confidence, template_overlap, confirmed of each licence paragraph."""
    model = classifier or train(docs)
    # Every line is scored once: what is judged does not depend on the floor.
    found = materialize(_judged_lines(docs, model), "judged")
    if classifier is None:
        calibrate(model, found)
    lines = found.select("doc_id", "row", "line_no", "line", F.when(model.sure(), F.col("family")).alias("own"))
    along = Window.partitionBy("row").orderBy("line_no")
    run = lines.withColumn("_gap", F.coalesce((F.col("line_no") - F.lag("line_no").over(along) > 1).cast("int"), F.lit(1)))
    run = run.withColumn("run", F.sum("_gap").over(along))
    before = F.last("own", True).over(Window.partitionBy("row", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    cut = run.withColumn("_cut", F.coalesce((F.col("own") != before).cast("int"), F.lit(0)))
    cut = cut.withColumn("part", F.sum("_cut").over(Window.partitionBy("row", "run").orderBy("line_no")))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    whole = cut.groupBy("doc_id", "row", "run", "part").agg(
        F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), F.array_join(F.transform(rows, lambda r: r["line"]), " ").alias("line")
    )
    judged = _with_verdict(model.with_scores(whole), model)
    return judged.select("doc_id", "line_no", "n_lines", "family", "confidence", "template_overlap", "confirmed")


def op6_license_paragraphs(spark, sf_dir: str) -> DataFrame:
    found = scan_paragraphs(documents(spark, sf_dir).select("doc_id", "text"))
    return found.withColumn("confidence", F.round("confidence", 4)).withColumn("template_overlap", F.round("template_overlap", 4))


def template_matches(text: str, family: str) -> bool:
    """Whether a whole phrase of a family stands in a text, ignoring case and spacing; for tests."""
    flat = lambda s: re.sub(r"\W+", " ", s.lower()).strip()
    return any(flat(p) in flat(text) for p in PHRASES[family])


QUERIES = {"op6_license_paragraphs": op6_license_paragraphs}
ORACLES: dict[str, str] = {}
