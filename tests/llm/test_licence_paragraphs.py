import pytest

from quillspark.llm import licenses

BIG = "/root/testdata/sf0.01"
WRAPPED = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
#: Wordings that are not among the phrases.
HELD_OUT = [
    ("Distributed under the terms of the Apache License 2.0", "apache-2.0"), ("apache license, version 2.0", "apache-2.0"), ("This library is MIT licensed, see the MIT License", "mit"),
    ("Code is released under MIT License terms", "mit"), ("published under the GNU General Public License v3", "gpl-3.0"), ("GNU General Public License version 3 or later", "gpl-3.0"),
    ("Texts under Creative Commons Attribution-NonCommercial 4.0", "cc-by-nc-4.0"), ("Photos: CC BY-NC 4.0", "cc-by-nc-4.0"), ("Some company. All rights reserved.", "proprietary"), ("ALL RIGHTS RESERVED", "proprietary"),
]
STRANGE = ["Mozilla Public License Version 2.0", "Distributed under the Mozilla Public License", "BSD license", "the licence fee of a television set", "Eclipse Public License"]


@pytest.fixture(scope="module")
def model(spark):
    return licenses.learn(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text"))


def scanned(spark, model, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, line string, family string")
    return {(r["doc_id"], r["line_no"]): r for r in licenses.scan_paragraphs(docs, model).collect()}


def test_a_wrapped_notice_is_one_paragraph(spark, model):
    text = "The river was cold and the old town quiet.\n" + WRAPPED + "\nThe river was warm.\nAll rights reserved.\nReleased under the MIT License."
    got = scanned(spark, model, [(1, text, 1, "x", "y")])
    assert got[1, 1]["n_lines"] == 3 and got[1, 1]["family"] == "mit" and got[1, 1]["confirmed"]
    # Neighbours of different families stay apart.
    assert got[1, 5]["family"] == "proprietary" and got[1, 6]["family"] == "mit" and set(got) == {(1, 1), (1, 5), (1, 6)}


def test_calibration_holds_the_share_of_false_lines(model):
    assert licenses.FLOOR <= model.floor < 1 and model.false_share <= licenses.FALSE_SHARE and model.calibrated_on >= licenses.LEAST_LINES


def test_held_out_wordings(spark, model):
    rows = [(i, "Ordinary words about the weather.\n" + t, 0, "", "") for i, (t, _) in enumerate(HELD_OUT)] + [(100 + i, t, 0, "", "") for i, t in enumerate(STRANGE)]
    got = scanned(spark, model, rows)
    right = [got.get((i, 1)) is not None and got[i, 1]["family"] == f for i, (_, f) in enumerate(HELD_OUT)]
    wrong = [got.get((100 + i, 0)) is not None and got[100 + i, 0]["family"] != "unknown" for i in range(len(STRANGE))]
    print("recall on held-out wordings", sum(right) / len(right), [HELD_OUT[i] for i, x in enumerate(right) if not x], "other licences named", sum(wrong), "of", len(wrong))
    assert sum(right) >= 0.8 * len(right) and not any(wrong)
    assert all((i, 1) in got for i in range(len(HELD_OUT))) and all((100 + i, 0) in got for i in range(len(STRANGE)))


def test_recall_against_a_plain_scan(spark, model):
    """Every whole phrase that stands in a text is found and confirmed, and nothing else is confirmed."""
    docs = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text")
    want = {(r["doc_id"], f) for r in docs.collect() for f in licenses.PHRASES if licenses.template_matches(r["text"] or "", f)}
    got = {(r["doc_id"], r["family"]) for r in licenses.scan_paragraphs(docs, model).where("confirmed").collect()}
    print("phrases", len(want), "confirmed", len(got), "both", len(want & got))
    assert len(want & got) >= 0.98 * len(want) and len(want & got) >= 0.98 * len(got)


def test_empty_null_and_long_texts(spark, model):
    long = "plain words of a long text " * 40_000 + "\n" + "Released under the MIT License."
    got = scanned(spark, model, [(1, None, 0, "", ""), (2, "", 0, "", ""), (3, "\n\n", 0, "", ""), (4, long, 0, "", ""), (5, "MIT License\n" * 3000, 0, "", ""), (6, "x", 0, "", ""), (6, "Licensed under the MIT license", 0, "", "")])
    assert {k[0] for k in got} == {4, 5, 6} and got[4, 1]["confirmed"] and got[5, 0]["n_lines"] == 3000
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_paragraphs(empty, model).count() == 0
    assert licenses.scan_paragraphs(empty).count() == 0
