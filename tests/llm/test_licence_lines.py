import pytest

from quillspark.llm import licenses

BIG = "/root/testdata/sf0.01"
KNOWN = [
    ("GPL-3.0-or-later", "gpl-3.0"), ("Available under CC-BY-NC-4.0", "cc-by-nc-4.0"), ("Apache-2.0", None), ("GNU General Public License, version 3", "gpl-3.0"),
    ("Free software under the GNU GPL v3", None), ("See the licenses of each part", None), ("licensing terms", None), ("you may sublicense it", None),
    # A wrapped text, a line of it each.
    ("Permission is hereby granted, free of charge, to any person", "mit"), ("obtaining a copy of this software and associated documentation files", "mit"),
]
STRANGE = ["Distributed under the Mozilla Public License", "BSD license", "a new driving licence for the old man", "the weather in the old town"]


@pytest.fixture(scope="module")
def found(spark):
    model = licenses.learn(spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text"))
    docs = spark.createDataFrame([(1000, "\n".join([x for x, _ in KNOWN] + STRANGE))], "doc_id long, text string")
    return {(r["doc_id"], r["line_no"]): r for r in licenses.scan(docs, model).collect()}


def test_no_wording_is_lost(found):
    lost = [x for i, (x, _) in enumerate(KNOWN) if (1000, i) not in found]
    assert not lost
    assert not [x for i, (x, f) in enumerate(KNOWN) if f and found[1000, i]["family"] != f]


def test_other_licences_are_unknown(found):
    at = len(KNOWN)
    assert [found[1000, at + i]["family"] for i in range(3)] == ["unknown"] * 3 and (1000, at + 3) not in found
