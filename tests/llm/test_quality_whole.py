import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, quality


def test_all_pairs_count():
    """The weights are where the loss over all pairs, formed one by one, has no slope."""
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0.5, 1, (70, 3)), rng.normal(-0.5, 1, (40, 3))
    good[0, 2] = 300  # far from the rest
    r = quality.Ranker(good, bad)
    x, x0 = ((v - r.mean) / r.scale for v in (good, bad))
    diff = (x[:, None] - x0[None]).reshape(-1, 3)
    wrong = 1 / (1 + np.exp(diff @ r.weights))
    assert np.abs(diff.T @ wrong / len(diff) - quality.RIDGE * r.weights).max() < 1e-6


def test_no_labelled_document_is_left_out(spark):
    """Of 4,040 documents of label 0 the 40 with the greatest hashes of their ids are of a kind of their own."""
    ids = [r["id"] for r in spark.range(4140).orderBy(F.xxhash64("id"), "id").collect()]
    bad, good = ids[:4000] + ids[4100:], ids[4000:4100]
    text = {d: "LOUD WORDS IN CAPITALS" for d in bad[:4000]} | {d: "so so so so so so so" for d in bad[4000:]} | {d: "plain words in a row" for d in good}
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0) for d in bad] + [(d, 1) for d in good], "doc_id long, quality int")
    ranker = quality.learn(docs, labels)
    rows = quality.score(docs.selectExpr("doc_id", "false as held_out", "text"), ranker).collect()
    assert not [r["doc_id"] for r in rows if r["predicted"] != (r["doc_id"] in good)]

    def of(chosen):
        texts = [text[d].encode() for d in chosen]
        return quality.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))

    plain = quality.Ranker(of(good), of(bad))
    assert ranker.weights == pytest.approx(plain.weights, abs=1e-5) and ranker.threshold == pytest.approx(plain.threshold, abs=1e-4)


def test_value_of_a_rank(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW", 10)
    values = [float(x) for x in np.random.default_rng(2).lognormal(0, 4, 500)] + [1.0] * 100 + [1.0 + 2.0**-52] * 50
    table = spark.createDataFrame([(v,) for v in values], "v double")
    for rank in (0, 1, 200, 300, 330, 360, 390, 420, 649):
        assert common.value_at(table, rank) == sorted(values)[rank]
