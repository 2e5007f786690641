import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing


def share(spark, d):
    return spark.createDataFrame(list(d.items()), "key string, share double")


def test_clashing_names_stay(spark):
    rows = [(1, "a b", "en", "s", "own", 7, 3.0), (2, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _mix_topic string, _mix_id int, _doc double")
    out = mixing.sample_documents(docs)
    assert out.columns == docs.columns and set(map(tuple, out.collect())) <= set(rows)
    assert mixing.calibrated(docs).count() == 2


def test_gaps_show_targets_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "x", "p", 10.0), ("b", "y", "p", 30.0)], "source string, lang string, topic string, mass double")
    # Source a speaks only x: the two targets contradict each other.
    goals = {"source": share(spark, {"a": 0.9, "b": 0.1}), "lang": share(spark, {"x": 0.5, "y": 0.5}), "topic": share(spark, {"p": 1.0})}
    far = mixing.gaps(mixing.rake(cells, goals, 20), goals).agg(F.max(F.abs(F.col("target") - F.col("reached")))).first()[0]
    assert far > 0.3
    fair = {"source": share(spark, {"a": 0.5, "b": 0.5}), "lang": share(spark, {"x": 0.5, "y": 0.5}), "topic": share(spark, {"p": 1.0})}
    near = mixing.gaps(mixing.rake(cells, fair, 20), fair).agg(F.max(F.abs(F.col("target") - F.col("reached")))).first()[0]
    assert near < 1e-9


def test_an_expected_number_of_tokens(spark):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", f"s{i % 5}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.calibrated(docs, tokens=4000).where("_mix_kept").agg(F.sum("_mix_tokens")).first()[0]
    assert got == pytest.approx(4000, rel=0.1)


def test_python_free_plan(spark, sf_dir):
    plan = mixing.op2_raked_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
