from pyspark.sql import functions as F

from quillspark.llm import licenses


def test_every_ordinary_line_is_learned_from(spark):
    """Lines with words of a family in another matter, whose hashes are not among the least, teach what they are."""
    odd = "to deal in the city without limitation"
    places = spark.range(10_000, 10_200).where(F.xxhash64("id", F.lit(0), F.lit(odd)) > 0).limit(60).collect()
    few = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("the river was cold").alias("text"))
    many = few.union(spark.createDataFrame([(r["id"], odd) for r in places], "doc_id long, text string"))
    line = spark.createDataFrame([(odd,)], "line string")
    before, after = (licenses.learn(docs).with_scores(line).first()["confidence"] for docs in (few, many))
    assert after < before - 0.1


def test_every_strange_line_calibrates(spark):
    strange = "a copyright of the {} in the manual of songs and rivers, old and new, cold and wide, with no licence of its own"
    docs = spark.createDataFrame([(i, strange.format("town " * (i % 7 + 1))) for i in range(2000)] + [(2000, "All rights reserved.")], "doc_id long, text string")
    made = licenses.learn(docs)
    made_up = sum(len(xs) for xs in ([*licenses.OTHERS], *licenses.generated(False)))
    assert made.calibrated_on == 2000 + made_up and made.false_share <= licenses.FALSE_SHARE
