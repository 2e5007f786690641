from quillspark.llm import exact_dedup


def test_exact_stage_drops_exactly_the_rows_not_kept(spark):
    rows = [
        (None, "first text", "a"), (None, "second text", "b"), (None, "third text", "c"), (7, "one id", "d"), (7, "two texts of it", "e"),
        (8, "copied", "f"), (9, "copied ", "g"), (10, "second text", "h"), (11, "twice", "i"), (11, "twice", "i"), (7, "copied", "j"), (12, None, "k"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = exact_dedup.drop_exact_duplicates(docs)
    # "copied " has most characters; "second text" is kept where the id comes first, and null comes first.
    assert left.columns == docs.columns
    assert sorted(r["source"] for r in left.collect()) == list("abcdegik")


def test_exact_stage_with_one_null_id(spark):
    docs = spark.createDataFrame([(None, "x y"), (1, "xy"), (2, "z")], "doc_id long, text string")
    assert {r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()} == {None, 2}
