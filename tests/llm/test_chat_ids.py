from quillspark.llm import chat


def test_conversation_with_null_id(spark, tmp_path):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "hello"), (None, 2, "user", "bye"), (5, 0, "user", "x"), (5, 1, "assistant", "yz")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.op3_reply_tree_chat(spark, str(tmp_path)).collect()}
    assert got.pop(-1)[0] == 2 and got == {None: (3, 5), 5: (2, 2)}


def test_branches_with_null_id(spark):
    rows = [(None, 1, None, "user", "hi", 0.0), (None, 2, 1, "assistant", "bad", 0.1), (None, 3, 1, "assistant", "good", 0.9), (None, 4, 3, "user", "more", 0.5)]
    nodes = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    r = chat.read_back(chat.format_paths(nodes)).collect()
    assert [[t["text"] for t in x["turns"]] for x in r] == [["hi", "good", "more"]]
