import hashlib

from quillspark.llm import chat


def test_empty_long_and_clashing(spark):
    long = "x<|im_end|>\\<|" * 60_000
    rows = [(1, 0, "user", long, "h", 5), (1, 1, "assistant", long, "b", 6), (2, 0, None, None, "f", 7), (3, 0, "a\nb", "<\\\\|", "t", 8), (3, 0, "a\nb", "<\\\\|", "t", 8)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, head string, up int")
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_paths(chat.threads(turns))).collect()}
    assert [t["text"] for t in back[1]["turns"]] == [long, long] and back[1]["loss_text"] == long
    assert [(t["role"], t["text"]) for t in back[2]["turns"]] == [("", "")]
    assert [(t["role"], t["text"]) for t in back[3]["turns"]] == [("a\nb", "<\\\\|")] * 2
    assert chat.format_paths(chat.threads(turns.limit(0))).count() == 0


def test_query_on_empty_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat.op3_reply_tree_chat(spark, str(tmp_path)).collect()
    text = "<|im_end|><|im_start|>assistant ok"
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"], r["loss_sha256"]) for r in got] == [(-1, 2, len(text), hashlib.sha256(text.encode()).hexdigest())]


def test_branches_by_score_and_ties(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (2, 1, None, "user", "q", None), (2, 3, 1, "assistant", "b", 0.5), (2, 2, 1, "assistant", "a", 0.5)]
    tree = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    out = chat.read_back(chat.format_paths(tree, branches=2)).orderBy("conv_id", "path_rank").collect()
    assert [[t["text"] for t in r["turns"]] for r in out] == [["q", "good", "more"], ["q", "bad"], ["q", "a"], ["q", "b"]]
