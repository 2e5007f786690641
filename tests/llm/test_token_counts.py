import random

import pytest

from quillspark.llm import token_counts
from quillspark.llm.common import documents


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    made = {}

    def count(text, name="word_bpe_49k.json"):
        made.setdefault(name, Tokenizer.from_file(token_counts.tokenizer_path(name)))
        return len(made[name].encode(text, add_special_tokens=False).ids)

    return count


def _hard_texts():
    r = random.Random(5)
    words = ["it's", "we'll", "I'D", "naïve", "été", "中文字", "한국어", "한", "x" * 90, "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "1234", "!!!???", "''", "'", " ", "ΟΔΟΣ", "İ", "ﬁ", "😀😀", "\n\n", "\t", "  "]
    yield from ("", " ", "a", "x" * 5000, "<|endoftext|>" * 400, "中" * 3000, "é" * 1500, " " * 4000, "!" * 3000, "1" * 3000)
    for n in (3, 50, 400, 1500, 4000):
        yield "".join(r.choice(words) + r.choice(["", "", " ", "  "]) for _ in range(n))
    yield "word " * 300 + "y" * 2500 + " word" * 300 + "z" * 900 + " end"


@pytest.mark.parametrize(("name", "chunk", "overlap"), [("word_bpe_49k.json", 200, 40), ("word_bpe_49k.json", 64, 48), ("byte_bpe_50k.json", 300, 64)])
def test_spliced_counts_equal_whole_ones(spark, whole, name, chunk, overlap):
    texts = list(_hard_texts())
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, token_counts.tokenizer_path(name), chunk, overlap).collect()}
    assert {i: got[i]["n_tokens"] for i in got} == {i: whole(t, name) for i, t in enumerate(texts)}
    assert {i: got[i]["n_bytes"] for i in got} == {i: len(t.encode()) for i, t in enumerate(texts)}
    assert max(r["n_chunks"] for r in got.values()) > 5 and got[3]["n_chunks"] == 1  # one word of 5,000 letters has no boundary inside


def test_sentence_piece_files_are_counted_whole(spark):
    import sentencepiece

    path = token_counts.tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = list(_hard_texts())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: len(lib.encode(t)) for i, t in enumerate(texts)}


def test_nulls_repeats_and_empty_tables(spark):
    long_text = "some words of a long text " * 3000
    rows = [(None, None, 1), (None, long_text, 2), (7, long_text, 3), (7, long_text, 3), (7, "other", 4), (8, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, token_counts.tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == [(0, 0, 0), (0, 78000, 18000), (7, 5, 1), (7, 78000, 18000), (7, 78000, 18000), (8, 0, 0)]
    assert token_counts.count_tokens(docs.limit(0), token_counts.tokenizer_path()).count() == 0


def test_query_equals_the_library(spark, sf_dir, whole):
    texts = {r["doc_id"]: r["text"] or "" for r in documents(spark, sf_dir).collect()}
    got = token_counts.op11_token_counts(spark, sf_dir).collect()
    want = {i: (len(t.encode()), whole(t), whole(t) > 2048) for i, t in texts.items()}
    assert len(got) == len(want) and {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == want
