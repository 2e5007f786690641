"""Texts of regular build, repeated ids and clashing names must not change what the operators find."""

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common, exact_dedup, mixing, ngram_join, packing
from quillspark.llm.tokenize import _groups, tokenizer
from tests.llm.test_dedup import brute_classes, corpus
from tests.llm.test_packing import whole_ids


def thue_morse(n, a="a", b="b"):
    s = a
    t = b
    while len(s) < n:
        s, t = s + t, t + s
    return s, t


def test_thue_morse_words_have_their_own_hashes():
    for n in (64, 1024, 4096):
        text = " ".join(thue_morse(n)).encode()
        data = np.frombuffer(text, np.uint8)
        starts, ends, _ = common.word_spans(data, np.array([0, len(data)]))
        h = common.span_hashes(common.BYTE_CODES[data], starts, ends)
        assert len(set(h.tolist())) == 2


def test_token_ids_of_thue_morse_words():
    texts = [t for n in (256, 1024, 2048) for t in thue_morse(n)]
    from quillspark.llm.common import flat_text

    data, offsets = flat_text(pa.record_batch([pa.array(texts)], names=["text"]))
    ids, at = tokenizer(packing.tokenizer_path()).ids(data, offsets)
    assert [ids[a:b].tolist() + [1] for a, b in zip(at[:-1], at[1:], strict=True)] == whole_ids(texts)


def test_groups_hold_under_a_useless_hash(monkeypatch):
    from quillspark.llm import tokenize

    monkeypatch.setattr(tokenize, "span_hashes", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabdabcab", np.uint8)
    starts, ends = np.array([0, 3, 6, 9]), np.array([3, 6, 9, 11])
    which, first = _groups(data, starts, ends)
    assert which.tolist() == [0, 1, 0, 2] and first.tolist() == [0, 1, 3]


def test_joins_of_thue_morse_words(spark):
    rows = [(i, t) for i, t in enumerate(t for n in (1024, 2048) for t in thue_morse(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(docs).collect()}
    assert got == {i: i for i, _ in rows}


@pytest.mark.parametrize("seed", [11, 12])
def test_large_buckets_in_small_blocks(spark, monkeypatch, seed):
    """Beyond BLOCK, CHUNK, BUFFER and the broadcast of ids the classes are the same."""
    for name, value in {"BLOCK": 5, "CHUNK": 7, "BUFFER": 20, "BROADCAST_IDS": 0, "LEVEL_SLOTS": 1 << 12, "RANGE_BYTES": 512, "FIRST_BUCKETS": 1, "FEW_PAIRS": 20}.items():
        monkeypatch.setattr(ngram_join, name, value)
    rows = corpus(seed, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(docs, 4, 85, 100, rare_below=3, small=2).collect()}
    assert got == brute_classes(rows, 4, 85, 100)


@pytest.mark.parametrize("num,den", [(50, 100), (80, 100), (85, 100), (95, 100)])
def test_signatures_of_large_similar_sets_meet(num, den):
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(1500):
        n = int(rng.integers(10, 160))
        universe = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
        level = np.where(rng.random(len(universe)) < 0.15 * rng.random(), 0, rng.integers(1, 3, len(universe))).astype(np.uint8)
        x = rng.choice(len(universe), n, replace=False)
        away = (1 - num / den) * rng.random() / 1.6
        y = x[rng.random(n) > away]
        y = np.unique(np.concatenate((y, rng.choice(len(universe), int(n * away)))))
        x = np.sort(x)
        both = len(np.intersect1d(x, y))
        if len(x) == len(y) == both or den * both < num * (len(x) + len(y) - both):
            continue
        met += 1
        assert np.intersect1d(ngram_join.signatures(universe[x], level[x], num, den), ngram_join.signatures(universe[y], level[y], num, den)).size
    assert met > 100


def test_one_very_long_text(spark):
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(50_000))
    rows = [(1, long), (2, long + " tail"), (3, "short text of five words"), (4, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_classes(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_stages_with_any_column_names(spark):
    rows = [(1, "one two three four five six", 1, 2, 3), (2, "one two three four five six", 1, 2, 3), (3, "seven", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, need int, row int")
    for stage in (exact_dedup.drop_exact_duplicates, ngram_join.keep_one_of_each_class):
        kept = stage(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 3}


def test_stages_with_dotted_names(spark):
    rows = [(1, "one two three four five six", "en", "s", 1), (1, "one two three four five six", "en", "s", 2), (2, "seven", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b c` int")
    for stage in (exact_dedup.drop_exact_duplicates, ngram_join.keep_one_of_each_class, mixing.sample_documents):
        out = stage(docs)
        assert out.columns == docs.columns and out.count() <= 3


def test_repeated_ids_with_different_texts(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (2, "alpha beta gamma delta epsilon zeta"), (3, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()) == rows[:2][::1]
    assert sorted(tuple(r) for r in ngram_join.keep_one_of_each_class(docs).collect()) == rows[:2]
    got = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.similar_classes(docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1)]
