import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing
from quillspark.llm.tokenize import tokenizer

WINDOW = packing.WINDOW


def whole_ids(texts):
    t = Tokenizer.from_file(packing.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def verify(pieces, ids_by_doc, window=WINDOW):
    """Every id in exactly one piece, codes right, sequences gapless and within the window."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids_by_doc.keys()
    for doc, own in by_doc.items():
        ids, at = ids_by_doc[doc], 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : at], "<u4").tobytes())
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    return len(by_seq)


def test_combinations_fill_the_window():
    c = packing.combinations(16, 3)
    assert (c.sum(1) == 16).all() and len(np.unique(c, axis=0)) == len(c)
    assert len(c) == sum(1 for a in range(1, 17) for b in range(0, a + 1) for d in range(0, b + 1) if a + b + d == 16)


def test_least_squares_matches_its_conditions():
    rng = np.random.default_rng(3)
    places = packing.combinations(24, 3)
    b = rng.integers(0, 50, 24).astype(float)
    x = packing.non_negative_least_squares(places, b)
    a = np.stack([np.bincount(p[p > 0], minlength=25)[1:] for p in places], 1)
    slope = a.T @ (b - a @ x)
    assert (x >= 0).all() and slope.max() < 1e-4 and np.abs(slope[x > 0]).max() < 1e-4


@pytest.mark.parametrize("lengths", [[], [5], [2047] * 3, [1500] * 40, list(range(1, 2048, 3))])
def test_plan_gives_each_piece_one_place(lengths):
    counts = np.bincount(lengths, minlength=WINDOW).astype(np.int64)
    plan = packing.Plan(counts)
    if not lengths:
        return
    length = np.sort(lengths)
    rank = np.concatenate([np.arange(c) for c in counts])
    seq, off, res = plan.place(length, rank)
    filled = {}
    for s, o, n, r in zip(seq.tolist(), off.tolist(), length.tolist(), res.tolist(), strict=True):
        assert r or o + n <= WINDOW
        for at in range(o, o + n):
            spot = (s + at // WINDOW, at % WINDOW)
            assert spot not in filled
            filled[spot] = True


def test_word_tokenizer_equals_the_tokenizer():
    odd = ["Hello, World!! it's don't 12ab3 ÉÀÿß×÷ <|endoftext|> x<|startoftext|>y", "", " \n ", "naïve “quoted” 日本語 Привет é",
           "a\x00b \x1c\x7f", None, "İI ΣΑΣ ² ¼ ١٢", "''s 'S !!'s a'LLb", "x" * 3000, "a\u0085b c"]
    import pyarrow as pa

    from quillspark.llm.common import flat_text

    data, offsets = flat_text(pa.record_batch([pa.array(odd, pa.string())], names=["text"]))
    ids, at = tokenizer(packing.tokenizer_path()).ids(data, offsets)
    assert [ids[a:b].tolist() + [1] for a, b in zip(at[:-1], at[1:], strict=True)] == whole_ids(odd)


def test_query_against_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = dict(zip(docs, whole_ids(docs.values()), strict=True))
    pieces = [r.asDict() for r in packing.op1_nnls_packing(spark, sf_dir).collect()]
    n = verify(pieces, ids)
    total = sum(map(len, ids.values()))
    assert n * WINDOW - total < 0.03 * total + WINDOW


def test_odd_tables(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "word " * 5000, 7), (4, "a b", 7), (4, "a b", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    pieces = [r.asDict() for r in packing.pack_documents(docs, packing.tokenizer_path()).collect()]
    assert sum(p["length"] for p in pieces) == sum(map(len, whole_ids([t for _, t, _ in rows])))
    assert packing.pack_documents(docs.limit(0), packing.tokenizer_path()).count() == 0
