import re

import corpus_pipeline
from quillspark.llm import exact_dedup, ngram_join, packing
from tests.llm.test_dedup import brute_classes, normal
from tests.llm.test_packing import verify, whole_ids


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = ngram_join.materialize(stage(spark, now, sf_dir), "test")
        if i < 4:
            assert out.columns == docs.columns
            after = {r["doc_id"] for r in out.collect()}
            assert after <= set(before)
        if i == 0:
            wrong = [d for d in before if d in quality and (d in after) != (quality[d] == 1)]
            assert len(wrong) <= 2
        elif i == 1:
            best = {}
            for d, t in before.items():
                key = (-len(t or ""), d)
                best[normal(t)] = min(best.get(normal(t), key), key)
            assert after == {d for _, d in best.values()}
        elif i == 2:
            classes = brute_classes(list(before.items()), 5, 80, 100)
            assert after == {d for d, (_, c) in classes.items() if c == d}
        elif i == 3:
            assert 0.3 < len(after) / len(before) <= 1
        else:
            ids = dict(zip(before, whole_ids(before.values()), strict=True))
            verify([r.asDict() for r in out.collect()], ids)
        now = out


def test_empty_documents(spark, sf_dir):
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = ngram_join.materialize(stage(spark, now, sf_dir), "empty")
        assert now.count() == 0


def test_run_and_names():
    assert corpus_pipeline.ORACLE_SQL is None
    assert all(re.fullmatch(r"op\d+_\w+", n) for m in (packing, exact_dedup, ngram_join) for n in m.QUERIES)
