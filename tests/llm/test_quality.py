import zlib

import numpy as np

from quillspark.llm import quality

BIG = "/root/testdata/sf0.1"


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    seen = set()
    for n in (1, 3, 7):
        dealt = docs.repartition(n)
        rows = quality.score(dealt.selectExpr("doc_id", "false as held_out", "text"), quality.learn(dealt, labels)).collect()
        seen.add(tuple(sorted((r["doc_id"], r["score"]) for r in rows)))
    assert len(seen) == 1


def test_repeated_rows_and_ties(spark):
    rows = [(1, "good plain words here and there"), (1, "good plain words here and there"), (2, "BAD!! BAD!! BAD!! BAD!!"), (2, "BAD!! BAD!! BAD!! BAD!!"), (3, "good plain words here and there")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    ranker = quality.learn(docs, labels)
    got = [(r["doc_id"], r["score"]) for r in quality.score(docs.selectExpr("doc_id", "false as held_out", "text"), ranker).collect()]
    assert len(got) == 5 and len(set(got)) == 3 and len({s for d, s in got if d != 2}) == 1
    assert all((s >= 0.3) == (d != 2) for d, s in got)


def test_accuracy_on_held_out_documents_by_label(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = [r for r in quality.op8_bradley_terry_quality(spark, BIG).collect() if r["held_out"] and r["doc_id"] in label]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    for q in (0, 1):
        share = np.mean([r["predicted"] == q for r in rows if label[r["doc_id"]] == q])
        print("label", q, "held-out accuracy", share)
        assert share > 0.97


def test_words_of_one_row_do_not_touch_the_next():
    texts = [b"a a a", b"a b", b"", b"B! c"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    both = quality.features(data, offsets)
    for i, t in enumerate(texts):
        assert (quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)])) == both[i]).all()
