import math

import numpy as np

from quillspark.operators import ranking as R
from quillspark.plans import table_queries as Q


def sheet(spark, folder, custkeys, n=400):
    """Tables events and customer, and the items that table_queries draws from events."""
    rng = np.random.default_rng(5)
    users = [int(u) for u in rng.integers(0, 90, n)]
    spark.createDataFrame([(i, u, "click") for i, u in enumerate(users)], "event_id long, user_id long, event_type string").write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(c,) for c in custkeys], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    at = [(u * 7 % 100, i % 100) for i, u in enumerate(users)]
    return [(i, x, y, x + i % 7, y + i % 5) for i, (x, y) in enumerate(at)], custkeys


def test_boxes_of_all_customers(spark, tmp_path):
    items, keys = sheet(spark, tmp_path, range(0, 400, 13))
    wanted = {}
    for c in keys:
        x, y = c % 90, c * 3 % 90
        hit = [i for i, x0, y0, x1, y1 in items if x0 <= x + 3 and x1 >= x and y0 <= y + 2 and y1 >= y]
        if hit:
            wanted[c] = (len(hit), sum(hit))
    got = {r["box_id"]: (r["n"], r["total"]) for r in Q.flt_items_in_boxes(spark, str(tmp_path)).collect()}
    assert got == wanted and max(got) > 150


def test_nearest_item_of_all_customers(spark, tmp_path):
    items, keys = sheet(spark, tmp_path, range(0, 400, 13))
    wanted = {}
    for c in keys:
        px, py = c % 97, c * 5 % 97
        away = []
        for _, x0, y0, x1, y1 in items:
            n = (x1 - x0) ** 2 + (y1 - y0) ** 2
            t = max(0, min(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / n)) if n else 0
            away.append(math.hypot(px - x0 - t * (x1 - x0), py - y0 - t * (y1 - y0)))
        if min(away) <= 3:
            wanted[c] = round(min(away), 5)
    got = {r["point_id"]: r["distance"] for r in Q.flt_nearest_item(spark, str(tmp_path)).collect()}
    assert got.keys() == wanted.keys() and max(got) > 150
    assert all(abs(got[c] - wanted[c]) < 2e-5 for c in got)


def vectors(spark, folder, n=90):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(n, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v[i]], i % 4) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    v = v.astype(float)
    return {q: v @ v[q] for q in range(0, n, 20)}


def test_ranking_of_all_queries(spark, tmp_path):
    sims = vectors(spark, tmp_path)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["sim"]) for r in Q.srt_cosine_topk(spark, str(tmp_path)).collect()}
    assert len(got) == 10 * len(sims)
    for q, s in sims.items():
        for rank, i in enumerate(np.argsort(-s, kind="stable")[:10].tolist(), 1):
            assert got[q, rank][0] == i and abs(got[q, rank][1] - s[i]) < 2e-6


def test_family_best_of_all_queries(spark, tmp_path):
    sims = vectors(spark, tmp_path)
    got = {(r["query_id"], r["label"]): r["vec_id"] for r in Q.agg_family_best(spark, str(tmp_path)).collect()}
    assert got == {(q, f): max(range(f, len(s), 4), key=lambda i: s[i]) for q, s in sims.items() for f in range(4)}


def test_scores_in_blocks(spark):
    rows = spark.range(50).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding", "0 as label")
    queries = rows.selectExpr("vec_id as query_id", "embedding as query")
    scores = R.cosine_scores(rows, queries, block=7)
    assert {(r["query_id"], r["vec_id"]): r["sim"] for r in scores.collect()} == {(q, v): q * v + 1.0 for q in range(50) for v in range(50)}
    assert "Broadcast" not in scores._jdf.queryExecution().toString()
    assert R.cosine_scores(rows, queries.limit(0)).count() == 0


def test_boxes_and_items_of_all_sizes(spark):
    from quillspark.operators import geometry as G

    rng = np.random.default_rng(8)
    def some(n):
        at, size = rng.uniform(-300, 300, (n, 2)), 10 ** rng.uniform(-2, 3, (n, 2))
        return [(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(at, size, strict=True))]
    items, boxes = some(150), some(60)
    a = spark.createDataFrame([("f", 1, *r) for r in items], "file string, sheet int, item_no long, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([("f", 1, *r) for r in boxes], "file string, sheet int, box_id long, bx0 double, by0 double, bx1 double, by1 double")
    got = [(r["box_id"], r["item_no"]) for r in G.in_boxes(a, b, 2.0).collect()]
    want = {(j, i) for j, bx0, by0, bx1, by1 in boxes for i, x0, y0, x1, y1 in items if x0 <= bx1 and x1 >= bx0 and y0 <= by1 and y1 >= by0}
    assert len(got) == len(set(got)) and set(got) == want


def test_layer_pairs_of_a_board_with_many_layers(spark):
    """As by going through A and looking for the first of B that is left; thousands of layers of a board take seconds."""
    import random
    import time

    draw = random.Random(4)
    layer = lambda i, n: (7, i, f"f{draw.randrange(n)}" if draw.random() < 0.9 else None, f"n{draw.randrange(n)}", f"x{draw.randrange(3)}")
    schema = "board long, layer_no long, function string, name string, file string"
    a, b = ([layer(i, 40) for i in draw.sample(range(500), 200)] for _ in range(2))
    want, used = set(), set()
    for _, no, *said in sorted(a):
        hit = next(((y[1], k) for j, k in enumerate(("function", "name", "file")) for y in sorted(b) if said[j] is not None and y[2 + j] == said[j] and y[1] not in used), None)
        used |= {hit[0]} if hit else set()
        want.add((7, no, *(hit or (None, "only_a"))))
    want |= {(7, None, y[1], "only_b") for y in b if y[1] not in used}
    assert {tuple(r) for r in R.paired_layers(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()} == want
    many = spark.createDataFrame([layer(i, 400) for i in range(4000)], schema)
    began = time.monotonic()
    assert R.paired_layers(many, many).where("b_no is not null").count() == 4000 and time.monotonic() - began < 30


def test_best_vectors_by_chunks_are_as_of_all_scores(spark):
    """Copies that tie, a label of null, chunks and blocks that cut anywhere: as by scoring all pairs one by one."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, None if i % 5 == 0 else i % 3, [float(x) for x in base[i % 40 if i < 90 else i % 2]]) for i in rng.permutation(130).tolist()]
    v = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    q = v.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding as query")
    scores = R.cosine_scores(v, q)
    for chunk, block in ((7, 5), (1000, 1000)):
        got = R.best_vectors(v, q, 6, chunk=chunk, block=block)
        assert {tuple(r) for r in R.top_k(got, 6).collect()} == {tuple(r) for r in R.top_k(scores, 6).collect()}
        got = R.best_vectors(v, q, 1, True, chunk=chunk, block=block)
        assert {tuple(r) for r in R.best_by_family(got).collect()} == {tuple(r) for r in R.best_by_family(scores).collect()}
    assert got.count() < scores.count() / 4
