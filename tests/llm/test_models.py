import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import language_id, licenses, mixing, quality, url_rules

BIG = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language_id.op5_rank_order_language(spark, BIG).collect()
    assert len(rows) == len(lang) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", False), (2, "der hund und die katze", "de", False), (3, None, "en", True), (4, "12 !?", None, True), (5, "THE DOG " * 9000, "de", True), (6, "", "en", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out boolean")
    model = language_id.learn_profiles(docs.where("not held_out"))
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 6)] == ["und"] * 3 and got[5]["lang_pred"] == "en" and got[2]["lang_pred"] == "de"
    assert language_id.identify(docs.limit(0), model).count() == 0
    nothing = language_id.learn_profiles(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_out_of_place_distance_by_hand():
    ranked = lambda t: [language_id.gram_text(g) for g in language_id.ranked_grams(t)[0]]
    p = language_id.Profiles({"x": ranked("aaab"), "y": ranked("bbba")})
    assert p.judge("aaab")[0] == "x" and p.judge("bbba")[0] == "y"
    assert p.judge("aaab")[1] > 0


def test_quality_held_out(spark):
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = quality.op8_bradley_terry_quality(spark, BIG).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in held]) > 0.96
    assert len({r["doc_id"] for r in rows}) == 1000


def test_quality_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "A", 3), (4, "word " * 40_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    nothing = quality.learn(docs, labels)
    assert quality.keep_good(docs, nothing).count() == 4 and quality.keep_good(docs, nothing).columns == docs.columns
    assert quality.keep_good(docs.limit(0), nothing).count() == 0


def test_pairwise_weights_order_the_labels():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (300, 3)), rng.normal(-1, 1, (100, 3))
    r = quality.Ranker(good, bad)
    assert (r.score(good) >= 0.3).mean() > 0.95 and (r.score(bad) < 0.3).mean() > 0.85


def test_raking_meets_its_targets(spark):
    rows = [("a", "x", "p", 10.0), ("a", "y", "p", 30.0), ("b", "x", "q", 5.0), ("b", "y", "p", 50.0), ("b", "x", "p", 5.0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, mass double")
    share = lambda d: spark.createDataFrame(list(d.items()), "key string, share double")
    goals = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.4, "y": 0.6}, "topic": {"p": 0.9, "q": 0.1}}
    got = mixing.rake(cells, {k: share(v) for k, v in goals.items()}, rounds=40).toPandas()
    for dim, goal in goals.items():
        assert got.groupby(dim)["weight"].sum().to_dict() == pytest.approx(goal, abs=1e-4)


def test_mixing_odd_rows(spark):
    rows = [(1, None, None, None, 1), (2, "Licensed x", "en", "s", 2), (3, "", "en", "s", 3), (None, "a b", "de", "t", 4), (4, "a | b", "de", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight long")
    out = mixing.calibrated(docs).collect()
    assert len(out) == 5 and {r["_mix_topic"] for r in out} == {"general", "legal", "tabular"}
    assert mixing.sample_documents(docs).columns == docs.columns
    assert mixing.sample_documents(docs.limit(0)).count() == 0


def test_shares_after_sampling(spark):
    out = mixing.calibrated(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("_mix_kept")
    got = out.groupBy("_mix_lang").agg(F.sum("_mix_tokens").alias("n")).toPandas().set_index("_mix_lang")["n"]
    cells = mixing.cells_of(mixing.with_cells(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    goal = mixing.tempered(cells, "lang", mixing.ALPHA).toPandas().set_index("key")["share"]
    assert (got / got.sum()).sub(goal).abs().max() < 0.03


def test_licence_lines(spark):
    lines = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "the licence fee of a television set and the copyright of a song", "plain words only"]
    rows = [(i, f"Some ordinary opening words of document {i} about weather and rivers.\n" + lines[i % 4], i) for i in range(200)] + [(900, None, 0), (901, "", 0), (902, lines[0], 0), (902, lines[0], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family long")
    got = licenses.scan(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"] % 4 if r["doc_id"] < 900 else r["doc_id"], []).append((r["line_no"], r["family"], r["confirmed"]))
    assert set(by[0]) == {(1, "mit", True)} and set(by[1]) == {(1, "gpl-3.0", True)} and by[902] == [(0, "mit", True)] * 2
    assert all(not c for _, _, c in by[2]) and 3 not in by and len(by[2]) == 50


def brute_rules(rows, min_count, confidence, most):
    counts, blocked = {}, {}
    for tokens, block in rows:
        for n in range(1, most + 1):
            for c in itertools.combinations(sorted(tokens), n):
                counts[c] = counts.get(c, 0) + 1
                blocked[c] = blocked.get(c, 0) + block
    good = {c: blocked[c] / counts[c] for c in counts if blocked[c] >= min_count and blocked[c] / counts[c] >= confidence}
    return {c for c in good if not any(set(d) < set(c) and good[d] >= good[c] for d in good)}


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(400):
        tokens = sorted({f"t{int(x)}" for x in rng.integers(0, 9, 4)})
        rows.append((tokens, bool(rng.random() < (0.9 if {"t1", "t2"} <= set(tokens) else 0.8 if "t3" in tokens else 0.1))))
    labelled = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    rules = url_rules.learn_rules(labelled, min_count=8, min_support=0.0, min_confidence=0.65)
    assert {tuple(r["rule_tokens"]) for r in rules.collect()} == brute_rules(rows, 8, 0.65, 3)
    urls = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "row long, tokens array<string>")
    wanted = {i for i, (t, _) in enumerate(rows) if any(set(c) <= set(t) for c in brute_rules(rows, 8, 0.65, 3))}
    assert {r["row"] for r in url_rules.matched_rules(urls, rules).collect()} == wanted


def test_given_rules(spark):
    urls = ["http://a.Example.NET/en/1", "http://net/x", "http://anet/x", "http://net", "x", None, "https://m.example.com/de/2?x", "http://b.org/fr/#a", "ftp://q.org/en/", "http://example.net/en", "a://b://net/", ""]
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    parts = url_rules.split_urls(pages)
    none = url_rules.learn_rules(parts.select("tokens", F.lit(True).alias("block")).limit(0))
    got = {r["row"]: r for r in url_rules.judge(parts, url_rules.given_rules(spark, url_rules.RULES), none).collect()}
    by = {r["page_id"]: got[r["row"]] for r in parts.collect()}
    assert [(by[i]["rule"], by[i]["verdict"]) for i in range(len(urls))] == [
        ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("example.com/de/", "block"),
        ("org/fr/", "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), (None, "allow"),
    ]
    assert (by[0]["host"], by[0]["path"], by[5]["host"], by[10]["host"], by[10]["path"]) == ("a.example.net", "/en/1", "", "b:", "//net/")
