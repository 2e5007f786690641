import random
import re

import numpy as np
import pytest

from quillspark.llm import common, exact_dedup, ngram_join
from quillspark.llm.components import connected_components


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def shingles(text, k):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute_classes(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n):
    """Texts that share passages and copies edited more and more."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[rng.choice(words) for _ in range(30)] for _ in range(4)]
    rows, base = [], []
    for d in range(n):
        if base and rng.random() < 0.7:
            text = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                text[rng.randrange(len(text))] = rng.choice(words).upper()
            if rng.random() < 0.3:
                text = text[: rng.randint(max(1, len(text) - 8), len(text))]
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 9, 40, 80]))]
            if rng.random() < 0.6:
                text += rng.choice(passages)
            if text:
                base.append(text)
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(text)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "  \n")]


@pytest.mark.parametrize("seed,k,num,den,rare", [(1, 4, 85, 100, 16), (2, 5, 80, 100, 4), (3, 4, 85, 100, 2), (4, 2, 70, 100, 3)])
def test_classes_equal_brute_force(spark, seed, k, num, den, rare):
    rows = corpus(seed, 160)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_classes(docs, k, num, den, rare_below=rare, small=3).collect()}
    assert got == brute_classes(rows, k, num, den)


@pytest.mark.parametrize("num,den", [(80, 100), (85, 100), (70, 100)])
def test_signatures_of_similar_sets_meet(num, den):
    rng = np.random.default_rng(4)
    for _ in range(3000):
        n = int(rng.integers(3, 60))
        universe = np.unique(rng.integers(0, 1 << 62, 160).astype(np.uint64))
        level = np.where(rng.random(len(universe)) < rng.random(), 0, rng.integers(1, 4, len(universe))).astype(np.uint8)
        x = rng.choice(len(universe), n, replace=False)
        y = x[rng.random(n) > 0.12]
        y = np.unique(np.concatenate((y, rng.choice(len(universe), int(rng.integers(0, 5))))))
        x = np.sort(x)
        both = len(np.intersect1d(x, y))
        if len(x) == len(y) == both or den * both < num * (len(x) + len(y) - both):
            continue
        a = ngram_join.signatures(universe[x], level[x], num, den)
        b = ngram_join.signatures(universe[y], level[y], num, den)
        assert np.intersect1d(a, b).size


def test_one_of_each_class_stays_with_all_columns(spark):
    rows = [(3, "a b c d e f g", "x", 1), (1, "A  b c d e f g", "y", 2), (2, "other words here now and then", None, 3), (None, "a b c d e f g", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n long")
    kept = ngram_join.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns
    assert sorted(r["n"] for r in kept.collect()) == [2, 3, 4]
    assert ngram_join.similar_classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_cuts_move_with_the_text():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    cuts, moved = exact_dedup.cut_points(text), exact_dedup.cut_points(b"some words more" + text)
    assert cuts[-1] == len(text) and all(0 < b - a <= exact_dedup.LONGEST for a, b in zip([0, *cuts], cuts, strict=False))
    assert len({c + 15 for c in cuts} & set(moved)) > 0.9 * len(cuts)
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"a") == [1]


def test_exact_duplicates_odd_rows(spark):
    rows = [(5, "a b", 1), (2, "ab", 2), (9, " a  b ", 3), (4, None, 4), (3, "", 5), (8, "\n", 6), (7, "x" * 50_000, 7), (6, "x" * 25_000 + " " + "x" * 25_000, 8), (1, "é", 9), (1, "é", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"]): r for r in got}
    assert by[5]["keep_id"] == by[2]["keep_id"] == by[9]["keep_id"] == 9 and by[9]["group_size"] == 3
    assert by[4]["keep_id"] == by[3]["keep_id"] == by[8]["keep_id"] == 8
    assert by[7]["keep_id"] == by[6]["keep_id"] == 6
    assert sorted(r["kept"] for r in got if r["doc_id"] == 1) == [False, True]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [1, 6, 8, 9]
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_colliding_fingerprints_get_variants(spark):
    rows = [(0, [(1, 3, b"x"), (2, 1, b"p")]), (1, [(1, 3, b"y"), (2, 1, b"p")]), (2, [(1, 3, b"x"), (2, 1, b"p")]), (3, [])]
    found = spark.createDataFrame(rows, "row long, chunks array<struct<fp:long,len:int,sha:binary>>")
    recipe = {r["row"]: r["recipe"] for r in exact_dedup.verified_recipes(found).collect()}
    assert recipe[0] == recipe[2] == ["1", "2"] and recipe[1] == ["1:2", "2"] and recipe[3] == []


def test_span_hashes_tell_spans_apart():
    data = np.frombuffer(b"abc abd abc ab cabc", np.uint8)
    starts, ends, at = common.word_spans(data, np.array([0, 12, 19]))
    words = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert words == [b"abc", b"abd", b"abc", b"ab", b"cabc"] and at.tolist() == [0, 3, 5]
    h = common.span_hashes(common.BYTE_CODES[data], starts, ends)
    assert h[0] == h[2] and len(set(h.tolist())) == 4
