import hashlib
import random
import zlib

import duckdb
import pytest

from quillspark.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node its siblings (side, node or None), by the plain rule."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at, strict=True):
            p.append((i & 1, nodes[i ^ 1] if i ^ 1 < len(nodes) else None))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def by_hand(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))]) for g in order}
    root, above = tree([made[g][0] for g in order])
    out = []
    for g, up in zip(order, above, strict=True):
        for r, path in zip(sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))), made[g][1], strict=True):
            steps, bad = path + up, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = leaf(r, 1 if bad else 0)
            for side, other in steps:
                node = h(node) if other is None else h(other, node) if side else h(node, other)
            out.append((r["doc_id"], leaf(r), made[g][0], root, h(*(o for _, o in steps if o)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 31, 32, 33, 100, 257])
@pytest.mark.parametrize("layer", [1, 2, 3, 4])
def test_fractal_paths(n, layer):
    nodes = [h(str(i)) for i in range(n)]
    root, paths = tree(nodes)
    leaves, height = [x.encode() for x in nodes], merkle.height_of(n, 30)
    assert merkle.subtree_root(leaves, height).decode() == root
    got = list(merkle.fractal_paths(leaves, height, layer))
    assert [[(side, node.decode() or None) for side, node in p] for p in got] == [[("-" if o is None else "l" if s else "r", o) for s, o in p] for p in paths]


def test_memory_of_a_traversal():
    leaves = [h(str(i)).encode() for i in range(4096)]
    top = merkle._Subtree(leaves, 8, 12, 0)
    while top.at < top.end:
        top.step()
        assert len(top.stack) <= 12
    assert len(top.nodes) == 30  # 16 + 8 + 4 + 2 nodes of the 8,190 below the root


@pytest.mark.parametrize("bits", [2, 3, 12])
def test_manifest_equals_the_plain_rule(spark, bits):
    r = random.Random(bits)
    rows = [{"doc_id": i, "source": r.choice(["a", None, "ü"]), "lang": r.choice(["en", "en", "en", "de", None, "ÿ", "z"]), "n_chars": r.choice([None, 5, 70]), "text": r.choice([None, "", "tëxt", "word " * 9])} for i in range(150)]
    rows += [{"doc_id": 9000, "source": None, "lang": "lone", "n_chars": 1, "text": "x"}, {"doc_id": None, "source": None, "lang": "en", "n_chars": None, "text": None}, rows[3], rows[3]]
    docs = spark.createDataFrame([(*x.values(), "clash", 1) for x in rows], "doc_id long, source string, lang string, n_chars long, text string, node string, pos int")
    got = merkle.manifest(docs, bits).collect()
    assert sorted(((x["doc_id"], x["leaf"], x["subroot"], x["root"], x["proof_sha256"], x["folded_root"], x["folded_root"] == x["root"]) for x in got), key=str) == by_hand(rows)
    for x in got:
        assert merkle.fold(x["presented"].encode(), x["steps"].encode()).decode() == x["folded_root"]


def test_one_row_and_none(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    one = merkle.manifest(spark.createDataFrame([(1, "s", None, 3, "abc")], schema)).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["root"] == one[0]["subroot"] and one[0]["steps"] == "" and one[0]["proof_sha256"] == h("")
    assert merkle.manifest(spark.createDataFrame([], schema)).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({merkle.SQL})").fetchall()
    got = [tuple(r) for r in merkle.op13_merkle_manifest(spark, sf_dir).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {r[-1] for r in got} == {True, False}
