import random

import pytest

from quillspark.operators import boards, ranking, structure, trees


def plain(nodes):
    """parent and last of each node of one tree, by walking back and forth."""
    out = {}
    for i, (at, depth) in enumerate(nodes):
        parent = next((a for a, d in reversed(nodes[:i]) if d < depth), None)
        last = at
        for a, d in nodes[i + 1 :]:
            if d <= depth:
                break
            last = a
        out[at] = (parent, last)
    return out


@pytest.mark.parametrize("chunk", [4, 256])
def test_preorder_equals_the_plain_walk(spark, chunk):
    r = random.Random(chunk)
    made = {}
    for k in range(6):
        depth, nodes = 0, []
        for i in range(r.choice([1, 2, 30, 150])):
            depth = max(0, depth + r.choice([1, 1, 0, -1, -2, 3]))
            nodes.append((i * 3 + k, depth))
        made[k] = nodes
    made[10] = [(i, i) for i in range(1200)]  # a chain 1,200 deep
    made[11] = [(i, i if i < 500 else 1000 - i) for i in range(1000)]
    df = spark.createDataFrame([(k, a, d) for k, ns in made.items() for a, d in ns], "doc long, at long, depth long")
    got = {}
    for x in trees.preorder(df, "doc", chunk=chunk).collect():
        got.setdefault(x["doc"], {})[x["at"]] = (x["parent"], x["last"])
    assert got == {k: plain(ns) for k, ns in made.items()}


def test_ancestors(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(300)] + [(2, 0, 0), (2, 1, 1), (2, 2, 1), (2, 3, 2)], "doc long, at long, depth long")
    tree = trees.preorder(df, "doc")
    got = trees.ancestors(tree, spark.createDataFrame([(1, 299), (2, 3), (2, 0)], "doc long, at long"), "doc").collect()
    assert {(x["ancestor"], x["distance"]) for x in got if x["doc"] == 1} == {(i, 299 - i) for i in range(299)}
    assert {(x["at"], x["ancestor"], x["distance"]) for x in got if x["doc"] == 2} == {(3, 2, 1), (3, 0, 2)}


def test_layers_are_paired_one_after_the_other(spark):
    schema = "board long, layer_no long, function string, name string, file string"
    a = spark.createDataFrame([(1, 1, "k1", "n", "fa"), (1, 2, "k2", "m", "fb"), (2, 1, "x", "y", "z"), (3, 5, "k", "a", "b")], schema)
    b = spark.createDataFrame([(1, 1, "k2", "n", "fc"), (2, 1, "q", "q", "z"), (2, 2, "x", "w", "w"), (4, 1, "k", "a", "b")], schema)
    got = {(r["board"], r["a_no"], r["b_no"], r["by"]) for r in ranking.paired_layers(a, b, "board").collect()}
    # A1 comes first and takes B1 by its name, though A2 has B1's function.
    assert got == {(1, 1, 1, "name"), (1, 2, None, "only_a"), (2, 1, 2, "function"), (2, None, 1, "only_b"), (3, 5, None, "only_a"), (4, None, 1, "only_b")}


def test_drill_scales(spark):
    holes = [(f, x * k, y * k) for f, k in (("mm", 1.0), ("tenth", 25.4 / 10), ("inch", 1 / 25.4), ("far", 1000.0)) for x in range(10, 20) for y in range(10, 20)]
    boxes = [(f, 9.0, 9.0, 20.0, 20.0) for f in ("mm", "tenth", "inch", "far")]
    got = boards.drill_scale(spark.createDataFrame(holes, "file string, x double, y double"), spark.createDataFrame(boxes, "file string, x0 double, y0 double, x1 double, y1 double")).collect()
    # Nothing fits holes a thousand times too far away: they stay as they are.
    assert {r["file"]: (round(r["scale"], 6), round(r["share"], 6)) for r in got} == {"mm": (1.0, 1.0), "tenth": (round(10 / 25.4, 6), 1.0), "inch": (25.4, 1.0), "far": (1.0, 0.0)}


def test_needs_of_operations(spark):
    ops = [(0, "replace_text", {"find": "a"}), (1, "replace_text", {}), (2, "append_row", {"table": "0"}), (3, "move", {"ids": "1", "dx": "2"}), (4, "rename", {}), (5, "dance", {}), (6, "set_cell", {"table": "0", "col": "1"})]
    got = structure.argument_issues(spark.createDataFrame(ops, "op_no int, op string, args map<string,string>")).collect()
    assert {r["op_no"]: (r["code"], r["missing"]) for r in got} == {
        0: ("ok", []), 1: ("BAD_ARGUMENT", ["find"]), 2: ("ok", []), 3: ("BAD_ARGUMENT", ["dy"]), 4: ("ok", []), 5: ("BAD_ARGUMENT", None), 6: ("BAD_ARGUMENT", ["row", "text"]),
    }


def test_a_layer_without_a_partner_takes_nothing_from_those_after_it(spark):
    schema = "board long, layer_no long, function string, name string, file string"
    a = spark.createDataFrame([(1, 1, "none", "none", "none"), (1, 2, "k", "n", "f")], schema)
    b = spark.createDataFrame([(1, 7, "k", "x", "y"), (1, 8, "z", "z", "z")], schema)
    got = {(r["a_no"], r["b_no"], r["by"]) for r in ranking.paired_layers(a, b).collect()}
    assert got == {(1, None, "only_a"), (2, 7, "function"), (None, 8, "only_b")}
