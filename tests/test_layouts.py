import math
import random

from quillspark.sources import dxf
from quillspark.sources import layouts as L


def text(*pairs):
    return bytearray("".join(f"{c}\n{v}\n" for c, v in pairs).encode())


def section(name, *pairs):
    return [(0, "SECTION"), (2, name), *pairs, (0, "ENDSEC")]


def files(spark, **drawings):
    return spark.createDataFrame([(k, text(*v, (0, "EOF"))) for k, v in drawings.items()], "path string, content binary")


def block(name, record, *body):
    return [(0, "BLOCK"), (2, name), *([(330, record)] if record else []), *body, (0, "ENDBLK")]


POINT = [(0, "POINT"), (8, "0"), (10, 1), (20, 1)]


def record(name, tab, of, *more):
    return [(0, "LAYOUT"), (100, "AcDbPlotSettings"), (1, "not this"), (100, "AcDbLayout"), (1, name), (71, tab), (102, "{X"), (330, "FFFF"), (1, "nor this"), (102, "}"), (330, of), *more]


def test_layouts_in_tab_order(spark):
    blocks = section("BLOCKS", *block("*Model_Space", "1A", *POINT), *block("*Paper_Space", "1B"), *block("*paper_space7", "1c", *POINT, *POINT), *block("*Paper_Space8", "1D", *POINT), *block("*Paper_Space9", "1E"), *block("Plain", "1F", *POINT))
    paper = section("ENTITIES", *POINT, *POINT, (67, 1))
    objects = section("OBJECTS", *record("B", 2, "1b"), *record("C", 1, "1C", (10, 0), (20, 0), (11, 5), (21, 4)), *record("Model", 0, "1A"), *record("Old", 1, "1D"), *record("D", 2, "1D", (10, 3), (11, 3)))
    got = L.layouts(df := files(spark, all=blocks + paper + objects, none=blocks + section("ENTITIES", *POINT), bare=section("ENTITIES", *POINT, (67, 1)), empty=[]), dxf.entities(df))
    rows = {p: [(r["layout"], r["tab"], r["n_entities"], r["x1"]) for r in got.where(f"path = '{p}'").orderBy("layout_no").collect()] for p in ("all", "none", "bare", "empty")}
    assert rows["all"] == [("C", 1, 2, 5.0), ("B", 2, 1, None), ("D", 2, 1, None)]
    assert rows["none"] == [("paper_space7", None, 2, None), ("Paper_Space8", None, 1, None)]
    assert rows["bare"] == [("Layout1", None, 1, None)] and rows["empty"] == []


def view(number, *more, at=(10, 20), size=(6, 4), seen=8):
    return [(0, "VIEWPORT"), (67, 1), (69, number), (10, at[0]), (20, at[1]), (40, size[0]), (41, size[1]), (45, seen), *more]


def test_viewports_that_count(spark):
    bad = [view(1), view(3, (68, 0)), view(4, (90, 0x20000)), view(5, seen=0), view(6, size=(0, 4)), view(7, (10, "x"), size=("", 4))]
    kept = [view(2, (331, "a"), (331, "b"), (331, "A")), view(8, (16, 1), (36, 0)), view(9, (68, -1), (90, 1))]
    df = files(spark, f=section("ENTITIES", *(c for v in bad + kept for c in v)))
    got = {r["view"]: r for r in L.viewports(dxf.entities(df)).collect()}
    assert sorted(got) == [2, 8, 9]
    assert got[2]["frozen"] == ["A", "B"] and got[2]["scale"] == 2.0 and [got[2][c] for c in ("x0", "y0", "x1", "y1")] == [7.0, 18.0, 13.0, 22.0]
    assert [got[v]["plan"] for v in (2, 8, 9)] == [True, False, True]


def test_shown_equals_a_plain_walk(spark):
    r = random.Random(3)
    points = [(r.choice(["0", "hot", "cold", "ice"]), r.uniform(-20, 20), r.uniform(-20, 20)) for _ in range(200)]
    views = [(n, r.uniform(-5, 5), r.uniform(-5, 5), r.uniform(4, 20), r.uniform(4, 20), r.uniform(4, 20), r.choice([0, 30, 90, 200]), r.uniform(-5, 5), r.uniform(-5, 5), r.uniform(-5, 5), r.uniform(-5, 5), r.choice([[], ["c1"], ["C1", "c2"], ["gone"]])) for n in range(2, 12)]
    tables = section("TABLES", *(c for n, h in (("cold", "C1"), ("ice", "c2"), ("hot", "C3")) for c in ((0, "LAYER"), (5, h), (2, n))))
    model = [c for layer, x, y in points for c in ((0, "POINT"), (8, layer), (10, x), (20, y))]
    ports = [c for n, cx, cy, w, h, seen, turn, vx, vy, tx, ty, frozen in views for c in view(n, (12, vx), (22, vy), (51, turn), (17, tx), (27, ty), *((331, f) for f in frozen), at=(cx, cy), size=(w, h), seen=seen)]
    df = files(spark, f=tables + section("ENTITIES", *model, *ports))
    found = dxf.entities(df)
    got = sorted((s["view"], s["layer"], round(s["points"][0]["x"], 5), round(s["points"][0]["y"], 5)) for s in L.shown(dxf.drawn(found, dxf.block_bases(df)), L.viewports(found), L.layers(df)).collect())
    want, handles = [], {"C1": "cold", "C2": "ice", "C3": "hot"}
    for n, cx, cy, w, h, seen, turn, vx, vy, tx, ty, frozen in views:
        for layer, x, y in points:
            if layer in {handles.get(f.upper()) for f in frozen}:
                continue
            dx, dy, t = x - tx, y - ty, -math.radians(turn)
            px, py = cx + h / seen * (dx * math.cos(t) - dy * math.sin(t) - vx), cy + h / seen * (dx * math.sin(t) + dy * math.cos(t) - vy)
            if abs(px - cx) <= w / 2 and abs(py - cy) <= h / 2:
                want.append((n, layer, round(px, 5), round(py, 5)))
    assert len(want) > 50 and got == sorted(want)
