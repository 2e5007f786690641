import math
import random

from quillspark.sources import dxf


def text(pairs):
    return bytearray("".join(f"{c}\n{v}\n" for c, v in pairs).encode())


def drawing(r, depth):
    """Blocks that refer to others at random, circles too, and what a plain walk draws of them."""
    names = [f"K{i}" for i in range(6)] + [f"D{i}" for i in range(depth)]
    blocks = {}
    for i, n in enumerate(names):
        base = (r.randint(-3, 3), r.randint(-3, 3))
        things = [("POINT", r.choice(["0", "own"]), (r.randint(0, 9), r.randint(0, 9))) for _ in range(2)]
        targets = [names[i + 1]] if n[0] == "D" and i + 1 < len(names) else [] if n[0] == "D" else r.sample(names[:6], r.randint(0, 2)) + (["gone"] if i == 0 else [])
        refs = [("INSERT", r.choice(["0", "L1"]), t.lower(), (r.randint(-5, 5), r.randint(-5, 5)), r.choice([1, 2, -1]), r.choice([0, 90, 30]), r.choice([(1, 1), (2, 2)])) for t in targets]
        blocks[n] = (base, things + refs)
    top = [("INSERT", "T", n, (1, 2), 1, 45, (1, 1)) for n in ("K0", "K1", "D0")] + [("POINT", "T", (5, 5))]
    return blocks, top


def codes(thing):
    if thing[0] == "POINT":
        return [(0, "POINT"), (8, thing[1]), (10, thing[2][0]), (20, thing[2][1])]
    _, layer, name, at, scale, turn, (cols, rows) = thing
    return [(0, "INSERT"), (8, layer), (2, name), (10, at[0]), (20, at[1]), (41, scale), (42, 2), (50, turn), (70, cols), (71, rows), (44, 3), (45, 4)]


def walk(blocks, thing, m, layer, stack, out):
    own = layer if thing[1] == "0" else thing[1]
    apply = lambda m, p: (m[0] * p[0] + m[2] * p[1] + m[4], m[1] * p[0] + m[3] * p[1] + m[5])
    if thing[0] == "POINT":
        out.append((own, len(stack), *(round(v, 4) + 0.0 for v in apply(m, thing[2]))))
        return
    _, _, name, at, sx, turn, (cols, rows) = thing
    name = name.upper()
    if name not in blocks or name in stack:
        return
    base, things = blocks[name]
    cos, sin = math.cos(math.radians(turn)), math.sin(math.radians(turn))
    for k in range(cols * rows):
        px, py = k % cols * 3, k // cols * 4
        n = [cos * sx, sin * sx, -sin * 2, cos * 2, at[0] + cos * px - sin * py, at[1] + sin * px + cos * py]
        n[4], n[5] = n[4] - n[0] * base[0] - n[2] * base[1], n[5] - n[1] * base[0] - n[3] * base[1]
        both = [m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], *apply(m, (n[4], n[5]))]
        for t in things:
            walk(blocks, t, both, own, [*stack, name], out)


def test_drawn_equals_a_plain_walk(spark):
    files, want = [], {}
    for seed in range(5):
        blocks, top = drawing(random.Random(seed), 9)
        if seed == 4:  # in the long chain every block holds one copy
            blocks = {n: (b, [t if t[0] == "POINT" else (*t[:6], (1, 1)) for t in ts]) for n, (b, ts) in blocks.items()}
        body = [(0, "SECTION"), (2, "BLOCKS")]
        for n, (base, things) in blocks.items():
            body += [(0, "BLOCK"), (2, n), (10, base[0]), (20, base[1]), *(c for t in things for c in codes(t)), (0, "ENDBLK")]
        body += [(0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"), *(c for t in top for c in codes(t)), (0, "ENDSEC"), (0, "EOF")]
        out = []
        for t in top:
            walk(blocks, t, [1, 0, 0, 1, 0, 0], "0", [], out)
        if len(out) < 30_000:
            files.append((str(seed), text(body)))
            want[str(seed)] = sorted(out)
    df = spark.createDataFrame(files, "path string, content binary")
    got = {}
    for r in dxf.drawn(dxf.entities(df), dxf.block_bases(df)).select("path", "layer", "depth", "points").collect():
        got.setdefault(r["path"], []).append((r["layer"], r["depth"], round(r["points"][0]["x"], 4) + 0.0, round(r["points"][0]["y"], 4) + 0.0))
    assert len(files) >= 2 and got.keys() == want.keys()
    for k in want:
        assert len(got[k]) == len(want[k])
        # As multisets of places to a thousandth; what lies on a rounding edge may fall to either side.
        near = lambda rows: sorted((layer, depth, round(x, 3), round(y, 3)) for layer, depth, x, y in rows)
        odd = [(a, b) for a, b in zip(near(got[k]), near(want[k]), strict=True) if a[:2] != b[:2] or abs(a[2] - b[2]) > 0.002 or abs(a[3] - b[3]) > 0.002]
        assert not odd
