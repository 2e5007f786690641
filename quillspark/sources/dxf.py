"""DXF text as relations: a row for each entity with its codes, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tables

#: Millimetres of a unit by the number of $INSUNITS (fixed values of the public format).
UNITS = {1: 25.4, 2: 304.8, 4: 1.0, 5: 10.0, 6: 1000.0, 14: 100.0}


def header_value(text: Column, name: str, code: int) -> Column:
    """The value of a header variable, null where it is missing."""
    found = F.regexp_extract(text, rf"\${name}\s*\n\s*{code}\s*\n\s*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def drawing_text(content: Column) -> Column:
    """A drawing's text; bytes that are no UTF-8 become U+FFFD, as one bad drawing ends no job."""
    return F.make_valid_utf8(content.cast("string"))


def encoding_issues(files: DataFrame) -> DataFrame:
    """path, code, message of files (path, content) whose bytes are no UTF-8: their texts are read with replacements."""
    bad = files.where(~F.is_valid_utf8(F.col("content").cast("string")))
    return bad.select("path", F.lit("ENCODING").alias("code"), F.concat(F.lit("not UTF-8; the file says "), F.coalesce(header_value(drawing_text(F.col("content")), "DWGCODEPAGE", 3), F.lit("nothing"))).alias("message"))


def units(files: DataFrame) -> DataFrame:
    """path, unit_mm: from $INSUNITS; without a unit, inches where $MEASUREMENT says imperial, else millimetres."""
    text = drawing_text(F.col("content"))
    number = header_value(text, "INSUNITS", 70).cast("int")
    mm = F.element_at(F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv)), number)
    imperial = header_value(text, "MEASUREMENT", 70) == "0"
    return files.select("path", F.coalesce(mm, F.when(imperial, 25.4), F.lit(1.0)).alias("unit_mm"))


def _value(code: int) -> Column:
    """The first value of a code of an entity."""
    return F.get(F.filter("codes", lambda p: p["code"] == code), F.lit(0))["value"]


def _every_entity(files: DataFrame) -> DataFrame:
    """path, entity_no, section, block, type, codes of all entities and marks of DXF files (path, content). A file's entities are one window; a file is a bounded group."""
    lines = F.split(F.regexp_replace(drawing_text(F.col("content")), r"\r\n?", "\n"), "\n", -1)
    pair = lambda i: F.struct(F.trim(F.get("_lines", 2 * i)).try_cast("int").alias("code"), F.trim(F.get("_lines", 2 * i + 1)).alias("value"))
    last = F.floor(F.size("_lines") / 2).cast("int") - 1
    # Codes and values take turns, so a value of 0 is no code 0.
    each = files.select("path", lines.alias("_lines")).where(F.size("_lines") > 1).select("path", F.posexplode(F.transform(F.sequence(F.lit(0), last), pair)).alias("at", "p"))
    along = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = each.select("path", "at", "p.code", "p.value").withColumn("entity_no", F.sum((F.col("code") == 0).cast("int")).over(along)).where("entity_no > 0 and code is not null")
    codes = F.array_sort(F.collect_list(F.when(F.col("code") != 0, F.struct("at", "code", "value"))))
    rows = numbered.groupBy("path", "entity_no").agg(F.max(F.when(F.col("code") == 0, F.col("value"))).alias("type"), F.transform(codes, lambda c: F.struct(c["code"].alias("code"), c["value"].alias("value"))).alias("codes"))
    w = Window.partitionBy("path").orderBy("entity_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("type") == "SECTION", _value(2)).when(F.col("type") == "ENDSEC", "")
    block = F.when(F.col("type") == "BLOCK", _value(2)).when(F.col("type") == "ENDBLK", "")
    return rows.withColumn("section", F.last(mark, True).over(w)).withColumn("block", F.last(block, True).over(w))


def entities(files: DataFrame) -> DataFrame:
    """path, entity_no, section, block, space (model or paper), type, layer, handle, codes ARRAY<STRUCT<code, value>> of the entities of DXF files (path, content).

    Every entity of every type comes, drawn or not.
    """
    kept = _every_entity(files).where(F.col("section").isin("ENTITIES", "BLOCKS") & ~F.col("type").isin("SECTION", "ENDSEC", "BLOCK", "ENDBLK", "EOF"))
    return kept.select(
        "path", F.col("entity_no").cast("long").alias("entity_no"), "section", F.when(F.col("block") != "", F.col("block")).alias("block"),
        F.when(_value(67) == "1", "paper").otherwise("model").alias("space"), "type", F.coalesce(_value(8), F.lit("0")).alias("layer"), _value(5).alias("handle"), "codes",
    )


def block_bases(files: DataFrame) -> DataFrame:
    """path, block (in upper case), bx, by: the base points of the blocks of DXF files."""
    number = lambda code: F.coalesce(_value(code).try_cast("double"), F.lit(0.0))
    rows = _every_entity(files).where("section = 'BLOCKS' and type = 'BLOCK'").select("path", F.upper(_value(2)).alias("block"), "entity_no", number(10).alias("bx"), number(20).alias("by"))
    return rows.groupBy("path", "block").agg(F.max_by("bx", "entity_no").alias("bx"), F.max_by("by", "entity_no").alias("by"))


# --- block references -------------------------------------------------------------------------------------

#: Nesting beyond which references are cut, and copies of one array insert (fixed values).
DEEPEST, COPIES = 40, 100_000


def _times(m: Column, n: Column) -> Column:
    """The matrix m after n; a matrix is (a b c d e f), x goes to a x + c y + e and y to b x + d y + f."""
    return F.struct(
        (m["a"] * n["a"] + m["c"] * n["b"]).alias("a"), (m["b"] * n["a"] + m["d"] * n["b"]).alias("b"), (m["a"] * n["c"] + m["c"] * n["d"]).alias("c"), (m["b"] * n["c"] + m["d"] * n["d"]).alias("d"),
        (m["a"] * n["e"] + m["c"] * n["f"] + m["e"]).alias("e"), (m["b"] * n["e"] + m["d"] * n["f"] + m["f"]).alias("f"),
    )


def inserts(found: DataFrame, bases: DataFrame) -> DataFrame:
    """path, entity_no, within (the block that holds it, null in a space), space, block, layer, copy, m: each copy of each reference to a block that there is."""
    number = lambda code, other=0.0: F.coalesce(_value(code).try_cast("double"), F.lit(other))
    count = lambda code: F.greatest(F.lit(1), F.coalesce(_value(code).try_cast("double").cast("int"), F.lit(1)))
    scale = lambda code: F.coalesce(F.nullif(number(code, 1.0), F.lit(0.0)), F.lit(1.0))
    refs = found.where("type = 'INSERT'").select(
        "path", "entity_no", F.upper("block").alias("within"), "space", "layer", F.upper(_value(2)).alias("block"), number(10).alias("x"), number(20).alias("y"), scale(41).alias("sx"), scale(42).alias("sy"),
        F.radians(number(50)).alias("turn"), count(70).alias("cols"), count(71).alias("rows"), number(44).alias("dx"), number(45).alias("dy"),
    )
    every = refs.join(bases, ["path", "block"]).withColumn("copy", F.explode(F.expr(f"sequence(0, least(cols * rows, {COPIES}) - 1)")))
    px, py = (F.col("copy") % F.col("cols")) * F.col("dx"), F.floor(F.col("copy") / F.col("cols")) * F.col("dy")
    cos, sin = F.cos("turn"), F.sin("turn")
    a, b, c, d = cos * F.col("sx"), sin * F.col("sx"), -sin * F.col("sy"), cos * F.col("sy")
    e = F.col("x") + cos * px - sin * py - a * F.col("bx") - c * F.col("by")
    f = F.col("y") + sin * px + cos * py - b * F.col("bx") - d * F.col("by")
    m = F.struct(*(v.alias(k) for k, v in zip("abcdef", (a, b, c, d, e, f), strict=True)))
    return every.select("path", "entity_no", "within", "space", "block", "layer", "copy", m.alias("m"))


def _chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ways (path, within, block, m, layer, names) that go along one of first and then one of second, through no block twice."""
    then = second.select("path", F.col("within").alias("block"), F.col("block").alias("_to"), F.col("m").alias("_m"), F.col("layer").alias("_layer"), F.col("names").alias("_names"))
    met = first.join(then, ["path", "block"]).where(~F.arrays_overlap("names", "_names") & ~F.array_contains("_names", F.col("within")) & (F.size("names") + F.size("_names") <= DEEPEST))
    layer = F.when(F.col("_layer") == "0", F.col("layer")).otherwise(F.col("_layer"))
    return met.select("path", "within", F.col("_to").alias("block"), _times(F.col("m"), F.col("_m")).alias("m"), layer.alias("layer"), F.concat("names", "_names").alias("names"))


def placements(found: DataFrame, bases: DataFrame) -> DataFrame:
    """path, entity_no, copy, space, block, m, layer, depth: every block that a reference in a space draws, itself or through others, with the composed matrix.

    References between blocks are closed by doubling: ways of up to 1, 2, 4.. steps are joined with the longest ones, so
    nesting of any depth takes log2 rounds; a way through a block twice is no way, which ends circles. A thing on layer 0
    takes the layer of what holds it.
    """
    refs = tables.written(inserts(found, bases), "inserts")
    steps = refs.where("within is not null and within <> block").select("path", "within", "block", "m", "layer", F.array("block").alias("names"))
    upto = exact = tables.written(steps, "ways")
    while not exact.isEmpty():
        upto = tables.written(upto.unionByName(_chained(exact, upto)), "ways")
        exact = tables.written(_chained(exact, exact), "ways")
    top = refs.where("within is null").select("path", "entity_no", "copy", "space", "block", "m", "layer", F.lit(1).alias("depth"))
    way = upto.select("path", F.col("within").alias("block"), F.col("block").alias("_to"), F.col("m").alias("_m"), F.col("layer").alias("_layer"), (F.size("names") + 1).alias("_depth"))
    deeper = top.join(way, ["path", "block"]).select(
        "path", "entity_no", "copy", "space", F.col("_to").alias("block"), _times(F.col("m"), F.col("_m")).alias("m"), F.when(F.col("_layer") == "0", F.col("layer")).otherwise(F.col("_layer")).alias("layer"), F.col("_depth").alias("depth")
    )
    return top.unionByName(deeper)


def points(codes: Column | str = "codes") -> Column:
    """The points of an entity: its x (codes 10 to 18) and y (20 to 28) in order."""
    numbers = lambda low: F.transform(F.filter(codes, lambda p: p["code"].between(low, low + 8)), lambda p: p["value"].try_cast("double"))
    return F.filter(F.arrays_zip(numbers(10).alias("x"), numbers(20).alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def drawn(found: DataFrame, bases: DataFrame) -> DataFrame:
    """path, top (the entity of a space that draws it), copy, entity_no, space, type, layer, depth, points: all entities as drawn, references resolved."""
    plain = found.where("type <> 'INSERT'").select("path", "entity_no", F.upper("block").alias("block"), "space", "type", "layer", points().alias("points"))
    own = plain.where("block is null").select("path", F.col("entity_no").alias("top"), F.lit(0).alias("copy"), "entity_no", "space", "type", "layer", F.lit(0).alias("depth"), "points")
    held = placements(found, bases).select("path", F.col("entity_no").alias("top"), "copy", "space", "block", "m", F.col("layer").alias("_layer"), "depth")
    met = held.join(plain.where("block is not null").drop("space"), ["path", "block"])
    moved = F.transform("points", lambda p: F.struct((F.col("m.a") * p["x"] + F.col("m.c") * p["y"] + F.col("m.e")).alias("x"), (F.col("m.b") * p["x"] + F.col("m.d") * p["y"] + F.col("m.f")).alias("y")))
    inside = met.select("path", "top", "copy", "entity_no", "space", "type", F.when(F.col("layer") == "0", F.col("_layer")).otherwise(F.col("layer")).alias("layer"), "depth", moved.alias("points"))
    return own.unionByName(inside)


def extents(found: DataFrame) -> DataFrame:
    """path, type, n, x0, y0, x1, y1: how many entities of each type there are and the box of their points (codes 10 to 18 and 20 to 28)."""
    numbers = lambda low: F.transform(F.filter("codes", lambda p: p["code"].between(low, low + 8)), lambda p: p["value"].try_cast("double"))
    boxed = found.select("path", "type", F.array_min(numbers(10)).alias("x0"), F.array_max(numbers(10)).alias("x1"), F.array_min(numbers(20)).alias("y0"), F.array_max(numbers(20)).alias("y1"))
    return boxed.groupBy("path", "type").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
