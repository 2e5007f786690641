"""Paper space of DXF drawings as relations: layouts in tab order, their viewports, and what of the model each one shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import dxf

#: Fixed values of the format: the tab of a layout without a record, the name of an active one, the bit of a viewport that is off, the id of the sheet's own.
NO_TAB, UNNAMED, OFF, SHEET_VIEW = 99, "Layout1", 0x20000, 1


def _number(code: int, other: float = 0.0) -> Column:
    return F.coalesce(dxf._value(code).try_cast("double"), F.lit(other))


def layers(files: DataFrame) -> DataFrame:
    """path, handle (in upper case), layer of the layer tables; of a handle that repeats, the last."""
    rows = dxf._every_entity(files).where("section = 'TABLES' and type = 'LAYER'").select("path", "entity_no", F.upper(dxf._value(5)).alias("handle"), dxf._value(2).alias("layer"))
    return rows.where("handle <> ''").groupBy("path", "handle").agg(F.max_by("layer", "entity_no").alias("layer"))


def _own_codes() -> Column:
    """The codes of a layout's own subclass, without groups in braces: a fold that carries the subclass and whether a group is open."""
    kept = "array<struct<code:int,value:string>>"
    start = F.struct(F.lit("").alias("sub"), F.lit(False).alias("grouped"), F.array().cast(kept).alias("kept"))

    def step(s, c):
        marks = c["code"] == 102
        grouped = F.when(marks, c["value"].startswith("{")).otherwise(s["grouped"])
        free = ~marks & ~grouped
        sub = F.when(free & (c["code"] == 100), c["value"]).otherwise(s["sub"])
        mine = free & (c["code"] != 100) & (sub == "AcDbLayout")
        return F.struct(sub.alias("sub"), grouped.alias("grouped"), F.when(mine, F.concat(s["kept"], F.array(c))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate("codes", start, step, lambda s: s["kept"])


def _last(code: int) -> Column:
    """A layout's value of a code: the last counts."""
    return F.try_element_at(F.filter("own", lambda p: p["code"] == code), F.lit(-1))["value"]


def layout_records(files: DataFrame) -> DataFrame:
    """path, record (in upper case), layout, tab, x0, y0, x1, y1 (null where the limits hold nothing): named layouts by the block record they stand for, the last of each."""
    rows = dxf._every_entity(files).where("section = 'OBJECTS' and type = 'LAYOUT'").withColumn("own", _own_codes())
    at = lambda code: F.coalesce(_last(code).try_cast("double"), F.lit(0.0))
    valid = (at(11) > at(10)) & (at(21) > at(20))
    facts = F.struct(_last(1).alias("layout"), F.coalesce(_last(71).try_cast("int"), F.lit(0)).alias("tab"), *(F.when(valid, at(c)).alias(n) for c, n in ((10, "x0"), (20, "y0"), (11, "x1"), (21, "y1"))))
    named = rows.select("path", "entity_no", F.upper(_last(330)).alias("record"), facts.alias("facts")).where("facts.layout <> '' and record <> ''")
    return named.groupBy("path", "record").agg(F.max_by("facts", "entity_no").alias("facts")).select("path", "record", "facts.*")


def layouts(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, layout_no, layout, tab, block (in upper case), active, n_entities, x0, y0, x1, y1 of drawings (path, content) and their entities.

    The active layout holds the entities in paper space; each other block of paper space with entities is one too, named
    after its block where no record names it. In order of tabs, those without a record last; on a tie the active one
    first, then as the blocks stand.
    """
    heads = dxf._every_entity(files).where("section = 'BLOCKS' and type = 'BLOCK'").select("path", "entity_no", dxf._value(2).alias("name"), F.upper(dxf._value(330)).alias("record"))
    paper = heads.where(F.upper("name").startswith("*PAPER_SPACE")).groupBy("path", F.upper("name").alias("block")).agg(F.max_by("name", "entity_no").alias("name"), F.max_by("record", "entity_no").alias("record"), F.min("entity_no").alias("at"))
    held = in_paper(found).groupBy("path", "block").agg(F.count("*").alias("n_entities"))
    active = F.col("block") == "*PAPER_SPACE"
    each = held.join(paper, ["path", "block"], "left").where(active | F.col("name").isNotNull()).join(layout_records(files), ["path", "record"], "left")
    name = F.coalesce("layout", F.when(active, UNNAMED).otherwise(F.regexp_replace("name", r"^\*", "")))
    order = Window.partitionBy("path").orderBy(F.coalesce("tab", F.lit(NO_TAB)), F.desc("active"), "at")
    return each.withColumn("layout", name).withColumn("active", active).withColumn("layout_no", F.row_number().over(order)).select("path", "layout_no", "layout", "tab", "block", "active", "n_entities", "x0", "y0", "x1", "y1")


def in_paper(found: DataFrame) -> DataFrame:
    """Entities in paper space with the block of their layout; the active one's stand among the entities."""
    own = F.when((F.col("section") == "ENTITIES") & (F.col("space") == "paper"), "*PAPER_SPACE").when((F.col("section") == "BLOCKS") & (F.upper("block") != "*PAPER_SPACE"), F.upper("block"))
    return found.withColumn("block", own).where(F.col("block").startswith("*PAPER_SPACE"))


def viewports(found: DataFrame) -> DataFrame:
    """path, block, entity_no, view, x0, y0, x1, y1, scale, plan, m, frozen (handles of layers): viewports that are on, have a size and are not the sheet's own.

    m takes a point of the model, seen from above, to the sheet: from the target, turned back by the twist, from the middle
    of the view, to scale. A view from elsewhere has plan false.
    """
    v = in_paper(found).where("type = 'VIEWPORT'")
    w, h, seen, turn = _number(40), _number(41), _number(45), F.radians(_number(51))
    on = (_number(68, 1.0) != 0) & (_number(90).cast("long").bitwiseAND(OFF) == 0)
    plan = (_number(16) == 0) & (_number(26) == 0) & (_number(36, 1.0) > 0)
    sized = v.where(on & (_number(69) != SHEET_VIEW) & (w > 0) & (h > 0) & (seen > 0))
    k, cos, sin, tx, ty = h / F.nullif(seen, F.lit(0.0)), F.cos(turn), F.sin(turn), _number(17), _number(27)
    m = F.struct(
        (k * cos).alias("a"), (-k * sin).alias("b"), (k * sin).alias("c"), (k * cos).alias("d"),
        (_number(10) - k * (cos * tx + sin * ty + _number(12))).alias("e"), (_number(20) - k * (cos * ty - sin * tx + _number(22))).alias("f"),
    )
    box = [(_number(c) + way * size / 2).alias(n) for n, c, way, size in (("x0", 10, -1, w), ("y0", 20, -1, h), ("x1", 10, 1, w), ("y1", 20, 1, h))]
    frozen = F.transform(F.filter("codes", lambda p: p["code"] == 331), lambda p: F.upper(p["value"]))
    return sized.select("path", "block", "entity_no", _number(69).cast("int").alias("view"), *box, (1 / k).alias("scale"), plan.alias("plan"), m.alias("m"), F.array_distinct(frozen).alias("frozen"))


def shown(drawn: DataFrame, views: DataFrame, named: DataFrame) -> DataFrame:
    """path, block, view_no (the viewport's entity), view, top, copy, entity_no, type, layer, points on the sheet: model entities (dxf.drawn) that a plan viewport shows.

    Layers that the viewport freezes are left out by an anti join (named: layers()); of the rest, what meets the viewport's
    frame by the box of its points is shown, not cut at the frame. Entities without points are not shown.
    """
    plan = views.where("plan").select("path", "block", F.col("entity_no").alias("view_no"), "view", "x0", "y0", "x1", "y1", "m", "frozen")
    cold = plan.select("path", "view_no", F.explode("frozen").alias("handle")).join(named, ["path", "handle"]).select("path", "view_no", "layer").distinct()
    met = drawn.where("space = 'model' and size(points) > 0").select("path", "top", "copy", "entity_no", "type", "layer", "points").join(plan.drop("frozen"), "path").join(cold, ["path", "view_no", "layer"], "left_anti")
    at = lambda p: F.struct((F.col("m.a") * p["x"] + F.col("m.c") * p["y"] + F.col("m.e")).alias("x"), (F.col("m.b") * p["x"] + F.col("m.d") * p["y"] + F.col("m.f")).alias("y"))
    moved = met.withColumn("points", F.transform("points", at))
    inside = (F.array_max("points.x") >= F.col("x0")) & (F.array_min("points.x") <= F.col("x1")) & (F.array_max("points.y") >= F.col("y0")) & (F.array_min("points.y") <= F.col("y1"))
    return moved.where(inside).select("path", "block", "view_no", "view", "top", "copy", "entity_no", "type", "layer", "points")
