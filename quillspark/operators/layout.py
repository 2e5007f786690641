"""Page layout from text runs: lines, cells, paragraphs and tables.

Runs (doc_id, page, x, y, width, size, text) become lines by gaps-and-islands windows, lines become cells and
paragraphs likewise. A table compares each line with the first of its run, which no window frame can say, so that
step is a fold over the lines of a page; a page is a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

PAGE = ("doc_id", "page")


def with_lines(runs: DataFrame) -> DataFrame:
    """runs with line_no: a new line where y moves by more than max(2, half the smaller size)."""
    w = Window.partitionBy(*PAGE).orderBy("y", "x", "text")
    jump = F.abs(F.col("y") - F.lag("y").over(w)) > F.greatest(F.lit(2.0), 0.5 * F.least("size", F.lag("size").over(w)))
    return runs.withColumn("_new", F.coalesce(jump.cast("int"), F.lit(0))).withColumn("line_no", F.sum("_new").over(w)).drop("_new")


def with_cells(lined: DataFrame) -> DataFrame:
    """Runs with cell_no and the space before them: wide gaps part cells, narrow ones are spaces."""
    line = Window.partitionBy(*PAGE, "line_no")
    w = line.orderBy("x", "y", "text")
    size = X.upper_median(F.collect_list("size").over(line))
    gap = F.col("x") - F.lag(F.col("x") + F.col("width")).over(w)
    sized = lined.withColumn("line_size", size).withColumn("_gap", gap).withColumn("_before", F.lag("text").over(w))
    wide = F.coalesce(F.col("_gap") > 1.4 * F.col("line_size"), F.lit(False))
    spaced = F.coalesce((F.col("_gap") > 0.18 * F.col("line_size")) & ~F.col("_before").rlike(r"(?U)\s$") & ~F.col("text").rlike(r"^(?U)\s"), F.lit(False))
    marked = sized.withColumn("_wide", wide.cast("int")).withColumn("_lead", F.when(wide, "").when(spaced, " ").otherwise(""))
    return marked.withColumn("cell_no", F.sum("_wide").over(w)).withColumn("place", F.row_number().over(w)).drop("_gap", "_before", "_wide")


def cells(runs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, cell_no, text, x0, x1, y, size of every cell with text."""
    parts = F.array_sort(F.collect_list(F.struct("place", F.concat("_lead", "text").alias("t"))))
    text = F.trim(F.array_join(F.transform(parts, lambda p: p["t"]), ""))
    out = with_cells(with_lines(runs)).groupBy(*PAGE, "line_no", "cell_no").agg(
        text.alias("text"), F.min("x").alias("x0"), F.max_by(F.col("x") + F.col("width"), "place").alias("x1"), F.max("line_size").alias("size"), F.min("y").alias("y")
    )
    return out.where(F.length("text") > 0)


def lines(runs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text (cells by tabs), x0, x1, y, size, columns (left ends of cells)."""
    rows = F.array_sort(F.collect_list(F.struct("cell_no", "text", "x0")))
    return cells(runs).groupBy(*PAGE, "line_no").agg(
        F.array_join(F.transform(rows, lambda r: r["text"]), "\t").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y").alias("y"), F.max("size").alias("size"), F.transform(rows, lambda r: r["x0"]).alias("columns"),
    )


def paragraphs(lined: DataFrame) -> DataFrame:
    """Lines to paragraphs: a new one after a gap of over 1.45 usual gaps, a short line, or a change of size."""
    page = Window.partitionBy(*PAGE)
    w = page.orderBy("y", "line_no")
    gap = F.col("y") - F.lag("y").over(w)
    base = lined.withColumn("_gap", gap)
    normal = X.upper_median(F.collect_list("_gap").over(page))
    body = X.upper_median(F.collect_list("size").over(page))
    right = F.max("x1").over(page)
    marked = base.withColumns({"_normal": normal, "_body": body, "_right": right, "_x1": F.lag("x1").over(w), "_size": F.lag("size").over(w)})
    new = (F.col("_gap") > 1.45 * F.col("_normal")) | (F.col("_x1") < F.col("_right") - 2.5 * F.col("size")) | (F.abs(F.col("size") - F.col("_size")) > 0.2 * F.col("_body"))
    numbered = marked.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("paragraph_no", F.sum("_new").over(w))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    heading = (F.count("*") == 1) & (F.max("size") > 1.25 * F.max("_body"))
    return numbered.groupBy(*PAGE, "paragraph_no").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"), heading.alias("heading"), F.min("line_no").alias("first_line"))


def tables(lined: DataFrame, reach: float = 24.0, least: int = 3) -> DataFrame:
    """doc_id, page, first_line, last_line, columns of runs of lines whose cells stand where those of the run's first line do.

    A fold over the lines of a page: the state holds the run's first line, its columns and the runs found so far.
    """
    one = F.struct(F.col("line_no").cast("long").alias("line_no"), "columns")
    pages = lined.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("_lines"))
    kind = "struct<start:bigint,last:bigint,n:int,columns:array<double>,found:array<struct<first_line:bigint,last_line:bigint,columns:array<double>>>>"
    empty = F.from_json(F.lit('{"n":0,"columns":[],"found":[]}'), kind)

    def state(start, last, n, columns, found):
        return F.struct(start.cast("long").alias("start"), last.cast("long").alias("last"), n.cast("int").alias("n"), columns.alias("columns"), found.alias("found")).cast(kind)

    def flushed(s):
        run = F.struct(s["start"].alias("first_line"), s["last"].alias("last_line"), s["columns"].alias("columns"))
        return F.when(s["start"].isNotNull() & (s["n"] >= least), F.concat(s["found"], F.array(run))).otherwise(s["found"])

    def step(s, x):
        near = F.forall(F.zip_with(s["columns"], x["columns"], lambda a, b: F.abs(a - b)), lambda d: F.coalesce(d < reach, F.lit(False)))
        fits = s["start"].isNotNull() & (F.size(s["columns"]) == F.size(x["columns"])) & near
        fresh = state(F.when(F.size(x["columns"]) >= 2, x["line_no"]), x["line_no"], F.lit(1), x["columns"], flushed(s))
        return F.when(fits, state(s["start"], x["line_no"], s["n"] + 1, s["columns"], s["found"])).otherwise(fresh)

    found = pages.select(*PAGE, F.explode(F.aggregate("_lines", empty, step, flushed)).alias("t"))
    return found.select(*PAGE, "t.first_line", "t.last_line", "t.columns")


def snapped(cell_rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Cells (.., x0, text) put into the nearest of their table's columns (doc_id, page, col_idx, x); those that meet are joined by a blank."""
    near = cell_rows.join(columns, list(PAGE)).withColumn("away", F.abs(F.col("x0") - F.col("x")))
    best = near.groupBy(*PAGE, "line_no", "cell_no", "text").agg(F.min_by("col_idx", F.struct("away", "col_idx")).alias("col_idx"))
    rows = F.array_sort(F.collect_list(F.struct("cell_no", "text")))
    return best.groupBy(*PAGE, "line_no", "col_idx").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


def svg_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs (doc_id, page, x, y, size, text) to lines: y rounded to 4, a blank after a gap of a quarter em."""
    banded = glyphs.withColumn("band", (X.js_round(F.col("y") / 4) * 4).cast("long"))
    w = Window.partitionBy(*PAGE, "band").orderBy("x", "text")
    width = F.when(F.col("text").rlike(X.WIDE), F.col("size")).otherwise(F.col("size") * 0.5)
    gap = F.col("x") - F.lag(F.col("x") + width).over(w)
    lead = F.when(gap > 0.25 * F.col("size"), " ").otherwise("")
    placed = banded.withColumn("t", F.concat(lead, F.col("text"))).withColumn("place", F.row_number().over(w))
    rows = F.array_sort(F.collect_list(F.struct("place", "t")))
    return placed.groupBy(*PAGE, "band").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "").alias("text"))
