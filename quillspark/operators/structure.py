"""Items, fields, arguments, previews, characters, categories and pictures of documents as DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X

# --- items -----------------------------------------------------------------------------------------------


def notable(items: DataFrame, most: int = 400, kinds: str = "text|image|group") -> DataFrame:
    """The first `most` design items of each file worth a mention: shallow, named, with text, or of a notable kind."""
    keep = (F.col("depth") <= 1) | (F.coalesce(F.col("name"), F.lit("")) != "") | (F.coalesce(F.col("text"), F.lit("")) != "") | F.col("kind").rlike(kinds)
    return items.where(keep).withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy("item_no"))).where(F.col("_n") <= most).drop("_n")


def kept_pictures(pictures: DataFrame) -> DataFrame:
    """Pictures (w, h, page_w, page_h) of a layout that are neither specks (a side under 12) nor whole pages (over 90 %)."""
    return pictures.where((F.col("w") >= 12) & (F.col("h") >= 12) & ~((F.col("w") > 0.9 * F.col("page_w")) & (F.col("h") > 0.9 * F.col("page_h"))))


# --- fields and arguments ---------------------------------------------------------------------------------


def set_fields(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """The outcome of changes (doc_id, name, new_value) on fields (doc_id, name, value): ok, or BAD_ARGUMENT with the names there are."""
    names = fields.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    met = changes.join(fields.select("doc_id", "name", F.col("value").alias("old_value")).withColumn("_there", F.lit(True)), ["doc_id", "name"], "left").join(names, "doc_id", "left")
    there = F.col("_there").isNotNull()
    return met.select(
        "doc_id", "name", "new_value", F.when(there, "ok").otherwise("BAD_ARGUMENT").alias("status"), "old_value",
        F.when(~there, F.concat(F.lit("fields: "), F.coalesce("names", F.lit("")))).alias("message"),
    )


#: Arguments that each operation needs; those of text and name changes are not asked for.
NEEDS = {
    "replace_text": ("find",), "set_cell": ("table", "row", "col", "text"), "insert_paragraph": ("paragraph", "text"), "delete_paragraph": ("paragraph",), "set_field": ("name", "text"),
    "append_row": ("table",), "hide": ("ids",), "show": ("ids",), "delete": ("ids",), "move": ("ids", "dx", "dy"), "set_fill": ("ids", "color"), "duplicate": ("ids",), "command": ("command",),
    "set_text": (), "rename": (),
}


def argument_issues(ops: DataFrame) -> DataFrame:
    """ops (op_no, op, args MAP) with `missing`, the arguments an operation lacks, and `code`: BAD_ARGUMENT where any is missing or the operation is unknown."""
    known = F.create_map(*(x for op, names in NEEDS.items() for x in (F.lit(op), F.array(*map(F.lit, names)).cast("array<string>"))))
    needs = F.try_element_at(known, F.col("op"))
    missing = F.filter(needs, lambda n: F.col("args")[n].isNull())
    return ops.withColumn("missing", missing).withColumn("code", F.when(needs.isNull() | (F.size(missing) > 0), "BAD_ARGUMENT").otherwise("ok"))


def unknown_columns(match: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of match (sample, column) whose column the data does not have, with BAD_ARGUMENT."""
    return match.where(~F.col("column").isin(columns)).withColumn("code", F.lit("BAD_ARGUMENT"))


def batch_result(rows: DataFrame, given: list[str]) -> DataFrame:
    """made, failed, unused of a batch (ok, used ARRAY): how many outputs were made, and the given keys that none used.

    Of the used keys only the given ones, each once, come together.
    """
    sums = rows.agg(F.count_if("ok").alias("made"), F.count_if(~F.col("ok")).alias("failed"))
    used = rows.select(F.explode("used").alias("key")).where(F.col("key").isin(given)).distinct().agg(F.collect_list("key").alias("_used"))
    return sums.join(used).select("made", "failed", F.array_sort(F.array_except(F.array(*map(F.lit, given)), "_used")).alias("unused"))


# --- previews and candidates ------------------------------------------------------------------------------


def preview(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first rows of each key and, in each, how many there are in all: a report's head, not a filter of data."""
    w = Window.partitionBy(key)
    return rows.withColumn("n_all", F.count("*").over(w)).withColumn("_n", F.row_number().over(w.orderBy(order))).where(F.col("_n") <= most).drop("_n")


def best_candidates(scores: DataFrame, key: str, most: int = 4) -> DataFrame:
    """key, candidates: the best `most` (symbol, score) of each key, ties by symbol."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("symbol"))))
    return scores.groupBy(key).agg(F.transform(F.slice(ranked, 1, most), lambda x: x["symbol"]).alias("candidates"))


def blended(ml: DataFrame, glyph: DataFrame, alpha: float, floor_rank: int = 51) -> DataFrame:
    """key, score of the union of two rankings (key, score): a key that one lacks has that one's score at floor_rank, or its last, there."""

    def floor_of(ranked):
        best = ranked.orderBy(F.desc("score")).limit(floor_rank)
        return F.broadcast(best.agg(F.min("score").alias("floor")))

    a, b = (r.select("key", F.col("score").alias(n)) for r, n in ((ml, "a"), (glyph, "b")))
    both = a.join(b, "key", "full").crossJoin(floor_of(ml).withColumnRenamed("floor", "_fa")).crossJoin(floor_of(glyph).withColumnRenamed("floor", "_fb"))
    return both.select("key", (alpha * F.coalesce("a", "_fa") + (1 - alpha) * F.coalesce("b", "_fb")).alias("score"))


# --- characters -------------------------------------------------------------------------------------------


def character_counts(docs: DataFrame, has: str) -> DataFrame:
    """doc_id, char, n of the characters that a font (a regular expression of what it has) lacks."""
    bare = F.regexp_replace("text", has, "")
    return docs.select("doc_id", F.explode(F.split(bare, "")).alias("char")).where("char <> ''").groupBy("doc_id", "char").agg(F.count("*").alias("n"))


def used_characters(docs: DataFrame) -> DataFrame:
    """doc_id, chars: the distinct characters of each text, in order."""
    return docs.select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))), "").alias("chars"))


def joined_clusters(runs: DataFrame, reach: float = 0.3) -> DataFrame:
    """Runs (doc_id, line_no, x, w, size, text) with cluster_no: neighbours of scripts that stack marks (Thai, Lao, Khmer, Myanmar, Indic) that touch are one."""
    stacked = F.col("text").rlike(r"[ऀ-෿฀-໿က-႟ក-៿]")
    w = Window.partitionBy("doc_id", "line_no").orderBy("x", "text")
    marked = runs.withColumn("_s", stacked)
    touches = (F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) < reach * F.col("size")) & F.col("_s") & F.lag("_s").over(w)
    return marked.withColumn("_new", (~F.coalesce(touches, F.lit(False))).cast("int")).withColumn("cluster_no", F.sum("_new").over(w) - 1).drop("_s", "_new")


# --- categories, headers, sheets, svg ---------------------------------------------------------------------


def element_category(triangles: DataFrame, order: list[str]) -> DataFrame:
    """element, category: that with most triangles (element, category, n), the first of `order` on a tie."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    sums = triangles.groupBy("element", "category").agg(F.sum("n").alias("n"))
    return sums.groupBy("element").agg(F.max_by("category", F.struct("n", -place)).alias("category"))


def category_counts(elements: DataFrame, categories: list[str]) -> DataFrame:
    """category, n for every category, also those without an element."""
    have = elements.groupBy("category").agg(F.count("*").alias("n"))
    every = elements.sparkSession.sql("select explode(array(" + ", ".join(f"'{c}'" for c in categories) + ")) as category")
    return every.join(have, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def filled_parts(parts: DataFrame, values: dict[str, str]) -> DataFrame:
    """Headers and footers (doc_id, part, text) with every mark filled, and how many of each part were."""
    marks = [r"\{\{\s*" + X._quoted(k) + r"\s*\}\}" for k in values]
    n = reduce(lambda a, b: a + b, (F.regexp_count("text", F.lit(m)) for m in marks), F.lit(0))
    text = reduce(lambda t, kv: F.regexp_replace(t, kv[0], kv[1].replace("\\", "\\\\").replace("$", "\\$")), zip(marks, values.values(), strict=True), F.col("text"))
    return parts.select("doc_id", "part", text.alias("text"), n.cast("long").alias("n_filled"))


def picked_sheet(sheets: DataFrame, wanted: str | int | None) -> DataFrame:
    """file, sheet, status: the sheet (file, sheet, place) of each file by name or place from 0, else the first; BAD_ARGUMENT with the names there are."""
    by_file = sheets.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "sheet"))).alias("s"))
    names = F.transform("s", lambda x: x["sheet"])
    if wanted is None:
        found = F.get(names, F.lit(0))
    elif isinstance(wanted, int):
        found = F.get(names, F.lit(wanted))
    else:
        found = F.when(F.array_contains(names, wanted), F.lit(wanted))
    return by_file.select("file", found.alias("sheet"), F.when(found.isNotNull(), "ok").otherwise(F.concat(F.lit("BAD_ARGUMENT: sheets are "), F.array_join(names, ", "))).alias("status"))


def layout_rows(blocks: DataFrame) -> DataFrame:
    """doc_id, page, row_no, values of layout blocks (doc_id, page, block_no, rows ARRAY<ARRAY>): one sheet a page, a blank row after each block, none at the end."""
    spaced = blocks.withColumn("_rows", F.concat("rows", F.array(F.array().cast("array<string>"))))
    each = spaced.select("doc_id", "page", "block_no", F.posexplode("_rows").alias("_at", "values"))
    w = Window.partitionBy("doc_id", "page")
    placed = each.withColumn("row_no", F.row_number().over(w.orderBy("block_no", "_at")) - 1).withColumn("_last", F.max("row_no").over(w))
    return placed.where("row_no < _last").select("doc_id", "page", "row_no", "values")


def tables_markdown(cells: DataFrame, key: str = "path") -> DataFrame:
    """key, table_no, markdown of tables (key, table_no, row_idx, col_idx, row_span, col_span, text).

    A table without merged cells is a pipe table with its first row as head, one cell alone a quote, any other HTML with its spans.
    """
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    pipe = F.replace(flat, F.lit("|"), F.lit("\\|"))
    span = lambda c, name: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    html = F.concat(F.lit("<td"), span("row_span", "rowspan"), span("col_span", "colspan"), F.lit(">"), X.xml_escaped(flat), F.lit("</td>"))
    one = F.array_sort(F.collect_list(F.struct("col_idx", pipe.alias("pipe"), html.alias("html"))))
    rows = cells.groupBy(key, "table_no", "row_idx").agg(one.alias("c"), F.max(F.greatest("row_span", "col_span")).alias("most"), F.first(flat).alias("alone"))
    both = rows.select(
        key, "table_no", "row_idx", "most", "alone", F.size("c").alias("n"),
        F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["pipe"]), " | "), F.lit(" |")).alias("line"), F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda x: x["html"]), ""), F.lit("</tr>")).alias("tr"),
    )
    table = both.groupBy(key, "table_no").agg(F.array_sort(F.collect_list(F.struct("row_idx", "line", "tr"))).alias("r"), F.max("most").alias("most"), F.sum("n").alias("n"), F.max("n").alias("width"), F.first("alone").alias("alone"))
    lines, trs = F.transform("r", lambda x: x["line"]), F.transform("r", lambda x: x["tr"])
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width").cast("int")), " | "), F.lit(" |"))
    plain = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.size(lines))), "\n")
    said = F.when(F.col("n") == 1, F.concat(F.lit("> "), F.col("alone"))).when(F.col("most") > 1, F.concat(F.lit("<table>"), F.array_join(trs, ""), F.lit("</table>"))).otherwise(plain)
    return table.select(key, "table_no", said.alias("markdown"))


def summary_line(cells: DataFrame, key: str = "path") -> DataFrame:
    """key, summary: how many tables, nested tables and merged cells a document has."""
    per = cells.groupBy(key).agg(F.count_distinct("table_no").alias("t"), F.count_distinct(F.when(F.col("depth") > 0, F.col("table_no"))).alias("n"), F.count_if(F.col("row_span") * F.col("col_span") > 1).alias("m"))
    return per.select(key, F.format_string("%d tables, %d nested, %d merged cells", "t", "n", "m").alias("summary"))


def svg_filled(svg: Column, pairs: list[tuple[str, str]]) -> Column:
    """An SVG with sample texts replaced: only what stands between tags, in its escaped form."""
    said = [(F.lit(a), F.lit(b)) for a, b in ((X_escape(f), X_escape(t)) for f, t in pairs)]
    parts = F.regexp_extract_all(svg, F.lit(r"<[^>]*>|[^<]+"), F.lit(0))
    new = F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<")), p).otherwise(reduce(lambda t, ab: F.replace(t, *ab), said, p)))
    return F.array_join(new, "")


def X_escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def affine(x: Column, y: Column, m: tuple[float, float, float, float, float, float]) -> Column:
    """struct(x, y) after the transform [a b c d e f]."""
    a, b, c, d, e, f = map(F.lit, m)
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))
