"""Trees, fields, boards, buildings, layout, scalar functions and streams over tables derived from the supplied ones, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import boards as B
from ..operators import documents as D
from ..operators import geometry as G
from ..operators import layout as L
from ..operators import ranking as R
from ..operators import structure as T
from ..operators import trees
from ..sources import files as S
from ..sources import markup as M
from ..sources import tables
from ..streaming import ingest

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


# --- trees, fields, arguments -----------------------------------------------------------------------------


_TREE = "WITH n AS (SELECT o_custkey AS k, o_orderkey AS at, o_orderkey * 7 % 23 AS depth FROM orders)"


@query(f"""{_TREE}, p AS (SELECT a.k, a.at, a.depth, max(b.at) AS parent FROM n a LEFT JOIN n b ON a.k = b.k AND b.at < a.at AND b.depth < a.depth GROUP BY 1, 2, 3),
e AS (SELECT p.k, p.at, p.parent, min(b.at) AS next FROM p LEFT JOIN n b ON p.k = b.k AND b.at > p.at AND b.depth <= p.depth GROUP BY 1, 2, 3)
SELECT e.k, e.at, e.parent, max(b.at) AS last FROM e JOIN n b ON e.k = b.k AND (e.next IS NULL OR b.at < e.next) GROUP BY 1, 2, 3""")
def win_preorder_parents(spark, d):
    """Parents and subtrees of nodes of any depth."""
    nodes = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") * 7 % 23).alias("depth"))
    return trees.preorder(nodes, "k").select("k", "at", "parent", "last")


@query(f"""WITH RECURSIVE n AS (SELECT o_custkey AS k, o_orderkey AS place, o_orderkey * 7 % 23 AS depth FROM orders),
p AS (SELECT a.k, a.place, max(b.place) AS parent FROM n a LEFT JOIN n b ON a.k = b.k AND b.place < a.place AND b.depth < a.depth GROUP BY 1, 2),
r AS (SELECT k, place, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM p WHERE parent IS NOT NULL UNION ALL SELECT r.k, r.place, p.parent, distance + 1 FROM r JOIN p ON p.k = r.k AND p.place = r.ancestor WHERE p.parent IS NOT NULL)
SELECT k, place AS "at", ancestor, distance FROM r""")
def win_ancestors(spark, d):
    nodes = _t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") * 7 % 23).alias("depth"))
    return trees.ancestors(trees.preorder(nodes, "k"), nodes, "k")


@query("""WITH i AS (SELECT o_custkey, o_orderkey AS n FROM orders WHERE o_orderkey % 4 <= 1 OR o_orderstatus = 'F' OR o_orderkey % 5 = 0)
SELECT o_custkey AS file, n AS item_no FROM i QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n) <= 400""")
def flt_notable_items(spark, d):
    o = _t(spark, d, "orders")
    name = F.when(F.col("o_orderstatus") == "F", "named")
    items = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("item_no"), (F.col("o_orderkey") % 4).alias("depth"), name.alias("name"), F.lit("").alias("text"), F.when(F.col("o_orderkey") % 5 == 0, "image").otherwise("path").alias("kind"))
    return T.notable(items).select("file", "item_no")


@query("SELECT p_partkey FROM part WHERE p_size >= 12 AND NOT (p_size > 45 AND p_size * 2 > 63)")
def flt_kept_pictures(spark, d):
    w = F.col("p_size").cast("double")
    return T.kept_pictures(_t(spark, d, "part").select("p_partkey", w.alias("w"), (w * 2).alias("h"), F.lit(50.0).alias("page_w"), F.lit(70.0).alias("page_h"))).select("p_partkey")


@query("""SELECT o_orderkey AS doc_id, ['name', 'segment', 'colour'][o_orderkey % 3 + 1] AS name, CASE WHEN o_orderkey % 3 = 2 THEN 'BAD_ARGUMENT' ELSE 'ok' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderstatus END AS old_value, CASE WHEN o_orderkey % 3 = 2 THEN 'fields: name, segment' END AS message FROM orders""")
def edt_set_field(spark, d):
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "doc_id")
    fields = o.select("doc_id", F.expr("stack(2, 'name', o_orderpriority, 'segment', o_orderstatus) as (name, value)"))
    changes = o.select("doc_id", _pick(["name", "segment", "colour"], F.col("doc_id")).alias("name"), F.lit("new").alias("new_value"))
    return T.set_fields(fields, changes).select("doc_id", "name", "status", "old_value", "message")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 6 AS op, o_orderkey % 3 AS given FROM orders)
SELECT k AS op_no, CASE WHEN op = 5 OR (op IN (0, 2, 3) AND given = 2) OR (op IN (1, 3) AND given > 0) THEN 'BAD_ARGUMENT' ELSE 'ok' END AS code,
  CASE op WHEN 0 THEN CASE given WHEN 2 THEN 'find' ELSE '' END WHEN 1 THEN CASE given WHEN 0 THEN '' WHEN 1 THEN 'text' ELSE 'paragraph text' END WHEN 2 THEN CASE given WHEN 2 THEN 'table' ELSE '' END
    WHEN 3 THEN CASE given WHEN 0 THEN '' WHEN 1 THEN 'ids dx dy' ELSE 'ids dx dy' END WHEN 4 THEN '' END AS missing FROM o""")
def edt_argument_needs(spark, d):
    """replace_text does not ask for its new text, append_row not for cells, rename for nothing; what is unknown is refused."""
    full = F.create_map(*map(F.lit, ("find", "a", "paragraph", "1", "table", "0", "replace", "b", "text", "c", "cells", "d", "ids", "1", "dx", "2", "dy", "3")))
    some = F.create_map(*map(F.lit, ("find", "a", "paragraph", "1", "table", "0")))
    key = F.col("o_orderkey")
    args = F.when(key % 3 == 0, full).when(key % 3 == 1, some).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    ops = _t(spark, d, "orders").select(key.alias("op_no"), _pick(["replace_text", "insert_paragraph", "append_row", "move", "rename", "dance"], key).alias("op"), args.alias("args"))
    return T.argument_issues(ops).select("op_no", "code", F.array_join("missing", " ").alias("missing"))


@query("SELECT c_custkey, c_mktsegment AS \"column\", 'BAD_ARGUMENT' AS code FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def jn_unknown_columns(spark, d):
    match = _t(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("column"))
    return T.unknown_columns(match, ["BUILDING", "MACHINERY"]).select("c_custkey", "column", "code")


@query("SELECT CAST(count(*) FILTER (o_orderkey % 9 > 0) AS BIGINT) AS made, CAST(count(*) FILTER (o_orderkey % 9 = 0) AS BIGINT) AS failed, 'phone' AS unused FROM orders")
def agg_batch_result(spark, d):
    used = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("name"))).otherwise(F.array(F.lit("title"), F.lit("name")))
    rows = _t(spark, d, "orders").select((F.col("o_orderkey") % 9 > 0).alias("ok"), used.alias("used"))
    return T.batch_result(rows, ["name", "phone", "title"]).select("made", "failed", F.array_join("unused", " ").alias("unused"))


@query("""WITH b AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS block_no, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, block_no, count(*) OVER (PARTITION BY doc_id) AS n_all FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY block_no) <= 60""")
def srt_preview_paragraphs(spark, d):
    """A report of each document's first 60 paragraphs: the cap is the feature."""
    return T.preview(D.blocks(_t(spark, d, "documents")), "doc_id", "block_no", 60).select("doc_id", "block_no", "n_all")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_partkey) AS n FROM s)
SELECT l_orderkey, string_agg(l_partkey, ' ' ORDER BY n) AS candidates FROM r WHERE n <= 4 GROUP BY 1""")
def srt_best_candidates(spark, d):
    scores = _t(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("symbol")).agg(F.max("l_extendedprice").alias("score"))
    return T.best_candidates(scores, "l_orderkey").select("l_orderkey", F.array_join(F.transform("candidates", lambda c: c.cast("string")), " ").alias("candidates"))


@query("""WITH a AS (SELECT p_partkey AS key, CAST(p_size AS DOUBLE) AS s FROM part WHERE p_partkey % 3 > 0), b AS (SELECT p_partkey AS key, p_retailprice AS s FROM part WHERE p_partkey % 3 < 2),
fa AS (SELECT min(s) AS f FROM (SELECT s FROM a ORDER BY s DESC LIMIT 51)), fb AS (SELECT min(s) AS f FROM (SELECT s FROM b ORDER BY s DESC LIMIT 51))
SELECT coalesce(a.key, b.key) AS key, round(0.6 * coalesce(a.s, (SELECT f FROM fa)) + 0.4 * coalesce(b.s, (SELECT f FROM fb)), 4) AS score FROM a FULL JOIN b ON a.key = b.key""")
def jn_blended_scores(spark, d):
    p = _t(spark, d, "part").withColumnRenamed("p_partkey", "key")
    ml = p.where("key % 3 > 0").select("key", F.col("p_size").cast("double").alias("score"))
    glyph = p.where("key % 3 < 2").select("key", F.col("p_retailprice").alias("score"))
    return T.blended(ml, glyph, 0.6).select("key", F.round("score", 4).alias("score"))


# --- characters, categories, headers, sheets, svg ---------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[ -~\\n]', '', 'g'), '')) AS char FROM documents) SELECT doc_id, char, count(*) AS n FROM c WHERE char <> '' GROUP BY ALL""")
def agg_missing_characters(spark, d):
    return T.character_counts(_t(spark, d, "documents"), r"[ -~\n]")


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ''), lambda c: c <> ''))), '') AS chars FROM documents")
def agg_used_characters(spark, d):
    return T.used_characters(_t(spark, d, "documents"))


@query("""WITH s AS (SELECT l_suppkey, l_returnflag AS c, CAST(sum(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT *, CASE c WHEN 'N' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS place FROM s)
SELECT l_suppkey AS element, arg_max(c, (n, -place)) AS category FROM o GROUP BY 1""")
def agg_element_category(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("element"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").cast("long").alias("n"))
    return T.element_category(rows, ["N", "A", "R"])


@query("SELECT c.category, CAST(count(o_orderkey) AS BIGINT) AS n FROM (VALUES ('F'), ('O'), ('P'), ('none')) c(category) LEFT JOIN orders ON o_orderstatus = category GROUP BY 1")
def agg_category_counts(spark, d):
    return T.category_counts(_t(spark, d, "orders").select(F.col("o_orderstatus").alias("category")), ["F", "O", "P", "none"])


@query("SELECT c_custkey AS doc_id, 'header' AS part, 'To ' || 'ACME $1' || ', ' || c_name || ' {{other}}' AS text, CAST(1 AS BIGINT) AS n_filled FROM customer UNION ALL SELECT c_custkey, 'footer', 'ACME $1/7', CAST(2 AS BIGINT) FROM customer")
def tpl_fill_headers(spark, d):
    c = _t(spark, d, "customer").withColumnRenamed("c_custkey", "doc_id")
    head = F.concat(F.lit("To {{ name }}, "), F.col("c_name"), F.lit(" {{other}}"))
    parts = c.select("doc_id", F.lit("header").alias("part"), head.alias("text")).union(c.select("doc_id", F.lit("footer"), F.lit("{{name}}/{{n}}")))
    return T.filled_parts(parts, {"name": "ACME $1", "n": "7"})


@query("""SELECT CAST(n_regionkey AS BIGINT) AS file, CASE WHEN bool_or(n_name = 'CHINA') THEN 'CHINA' END AS sheet, CASE WHEN bool_or(n_name = 'CHINA') THEN 'ok' ELSE 'BAD_ARGUMENT: sheets are ' || string_agg(n_name, ', ' ORDER BY n_nationkey) END AS status FROM nation GROUP BY 1""")
def snk_picked_sheet(spark, d):
    sheets = _t(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("file"), F.col("n_name").alias("sheet"), F.col("n_nationkey").alias("place"))
    return T.picked_sheet(sheets, "CHINA")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS b, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM lineitem)
SELECT doc_id, 2 * k AS row_no, CAST(p AS VARCHAR) AS line FROM r UNION ALL SELECT doc_id, 2 * k + 1, '' FROM r WHERE k < (SELECT max(k) FROM r x WHERE x.doc_id = r.doc_id)""")
def snk_layout_rows(spark, d):
    from pyspark.sql.window import Window

    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    blocks = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), at.alias("block_no"), F.array(F.array(F.col("l_partkey").cast("string"))).alias("rows"))
    return T.layout_rows(blocks).select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.array_join("values", "|").alias("line"))


@query("""SELECT c_custkey, '<svg id="Name"><text>' || c_name || ' A&amp;B</text><g>Name tag</g></svg>' AS svg FROM customer""")
def tpl_fill_svg(spark, d):
    """The sample stands in an attribute, which stays, and in a text, which is replaced."""
    svg = F.concat(F.lit('<svg id="Name"><text>'), F.col("c_name"), F.lit(" X&lt;Y</text><g>Name tag</g></svg>"))
    return _t(spark, d, "customer").select("c_custkey", T.svg_filled(svg, [("X<Y", "A&B"), ("id=", "no")]).alias("svg"))


@query("SELECT p_partkey, p_size * 2.0 + 3 AS x, p_size * -1.0 + 1 AS y FROM part")
def scl_affine(spark, d):
    p = T.affine(F.col("p_size").cast("double"), F.lit(1.0), (2.0, -1.0, 0.0, 1.0, 3.0, 0.0))
    return _t(spark, d, "part").select("p_partkey", p["x"].alias("x"), p["y"].alias("y"))


@query("""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations), p AS (SELECT conv_id AS doc_id, count(*) AS pages, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM t GROUP BY 1)
SELECT doc_id, 'error' AS severity, 'PAGE_COUNT' AS code, pages || ' pages, expected 4' AS message FROM p WHERE pages <> 4
UNION ALL SELECT doc_id, 'warning', 'TRACKED_CHANGES', 'tracked changes are not settled' FROM p WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'warning', 'COMMENTS', 'comments are left' FROM p WHERE doc_id % 5 = 0
UNION ALL SELECT doc_id, 'warning', 'EMPTY_FIELDS', 'fields without a value: name, date' FROM p WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'warning', 'MISSING_GLYPHS', 'characters the fonts lack: ' || substr('xyz', 1, CAST(doc_id % 4 AS INT)) FROM p WHERE doc_id % 4 > 0
UNION ALL SELECT doc_id, 'info', 'PAGES_WITHOUT_TEXT', 'pages without text: 2, 5' FROM p WHERE doc_id % 6 = 1 UNION ALL SELECT doc_id, 'info', 'NO_TEXT_LAYER', 'no text' FROM p WHERE length(regexp_replace(text, '\\s', '', 'g')) = 0""")
def chk_all_codes(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    docs = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("pages"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))
    id_ = F.col("doc_id")
    empty = F.when(id_ % 3 == 0, F.array(F.lit("name"), F.lit("date"))).otherwise(F.array().cast("array<string>"))
    bare = F.when(id_ % 6 == 1, F.array(F.lit(2), F.lit(5))).otherwise(F.array().cast("array<int>"))
    return D.issues(docs, pages=F.col("pages"), expect_pages=4, tracked=id_ % 7 == 0, comments=id_ % 5 == 0, empty_fields=empty, missing_glyphs=F.substring(F.lit("xyz"), F.lit(1), (id_ % 4).cast("int")), bare_pages=bare)


# --- boards and buildings ---------------------------------------------------------------------------------

_FUNCTIONS = ["Copper,L1,Top", "Soldermask,Bot", None, "Profile,NP", "Legend,Top", None]
_NAMES = ["a.gbr", "b.gbr", "C.GBL", "d.gbr", "e.gbr", "f.bin"]
_CLASSES = "['copper_top', 'mask_bottom', 'copper_bottom', 'outline', 'legend_top', 'other']"


@query(f"SELECT p_partkey, {_CLASSES}[p_partkey % 6 + 1] AS class FROM part")
def scl_layer_class(spark, d):
    return _t(spark, d, "part").select("p_partkey", B.layer_class(_pick(_FUNCTIONS, F.col("p_partkey")), _pick(_NAMES, F.col("p_partkey"))).alias("class"))


@query("SELECT 'p/F' || p_partkey || '.gbr' AS file, CASE WHEN p_partkey % 3 = 0 THEN 'Profile,NP' WHEN p_partkey % 2 = 0 THEN 'Copper,L2,Bot' END AS function, CASE WHEN p_partkey % 3 = 0 THEN 'outline' WHEN p_partkey % 2 = 0 THEN 'copper_bottom' ELSE 'other' END AS class FROM part")
def jn_job_functions(spark, d):
    p = _t(spark, d, "part")
    layers = p.select(F.concat(F.lit("p/F"), F.col("p_partkey"), F.lit(".gbr")).alias("file"), F.when(F.col("p_partkey") % 3 == 0, "Profile,NP").alias("function"))
    job = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("X\\f"), F.col("p_partkey"), F.lit(".GBR")).alias("job_file"), F.lit("Copper,L2,Bot").alias("job_function"))
    return B.with_functions(layers, job)


@query(f"""WITH l AS (SELECT p_brand AS board, CAST(p_partkey AS VARCHAR) AS file, {_CLASSES}[p_partkey % 6 + 1] AS class, [4, 7, 6, 10, 1, 13][p_partkey % 6 + 1] AS place FROM part)
SELECT board, file, CAST(row_number() OVER (PARTITION BY board ORDER BY place, file) AS INT) AS stack_no FROM l""")
def srt_stack_order(spark, d):
    layers = _t(spark, d, "part").select(F.col("p_brand").alias("board"), F.col("p_partkey").cast("string").alias("file"), B.layer_class(_pick(_FUNCTIONS, F.col("p_partkey")), _pick(_NAMES, F.col("p_partkey"))).alias("class"))
    return B.stack_order(layers).select("board", "file", "stack_no")


@query("""WITH h AS (SELECT o_custkey AS file, (50.0 + o_orderkey % 50) * CASE o_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 100.0 WHEN 2 THEN 2.54 ELSE 5000.0 END AS x FROM orders),
s AS (SELECT i, CAST(s AS DOUBLE) AS s FROM (VALUES (0, 1.0), (1, 10.0), (2, 0.1), (3, 100.0), (4, 0.01), (5, 1 / 25.4), (6, 10 / 25.4), (7, 0.1 / 25.4), (8, 25.4), (9, 2.54), (10, 0.254)) v(i, s)),
t AS (SELECT file, i, s, avg(CASE WHEN x * s BETWEEN 49.9 AND 100.1 THEN 1.0 ELSE 0.0 END) AS share FROM h, s GROUP BY 1, 2, 3),
b AS (SELECT file, arg_max(struct_pack(s := s, share := share, score := share - abs(log10(s)) * 1e-3), (share - abs(log10(s)) * 1e-3, -i)) AS b, max(CASE i WHEN 0 THEN share END) AS own FROM t GROUP BY 1)
SELECT file, CASE WHEN b.score > 0.5 THEN b.s ELSE 1.0 END AS scale, CASE WHEN b.score > 0.5 THEN b.share ELSE own END AS share FROM b""")
def jn_drill_scale(spark, d):
    """Files in millimetres, hundredths, tenths of an inch, and one that fits no scale."""
    o = _t(spark, d, "orders")
    unit = _pick([1.0, 100.0, 2.54, 5000.0], F.col("o_custkey"))
    x = (50.0 + F.col("o_orderkey") % 50) * unit
    holes = o.select(F.col("o_custkey").alias("file"), x.alias("x"), x.alias("y"))
    boxes = o.select(F.col("o_custkey").alias("file")).distinct().select("file", F.lit(49.9).alias("x0"), F.lit(49.9).alias("y0"), F.lit(100.1).alias("x1"), F.lit(100.1).alias("y1"))
    return B.drill_scale(holes, boxes)


@query("""WITH c AS (SELECT o_custkey AS board, o_orderstatus AS layer, o_orderkey % 40 AS cx, o_orderkey % 3 AS cy, bool_or(o_orderkey % 5 < 4) AS a, bool_or(o_orderkey % 5 > 0) AS b FROM orders GROUP BY 1, 2, 3, 4)
SELECT board, layer, CAST(count(*) FILTER (a AND NOT b) AS BIGINT) AS only_a, CAST(count(*) FILTER (b AND NOT a) AS BIGINT) AS only_b, CAST(count(*) FILTER (a AND b) AS BIGINT) AS both FROM c GROUP BY 1, 2""")
def cmp_boards(spark, d):
    x, y = (F.col("o_orderkey") % 40).cast("double"), (F.col("o_orderkey") % 3).cast("double")
    items = _t(spark, d, "orders").select(F.col("o_custkey").alias("board"), F.col("o_orderstatus").alias("layer"), "o_orderkey", (x + 0.2).alias("x0"), (y + 0.2).alias("y0"), (x + 0.8).alias("x1"), (y + 0.8).alias("y1"))
    return B.compared(items.where("o_orderkey % 5 < 4"), items.where("o_orderkey % 5 > 0"), 1.0)


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'read as IFC4, the file says IFC2X2' END AS warning FROM part")
def chk_ifc_schema(spark, d):
    return _t(spark, d, "part").select("p_partkey", B.schema_warning(_pick(["IFC4X3", "ifc2x3", "IFC2X2"], F.col("p_partkey"))).alias("warning"))


# --- layout -----------------------------------------------------------------------------------------------


def _runs(spark, d):
    """Two cells a line: the line number's row, the second cell far to the right; a run close by joins the first cell."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("long").alias("qty"))
    y = F.col("l_linenumber") * 20.0
    at = lambda x, w, dy, text: F.struct(F.lit(x).alias("x"), (y + dy).alias("y"), F.lit(w).alias("width"), text.alias("text"))
    runs = F.array(at(10.0, 30.0, 0.0, F.col("part").cast("string")), at(43.0, 10.0, 0.5, F.lit("pc")), at(200.0, 20.0, 0.3, F.col("qty").cast("string")))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(10.0).alias("size"), F.explode(runs).alias("r")).select("doc_id", "page", "size", "r.*")


_LAYOUT = "c AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_partkey) AS part, CAST(min(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS line_no, count(*) OVER (PARTITION BY doc_id) AS m FROM c)"


@query(f"WITH {_LAYOUT} SELECT doc_id, line_no, part || ' pc' || chr(9) || qty AS text, 10.0 AS x0, 220.0 AS x1 FROM k")
def win_layout_lines(spark, d):
    return L.lines(_runs(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text", "x0", "x1")


@query(f"WITH {_LAYOUT} SELECT doc_id, line_no, k.v AS cell_no, CASE k.v WHEN 0 THEN part || ' pc' ELSE qty || '' END AS text FROM k AS r, (VALUES (0), (1)) k(v)".replace("FROM k AS r", "FROM k AS r"))
def win_layout_cells(spark, d):
    return L.cells(_runs(spark, d)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("cell_no").cast("long").alias("cell_no"), "text")


@query(f"WITH {_LAYOUT} SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS first_line, m - 1 AS last_line, '10.0 200.0' AS columns FROM k WHERE m >= 3")
def win_layout_tables(spark, d):
    out = L.tables(L.lines(_runs(spark, d)))
    return out.select("doc_id", "first_line", "last_line", F.array_join(F.transform("columns", lambda c: c.cast("string")), " ").alias("columns"))


@query(f"WITH {_LAYOUT} SELECT doc_id, line_no, v AS col_idx, CASE v WHEN 0 THEN part || ' pc' ELSE qty || '' END AS text FROM k, (VALUES (0), (1)) w(v)")
def win_layout_snapped(spark, d):
    runs = _runs(spark, d)
    columns = runs.select("doc_id", "page").distinct().select("doc_id", "page", F.expr("stack(2, 0, 12.0d, 1, 190.0d) as (col_idx, x)"))
    return L.snapped(L.cells(runs), columns).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "col_idx", "text")


@query(f"""WITH {_LAYOUT}, g AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM k), d AS (SELECT *, list_sort(list((n - b) * 20.0) FILTER (b IS NOT NULL) OVER (PARTITION BY doc_id))  AS gaps FROM g),
p AS (SELECT *, sum(CASE WHEN b IS NOT NULL AND (n - b) * 20.0 > 1.45 * gaps[len(gaps) // 2 + 1] THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS no FROM d)
SELECT doc_id, CAST(no AS BIGINT) AS paragraph_no, md5(string_agg(part || ' pc' || chr(9) || qty, ' ' ORDER BY n)) AS code FROM p GROUP BY 1, 2""")
def win_layout_paragraphs(spark, d):
    out = L.paragraphs(L.lines(_runs(spark, d)))
    return out.select("doc_id", F.col("paragraph_no").cast("long").alias("paragraph_no"), F.md5(F.col("text").cast("binary")).alias("code"))


@query(f"WITH {_LAYOUT} SELECT doc_id, CAST(floor(n * 20.0 / 4 + 0.5) * 4 AS BIGINT) AS band, part || ' ' || qty AS text FROM k")
def win_svg_lines(spark, d):
    runs = _runs(spark, d).where("text <> 'pc'")
    return L.svg_lines(runs.select("doc_id", "page", "x", F.round("y", 0).alias("y"), "size", "text")).select("doc_id", "band", "text")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS line_no, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2)
SELECT doc_id, line_no, v AS run, CASE WHEN line_no % 2 = 0 AND v = 1 THEN 0 ELSE v END AS cluster_no FROM r, (VALUES (0), (1)) w(v)""")
def win_joined_clusters(spark, d):
    """Two runs that touch: Thai ones join, Latin ones do not."""
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_no")).distinct()
    text = F.when(F.col("line_no") % 2 == 0, "ภา").otherwise("ab")
    runs = lines.select("doc_id", "line_no", text.alias("text"), F.lit(10.0).alias("w"), F.lit(10.0).alias("size"), F.posexplode(F.array(F.lit(0.0), F.lit(10.5))).alias("run", "x"))
    return T.joined_clusters(runs).select("doc_id", "line_no", "run", F.col("cluster_no").cast("int").alias("cluster_no"))


@query("SELECT p_partkey AS point_id, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 1 ELSE 3 END AS run_no FROM part")
def flt_run_under_point(spark, d):
    """A small run inside a large one, and one apart: inside wins by least area, else the nearest within reach."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), _pick([5.0, 1.0, 29.0], F.col("p_size")).alias("px"), F.lit(5.0).alias("py"))
    runs = p.select("doc_id", "page", F.expr("stack(3, 1, 0d, 0d, 10d, 10d, 2, 4d, 4d, 2d, 2d, 3, 30d, 4d, 5d, 2d) as (run_no, x, y, w, h)"))
    return G.run_under_point(runs, p.drop("doc_id", "page").withColumn("doc_id", F.col("point_id")).withColumn("page", F.lit(1)), 3.0)


@query("SELECT CAST(n_nationkey AS BIGINT) AS file, CAST(v AS INT) AS frame_no, CASE v WHEN 1 THEN 5.0 ELSE 0.0 END AS y0, CASE v WHEN 1 THEN 50 ELSE 30 END AS n_items FROM nation, (VALUES (1), (2)) w(v)")
def flt_frames(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("file"), F.lit(0).alias("sheet"))
    items = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i")).select("file", "sheet", (F.col("i") % 10).cast("double").alias("x0"), F.floor(F.col("i") / 10).cast("double").alias("y0"))
    items = items.withColumn("x1", F.col("x0") + 0.5).withColumn("y1", F.col("y0") + 0.5)
    rects = n.select("*", F.expr("stack(4, 0d, 0d, 6d, 4.5d, 0d, 5d, 14d, 15d, 1d, 1d, 5d, 4d, 0d, 0d, 50d, 1d) as (x0, y0, x1, y1)"))
    return G.frames(rects, items).select("file", "frame_no", "y0", F.col("n_items").cast("int").alias("n_items"))


@query("""SELECT p_partkey AS file, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -4 ' || p_size || ' 4"><line x1="0" y1="0" x2="' || p_size || '" y2="-4"/><text x="1.5" y="-2">a&amp;' || p_size || '</text></svg>' AS svg FROM part""")
def snk_sheet_svg(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.lit(0).alias("sheet"), F.col("p_size"))
    line = p.select("file", "sheet", F.lit(0).alias("item_no"), F.lit("line").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), F.lit(4.0).alias("y1"), F.lit(None).cast("string").alias("text"))
    text = p.select("file", "sheet", F.lit(1), F.lit("text"), F.lit(1.5), F.lit(2.0), F.least(F.lit(1.5), F.col("p_size") / 1.0), F.lit(2.0), F.concat(F.lit("a&"), F.col("p_size").cast("string")))
    return G.sheet_svg(line.union(text)).select("file", "svg")


@query("SELECT p_partkey, p_size * 3.0 AS area FROM part")
def agg_polygon_area(spark, d):
    w = F.col("p_size").cast("double")
    return _t(spark, d, "part").select("p_partkey", G.polygon_area(F.array(F.lit(0.0), F.lit(0.0), w, F.lit(0.0), w, F.lit(3.0), F.lit(0.0), F.lit(3.0))).alias("area"))


@query("SELECT doc_id, v AS k, round(10 + 60 * (1 + v * 3.0) / 6 - 2.5, 3) AS x0, round(10 + 60 * (3 + v * 3.0) / 6 + 2.5, 3) AS x1 FROM documents, (VALUES (0), (1)) w(v)")
def red_boxes(spark, d):
    from pyspark.sql.window import Window

    runs = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.lit(10.0).alias("x"), F.lit(100.0).alias("baseline"), F.lit(60.0).alias("w"), F.lit(10.0).alias("size"), F.lit("abcabc").alias("text"))
    boxes = D.redaction_boxes(runs, spark.sql("select 'bc' as phrase"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("x0")) - 1
    return boxes.select("doc_id", k.alias("k"), F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query("SELECT p_brand AS face, round(avg(CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END) , 6) AS score FROM (SELECT DISTINCT p_brand, p_partkey % 2 AS p_partkey FROM part) GROUP BY 1 HAVING count(*) = 2")
def agg_face_scores(spark, d):
    """Each brand is a face with a glyph for an even and one for an odd key: the first is what was seen, the second shares no pixel with it."""
    bits = F.when(F.col("k") == 0, F.array_repeat(F.lit(3), 32)).otherwise(F.array_repeat(F.lit(1 << 20), 32))
    faces = _t(spark, d, "part").select(F.col("p_brand").alias("face"), (F.col("p_partkey") % 2).alias("k")).distinct()
    faces = faces.select("face", F.col("k").cast("string").alias("char"), F.transform(bits, lambda b: b.cast("long")).alias("bits"))
    seen = spark.sql("select '0' as char, array_repeat(3L, 32) as seen union all select '1', array_repeat(3L, 32)")
    return R.face_scores(seen, faces, 0.9).select("face", F.round("score", 6).alias("score"))


@query("SELECT p_partkey, CASE WHEN p_size >= 45 AND p_partkey % 2 = 0 THEN 'high' WHEN p_size >= 35 THEN 'mid' ELSE 'low' END AS confidence FROM part")
def scl_confidence(spark, d):
    score = F.when(F.col("p_size") >= 45, 0.9).when(F.col("p_size") >= 35, 0.75).otherwise(0.5)
    return _t(spark, d, "part").select("p_partkey", R.confidence(score, F.when(F.col("p_partkey") % 2 == 0, 0.03).otherwise(0.01)).alias("confidence"))


@query("SELECT p_partkey, p_size < 20 OR p_size >= 30 AND p_size < 40 AS inside FROM part")
def agg_inside_polygon(spark, d):
    """A U of two posts of 20 and 10 wide (open between 20 and 30 above a bar): a point at height 5 is in a post or between them."""
    u = F.array(*map(F.lit, (0.0, 0.0, 40.0, 0.0, 40.0, 10.0, 30.0, 10.0, 30.0, 2.0, 20.0, 2.0, 20.0, 10.0, 0.0, 10.0)))
    return _t(spark, d, "part").select("p_partkey", G.inside_polygon(u, F.col("p_size").cast("double"), F.lit(5.0)).alias("inside"))


@query("""WITH i AS (SELECT event_id AS item_no, CAST(user_id * 7 % 100 AS DOUBLE) AS x0, CAST(event_id % 100 AS DOUBLE) AS y0, CAST(user_id * 7 % 100 + event_id % 7 AS DOUBLE) AS x1, CAST(event_id % 100 + event_id % 5 AS DOUBLE) AS y1 FROM events),
m AS (SELECT item_no, 0 AS k, x0 AS x, y0 AS y FROM i UNION ALL SELECT item_no, 1, (x0 + x1) / 2, (y0 + y1) / 2 FROM i UNION ALL SELECT item_no, 2, x1, y1 FROM i),
p AS (SELECT c_custkey AS point_id, CAST(c_custkey % 97 AS DOUBLE) AS px, CAST(c_custkey * 5 % 97 AS DOUBLE) AS py FROM customer), w AS (SELECT point_id, item_no, k, sqrt((px - x) ** 2 + (py - y) ** 2) AS a FROM p, m)
SELECT point_id, arg_min(item_no, (round(a, 9), item_no, k)) AS item_no, ['start', 'middle', 'end'][arg_min(k, (round(a, 9), item_no, k)) + 1] AS what, round(min(a), 5) AS distance FROM w WHERE a <= 2 GROUP BY 1""")
def flt_snap_points(spark, d):
    from .table_queries import _items

    points = _t(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.lit("f").alias("file"), F.lit(1).alias("sheet"), (F.col("c_custkey") % 97).cast("double").alias("px"), (F.col("c_custkey") * 5 % 97).cast("double").alias("py"))
    return G.snap_points(_items(spark, d), points, 2.0).select("point_id", "item_no", "what", F.round("distance", 5).alias("distance"))


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS r FROM lineitem GROUP BY 1, 2), m AS (SELECT doc_id, r, r IN (1, 2) AND bool_or(r = 1) OVER (PARTITION BY doc_id) AS merged FROM c),
x AS (SELECT doc_id, max(r) AS last, bool_or(r = 1) AS has1, list(r) AS rows FROM m GROUP BY 1), f AS (SELECT doc_id, min(r) AS plain FROM m WHERE r > 0 AND NOT merged GROUP BY 1)
SELECT x.doc_id, CASE WHEN greatest(last, CASE WHEN has1 THEN 2 ELSE 0 END) IN (1, 2) AND has1 THEN 'RULE' ELSE 'ok' END AS status, CASE WHEN greatest(last, CASE WHEN has1 THEN 2 ELSE 0 END) IN (1, 2) AND has1 THEN plain END AS plain_row FROM x LEFT JOIN f USING (doc_id)""")
def edt_append_row_outcome(spark, d):
    from .text_queries import _cells

    return D.append_row_outcome(_cells(spark, d)).select("doc_id", "status", "plain_row")


# --- scalar functions -------------------------------------------------------------------------------------


@query("SELECT doc_id, true AS same, length(text) - length(replace(text, 'e', '')) = 0 AS same_without_e FROM documents")
def scl_same_ignoring_space(spark, d):
    text = F.col("text")
    return _t(spark, d, "documents").select("doc_id", X.same_ignoring_space(text, F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("\t \n")))).alias("same"), X.same_ignoring_space(text, F.replace(text, F.lit("e"), F.lit(""))).alias("same_without_e"))


@query("SELECT p_partkey, p_brand || ' - ~.' AS plain, p_partkey % 2 = 0 AS private, '①⓿' || p_size AS circled FROM part")
def scl_special_characters(spark, d):
    odd = F.concat("p_brand", F.lit(" " + chr(0x2212) + chr(0xA0) + chr(0x223C) + chr(0x2024)))
    private = F.when(F.col("p_partkey") % 2 == 0, F.lit("x" + chr(0xE000))).otherwise(F.lit("xy"))
    return _t(spark, d, "part").select("p_partkey", X.plain_lookalikes(odd).alias("plain"), X.has_private_use(private).alias("private"), X.circled_digits(F.concat(F.lit(chr(0xF081) + chr(0xF08B)), F.col("p_size").cast("string"))).alias("circled"))


@query("SELECT p_partkey, p_partkey % 4 = 1 AS thai, p_partkey % 4 = 2 AS vietnamese FROM part")
def scl_needed_faces(spark, d):
    text = _pick(["plain", "ภาษา", "Việt", "ภ 漢"], F.col("p_partkey"))
    return _t(spark, d, "part").select("p_partkey", X.needs_thai(text).alias("thai"), X.needs_vietnamese(text).alias("vietnamese"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS date FROM orders")
def scl_exif_date(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", X.exif_date(F.date_format("o_orderdate", " yyyy:MM:dd HH:mm:ss")).alias("date"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 WHEN p_partkey % 3 = 1 THEN 0.0 ELSE 0.5 END AS similarity FROM part")
def scl_bitmap_similarity(spark, d):
    """The same glyph, one without a common or neighbouring pixel, and one moved by a pixel (only the tolerant half counts)."""
    rows = lambda v: F.array_repeat(F.lit(v).cast("long"), 32)
    other = F.when(F.col("p_partkey") % 3 == 0, rows(1 << 8)).when(F.col("p_partkey") % 3 == 1, rows(1 << 20)).otherwise(rows(1 << 9))
    return _t(spark, d, "part").select("p_partkey", X.bitmap_similarity(rows(1 << 8), other).alias("similarity"))


@query("SELECT p_partkey, 'camera software docinfo' AS tags, 'Noto Sans' AS family, 'SemiBold' AS style, 600 AS weight FROM part")
def scl_tags_and_fonts(spark, d):
    tags = X.tags_by_risk(F.array(F.lit("docinfo"), F.lit("odd"), F.lit("software"), F.lit("camera")))
    font = X.font_name(F.lit("ABCDEF+Noto Sans-SemiBold"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(tags, " ").alias("tags"), font["family"].alias("family"), font["style"].alias("style"), font["weight"].alias("weight"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS plain, contains(c_name, '#') AS named FROM customer")
def snk_mail_text(spark, d):
    c = _t(spark, d, "customer")
    mails = c.select(F.col("c_custkey").cast("string").alias("path"), F.lit("s").alias("subject"), F.col("c_name").alias("from"), F.array(F.lit("b")).alias("to"), F.array().cast("array<string>").alias("cc"), F.lit("d").alias("date"), F.when(F.col("c_custkey") % 2 == 0, "body").otherwise("").alias("text"), F.lit("<p>html</p>").alias("html"), F.array().cast("array<string>").alias("attachments"))
    out = M.mail_text(mails)
    return out.select("path", F.endswith("text", F.lit("body")).alias("plain"), F.contains("text", F.lit("#")).alias("named"))


# --- streams ----------------------------------------------------------------------------------------------


def _folder(spark) -> str:
    """A folder of its own for a stream's output, where driver and executors can both reach it."""
    return tables.new_folder(spark, "stream")


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM e WHERE start + INTERVAL 1 HOUR <= (SELECT max(CAST(ts AS TIMESTAMP)) - INTERVAL 10 MINUTE FROM events) GROUP BY ALL""")
def str_counts_by_window(spark, d):
    """Windows that the watermark has closed when the stream has read all events."""
    schema = _t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(*_stream_path(d, "events"))
    counted = ingest.counts_by_window(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 hour", "10 minutes")
    out = ingest.run_once(counted, _folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def _stream_path(d, name):
    """A file is not a streaming source, a folder with a pattern is."""
    return (f"{d}/{name}.parquet*",)


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'License', ''))) // 7 AS BIGINT) AS n_forbidden, NOT contains(text, 'License') AS passed FROM documents")
def str_checked_documents(spark, d):
    schema = _t(spark, d, "documents").schema
    stream = spark.readStream.schema(schema).parquet(*_stream_path(d, "documents"))
    return ingest.run_once(ingest.checked(stream, ["License"]), _folder(spark))


@query("SELECT DISTINCT user_id FROM events")
def str_new_users(spark, d):
    schema = _t(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(*_stream_path(d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.run_once(ingest.new_documents(stream.select("ts", "user_id"), "ts", "user_id", "400 days").select("user_id"), _folder(spark))
