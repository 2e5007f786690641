"""Layouts over whole tables: a drawing for each customer with three layouts, a point in the model or on paper for each order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import dxf
from ..sources import layouts as L

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_HEAD = """0|SECTION|2|TABLES|0|TABLE|2|LAYER|0|LAYER|5|a1|2|F|0|LAYER|5|A2|2|O|0|LAYER|5|A3|2|P|0|ENDTAB|0|ENDSEC|0|SECTION|2|BLOCKS
0|BLOCK|2|*Paper_Space|330|B0|0|ENDBLK
0|BLOCK|2|*Paper_Space0|330|b1|0|VIEWPORT|69|1|10|0|20|0|40|9|41|9|45|9|0|VIEWPORT|69|2|10|50|20|50|40|100|41|100|12|50|22|ROW|45|20FROZEN|0|POINT|8|0|10|1|20|1|0|ENDBLK
0|BLOCK|2|*Paper_Space1|330|B2EXTRA|0|ENDBLK
0|ENDSEC|0|SECTION|2|ENTITIES
"""
_TAIL = """0|ENDSEC|0|SECTION|2|OBJECTS
0|LAYOUT|100|AcDbPlotSettings|1|page|71|9|100|AcDbLayout|1|Second|71|AT_TAB|10|0|20|0|11|297|21|210|102|{ACAD|330|FF|102|}|330|B1
0|LAYOUT|100|AcDbLayout|1|First|71|2|330|b0
0|ENDSEC|0|EOF
"""


def _files(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    key, k = F.col("o_orderkey"), F.col("o_custkey")
    point = F.concat(F.lit("0|POINT|8|"), "o_orderstatus", F.when(key % 5 == 0, "|67|1").otherwise(""), F.lit("|10|"), (key % 100).cast("string"), F.lit("|20|5\n"))
    text = o.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(point)), "").alias("body")).select("o_custkey", F.concat(F.lit(_HEAD), "body", F.lit(_TAIL)).alias("text"))
    content = F.col("text")
    for mark, by in (("ROW", (k % 7).cast("string")), ("FROZEN", F.when(k % 3 == 0, "|331|A1").otherwise("")), ("EXTRA", F.when(k % 2 == 0, "|0|POINT|8|0|10|2|20|2").otherwise("")), ("AT_TAB", (k % 4 + 1).cast("string"))):
        content = F.replace(content, F.lit(mark), by)
    return text.select(F.col("o_custkey").cast("string").alias("path"), F.replace(content, F.lit("|"), F.lit("\n")).cast("binary").alias("content"))


@query("""WITH c AS (SELECT o_custkey AS k, count(*) FILTER (o_orderkey % 5 = 0) AS n FROM orders GROUP BY 1),
l AS (SELECT k, 'First' AS layout, 2 AS tab, true AS active, n AS n_entities, NULL::DOUBLE AS x1, 0 AS pos FROM c WHERE n > 0 UNION ALL SELECT k, 'Second', k % 4 + 1, false, 3, 297.0, 1 FROM c
UNION ALL SELECT k, 'Paper_Space1', NULL, false, 1, NULL, 2 FROM c WHERE k % 2 = 0)
SELECT CAST(k AS VARCHAR) AS path, row_number() OVER (PARTITION BY k ORDER BY coalesce(tab, 99), pos) AS layout_no, layout, coalesce(tab, -1) AS tab, active, n_entities, coalesce(x1, 0.0) AS x1 FROM l""")
def src_dxf_layouts(spark, d):
    files = _files(spark, d)
    out = L.layouts(files, dxf.entities(files))
    return out.select("path", F.col("layout_no").cast("long").alias("layout_no"), "layout", F.coalesce("tab", F.lit(-1)).cast("long").alias("tab"), "active", "n_entities", F.coalesce("x1", F.lit(0.0)).alias("x1"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS path, '*PAPER_SPACE0' AS block, 2 AS view, o_orderstatus AS layer, CAST(50 + 5 * (o_orderkey % 100 - 50) AS DOUBLE) AS x, CAST(50 + 5 * (5 - o_custkey % 7) AS DOUBLE) AS y
FROM orders WHERE o_orderkey % 5 <> 0 AND abs(o_orderkey % 100 - 50) <= 10 AND NOT (o_custkey % 3 = 0 AND o_orderstatus = 'F')""")
def flt_dxf_viewports(spark, d):
    """What of each model a viewport at 5 to 1 shows; every third freezes a layer."""
    files = _files(spark, d)
    found = dxf.entities(files)
    out = L.shown(dxf.drawn(found, dxf.block_bases(files)), L.viewports(found), L.layers(files))
    return out.select("path", "block", "view", "layer", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))
