"""Ranking, geometry, pages, layers and sheets over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import geometry as G
from ..operators import ranking as R

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


def _best(spark, d, k, by_label=False):
    v = _t(spark, d, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.best_vectors(v, queries, k, by_label)


_SIM = """s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_sum(list_transform(range(1, 65), lambda i: CAST(v.embedding[i] AS DOUBLE) * q.embedding[i])) AS sim
FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)"""


@query(f"WITH {_SIM} SELECT query_id, vec_id, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def srt_cosine_topk(spark, d):
    return R.top_k(_best(spark, d, 10), 10).select("query_id", "vec_id", F.round("sim", 6).alias("sim"), "rank")


@query(f"WITH {_SIM} SELECT query_id, label, vec_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, vec_id) AS n FROM s) WHERE n = 1")
def agg_family_best(spark, d):
    return R.best_by_family(_best(spark, d, 1, True)).withColumn("sim", F.round("sim", 6))


@query("""WITH p AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, avg(CAST(v AS DOUBLE)) AS v FROM p GROUP BY ALL), n AS (SELECT label, sqrt(sum(v * v)) AS n FROM m GROUP BY 1)
SELECT label, round(sum(v / n * i), 5) AS moment FROM m JOIN n USING (label) GROUP BY label""")
def agg_mean_unit_vector(spark, d):
    out = R.mean_unit_vectors(_t(spark, d, "embeddings"), "label")
    return out.select("label", F.round(F.aggregate(F.transform("mean", lambda v, i: v * i), F.lit(0.0), lambda s, x: s + x), 5).alias("moment"))


@query("""SELECT l_suppkey, round(CASE WHEN count(*) < 3 OR var_pop(l_quantity) * count(*) < 1e-9 THEN 0 ELSE regr_slope(l_extendedprice, l_quantity) END / 7, 2) AS slope,
  round(CASE WHEN count(*) < 3 OR var_pop(l_quantity) * count(*) < 1e-9 THEN avg(l_extendedprice) ELSE regr_intercept(l_extendedprice, l_quantity) END / 7, 2) AS intercept FROM lineitem GROUP BY 1""")
def agg_line_fit(spark, d):
    fit = R.line_fit(F.col("l_quantity"), F.col("l_extendedprice"))
    out = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(fit.alias("f"))
    return out.select("l_suppkey", F.round(F.col("f.slope") / 7, 2).alias("slope"), F.round(F.col("f.intercept") / 7, 2).alias("intercept"))


@query("SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS middle FROM events GROUP BY 1")
def agg_upper_median(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(X.upper_median_of("value").alias("middle"))


@query("WITH r AS (SELECT user_id, floor(value * 100 + 0.5) / 100 AS z, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, arg_max(z, (n, -z)) AS level FROM r GROUP BY 1")
def agg_level_mode(spark, d):
    return _t(spark, d, "events").groupBy("user_id").agg(G.level_elevation(F.col("value")).alias("level"))


@query("SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def agg_count_by_kind(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""WITH s AS (SELECT user_id, epoch(ts) AS t FROM events), j AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 3600 THEN 1 ELSE 0 END AS j FROM s),
i AS (SELECT *, sum(j) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM j)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n FROM i GROUP BY ALL""")
def win_islands(spark, d):
    rows = _t(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return R.islands(rows, "user_id", "at", 3600e6).groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id, event_id, length(event_type) % 3 AS k FROM events), p AS (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM s)
SELECT user_id, string_agg(CAST(k AS VARCHAR), '' ORDER BY event_id) AS path FROM p WHERE k <> 0 AND (b IS NULL OR b <> k) GROUP BY 1""")
def win_collapse_repeats(spark, d):
    steps = _t(spark, d, "events").select("user_id", "event_id", (F.length("event_type") % 3).alias("k"))
    kept = R.collapse_repeats(steps, "user_id", "event_id", "k", 0)
    rows = F.array_sort(F.collect_list(F.struct("event_id", "k")))
    return kept.groupBy("user_id").agg(F.array_join(F.transform(rows, lambda r: r["k"].cast("string")), "").alias("path"))


def _pages(spark, d):
    return _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


@query("""WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, md5(text) AS code FROM conversations), n AS (SELECT doc_id, max(page) AS n_pages FROM p GROUP BY 1)
SELECT n.doc_id, w.new_page, CAST(w.page AS INT) AS page, p.code, CASE WHEN w.page > n_pages THEN 'BAD_ARGUMENT' ELSE 'ok' END AS status FROM n, (VALUES (1, 3), (2, 1), (3, 1)) w(new_page, page) LEFT JOIN p ON p.doc_id = n.doc_id AND p.page = w.page""")
def flt_select_pages(spark, d):
    out = R.select_pages(_pages(spark, d), [3, 1, 1])
    return out.select("doc_id", "new_page", "page", F.md5(F.col("text").cast("binary")).alias("code"), "status")


@query("SELECT conv_id AS doc_id, CAST(1 + CASE WHEN turn + 1 >= 2 THEN 1 ELSE 0 END + CASE WHEN turn + 1 >= 4 THEN 1 ELSE 0 END AS INT) AS part_no, count(*) AS n FROM conversations GROUP BY ALL")
def flt_split_pages(spark, d):
    return R.split_pages(_pages(spark, d), [4, 2, 1, 4]).groupBy("doc_id", "part_no").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT conv_id AS doc_id, 0 AS part, turn + 1 AS page, text FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, 1, turn + 1, text FROM conversations WHERE turn >= 1)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part, page) AS INT) AS page, md5(text) AS code FROM m""")
def flt_merge_pages(spark, d):
    p = _pages(spark, d)
    return R.merge_pages([p.where("page <= 2"), p.where("page >= 2")]).select("doc_id", "page", F.md5(F.col("text").cast("binary")).alias("code"))


@query("""WITH p AS (SELECT conv_id AS binder, turn + 1 AS page, CASE WHEN role = 'user' THEN 'doc ' || (turn + 1) END AS name FROM conversations)
SELECT binder, CAST(page AS INT) AS page, last_value(name IGNORE NULLS) OVER (PARTITION BY binder ORDER BY page ROWS UNBOUNDED PRECEDING) AS document FROM p""")
def jn_heading_forward(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("binder"), (F.col("turn") + 1).cast("int").alias("page"), "role")
    starts = rows.where("role = 'user'").select("binder", F.concat(F.lit("doc "), F.col("page").cast("string")).alias("name"), F.col("page").alias("first_page"))
    return R.headings_forward(rows.drop("role"), starts).select("binder", "page", "document")


@query("SELECT o_orderkey, CAST(((o_orderkey % 360 - 450) % 360 + 360) % 360 AS BIGINT) AS angle FROM orders")
def flt_rotate(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", R.rotated(F.col("o_orderkey") % 360, -450).alias("angle"))


def _items(spark, d):
    e = _t(spark, d, "events")
    x, y = (F.col("user_id") * 7 % 100).cast("double"), (F.col("event_id") % 100).cast("double")
    return e.select(F.lit("f").alias("file"), F.lit(1).alias("sheet"), F.col("event_id").alias("item_no"), F.lit("line").alias("kind"), F.col("event_type").alias("layer"), x.alias("x0"), y.alias("y0"), (x + F.col("event_id") % 7).alias("x1"), (y + F.col("event_id") % 5).alias("y1"), F.col("event_type").alias("text"))


_ITEMS = """i AS (SELECT event_id AS item_no, event_type AS layer, CAST(user_id * 7 % 100 AS DOUBLE) AS x0, CAST(event_id % 100 AS DOUBLE) AS y0, CAST(user_id * 7 % 100 + event_id % 7 AS DOUBLE) AS x1,
  CAST(event_id % 100 + event_id % 5 AS DOUBLE) AS y1 FROM events)"""


@query(f"""WITH {_ITEMS}, b AS (SELECT c_custkey AS box_id, CAST(c_custkey % 90 AS DOUBLE) AS bx0, CAST(c_custkey * 3 % 90 AS DOUBLE) AS by0 FROM customer)
SELECT box_id, count(*) AS n, CAST(sum(item_no) AS BIGINT) AS total FROM b, i WHERE x0 <= bx0 + 3 AND x1 >= bx0 AND y0 <= by0 + 2 AND y1 >= by0 GROUP BY 1""")
def flt_items_in_boxes(spark, d):
    x, y = (F.col("c_custkey") % 90).cast("double"), (F.col("c_custkey") * 3 % 90).cast("double")
    boxes = _t(spark, d, "customer").select(F.col("c_custkey").alias("box_id"), F.lit("f").alias("file"), F.lit(1).alias("sheet"), x.alias("bx0"), y.alias("by0"), (x + 3).alias("bx1"), (y + 2).alias("by1"))
    return G.counted_in_boxes(_items(spark, d), boxes, 4.0)


@query(f"""WITH {_ITEMS}, p AS (SELECT c_custkey AS point_id, CAST(c_custkey % 97 AS DOUBLE) AS px, CAST(c_custkey * 5 % 97 AS DOUBLE) AS py FROM customer),
t AS (SELECT *, CASE WHEN (x1 - x0) ** 2 + (y1 - y0) ** 2 > 0 THEN greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) ELSE 0 END AS t FROM p, i),
w AS (SELECT point_id, item_no, sqrt((px - x0 - t * (x1 - x0)) ** 2 + (py - y0 - t * (y1 - y0)) ** 2) AS a FROM t)
SELECT point_id, arg_min(item_no, (round(a, 9), item_no)) AS item_no, round(min(a), 5) AS distance FROM w WHERE a <= 3 GROUP BY 1""")
def flt_nearest_item(spark, d):
    points = _t(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.lit("f").alias("file"), F.lit(1).alias("sheet"), (F.col("c_custkey") % 97).cast("double").alias("px"), (F.col("c_custkey") * 5 % 97).cast("double").alias("py"))
    return G.nearest(_items(spark, d), points, 3.0).select("point_id", "item_no", F.round("distance", 5).alias("distance"))


@query(f"WITH {_ITEMS} SELECT layer, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i WHERE layer <> 'click' GROUP BY 1")
def agg_visible_layer_boxes(spark, d):
    items = _items(spark, d)
    layers = items.select("file", "layer").distinct().withColumn("visible", F.col("layer") != "click")
    return G.layer_counts(G.visible(items, layers)).drop("file")


@query(f"WITH {_ITEMS} SELECT CAST(item_no // 100 AS BIGINT) AS sheet, md5(string_agg(layer, chr(10) ORDER BY -y0, x0, item_no)) AS code FROM i GROUP BY 1")
def snk_sheet_text(spark, d):
    """A sheet for every hundred items."""
    items = _items(spark, d).withColumn("sheet", F.floor(F.col("item_no") / 100))
    return G.sheet_text(items).select("sheet", F.md5(F.col("text").cast("binary")).alias("code"))


@query("""WITH RECURSIVE l AS (SELECT p_size AS board, p_partkey AS no, p_brand AS function, p_type AS name, CAST(p_partkey % 7 AS VARCHAR) AS file FROM part),
a AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY no) AS i FROM l WHERE no % 3 < 2),
b AS (SELECT board, list(struct_pack(no := no, function := function, name := name, file := file) ORDER BY no) AS bs FROM l WHERE no % 3 > 0 GROUP BY 1),
s(board, i, used, a_no, b_no, how) AS (
  SELECT board, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '' FROM (SELECT DISTINCT board FROM l)
  UNION ALL
  SELECT board, i, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit.no) END, a_no, hit.no, coalesce(hit.how, 'only_a') FROM (
    SELECT s.board, a.i, s.used, a.no AS a_no, coalesce(
      list_transform(list_filter(coalesce(bs, []), lambda x: x.function = a.function AND NOT list_contains(s.used, x.no)), lambda x: struct_pack(no := x.no, how := 'function'))[1],
      list_transform(list_filter(coalesce(bs, []), lambda x: x.name = a.name AND NOT list_contains(s.used, x.no)), lambda x: struct_pack(no := x.no, how := 'name'))[1],
      list_transform(list_filter(coalesce(bs, []), lambda x: x.file = a.file AND NOT list_contains(s.used, x.no)), lambda x: struct_pack(no := x.no, how := 'file'))[1]) AS hit
    FROM s JOIN a ON a.board = s.board AND a.i = s.i + 1 LEFT JOIN b ON b.board = s.board) q)
SELECT board, a_no, b_no, how AS "by" FROM s WHERE i > 0
UNION ALL SELECT board, NULL, no, 'only_b' FROM l WHERE no % 3 > 0 AND no NOT IN (SELECT b_no FROM s WHERE b_no IS NOT NULL)""")
def jn_layer_pairs(spark, d):
    """Two versions of each board: every layer is in one of them at least."""
    layers = _t(spark, d, "part").select(F.col("p_size").cast("bigint").alias("board"), F.col("p_partkey").alias("layer_no"), F.col("p_brand").alias("function"), F.col("p_type").alias("name"), (F.col("p_partkey") % 7).cast("string").alias("file"))
    return R.paired_layers(layers.where("layer_no % 3 < 2"), layers.where("layer_no % 3 > 0"))


@query("""SELECT c_custkey AS row_no, '{"name":"' || c_name || '","col2":"' || c_mktsegment || '","note":null}' AS json FROM customer""")
def snk_sheet_json(spark, d):
    rows = _t(spark, d, "customer").select(F.lit("f").alias("file"), F.col("c_custkey").alias("row_no"), F.array("c_name", "c_mktsegment").alias("values"))
    return R.sheet_json(rows, ["name", " ", "note"]).select("row_no", "json")


@query("""WITH s AS (SELECT o_orderkey, CAST((40000 + o_orderkey % 3000) * 86400 + (CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 43200 WHEN 2 THEN 86400 ELSE 1 END) AS BIGINT) AS t FROM orders)
SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(t // 86400 AS INT), '%Y-%m-%d') || CASE WHEN t % 86400 > 0 THEN ' ' || strftime(TIMESTAMP '2000-01-01' + to_seconds(t % 86400), '%H:%M:%S') ELSE '' END AS text FROM s
UNION ALL SELECT * FROM (VALUES (-1, '1900-02-28'), (-2, '1900-02-29'), (-3, '1900-03-01'), (-4, '1900-01-01'), (-5, '06:00:00')) v(k, t)""")
def src_sheet_dates(spark, d):
    """Whole days, halves, the last half second of a day (which is the next day) and a second; and the first days of 1900."""
    part = F.element_at(F.array(*map(F.lit, (0.0, 0.5, 0.999999, 1 / 86400))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    own = _t(spark, d, "orders").select("o_orderkey", (40000 + F.col("o_orderkey") % 3000 + part).alias("serial"))
    first = spark.sql("select * from values (-1L, 59d), (-2L, 60d), (-3L, 61d), (-4L, 1d), (-5L, 0.25d) as t(o_orderkey, serial)")
    return own.unionByName(first).select("o_orderkey", R.sheet_date(F.col("serial")).alias("text"))


@query("""SELECT o_custkey, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS holes, CAST(count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0) AS BIGINT) AS plated,
  count(DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN round(o_orderkey % 10 / 10.0 * 1000) END) AS drill_sizes, min(CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 10 / 10.0 END) AS least_track, count(DISTINCT o_orderstatus) AS nets,
  CAST(max(o_orderkey % 50 + 1) - min(o_orderkey % 50) AS DOUBLE) AS width, CAST(max(o_orderkey % 30 + 1) - min(o_orderkey % 30) AS DOUBLE) AS height, min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 10 / 10.0 END) AS least_hole FROM orders GROUP BY 1""")
def agg_board_facts(spark, d):
    kind = F.element_at(F.array(F.lit("hole"), F.lit("track"), F.lit("pad")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    w, x, y = F.col("o_orderkey") % 10 / 10.0, (F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 30).cast("double")
    objects = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), kind.alias("kind"), (F.col("o_orderkey") % 2 == 0).alias("plated"), w.alias("w"), x.alias("x0"), y.alias("y0"), (x + 1).alias("x1"), (y + 1).alias("y1"), F.col("o_orderstatus").alias("net"))
    return R.board_facts(objects).select(F.col("file").alias("o_custkey"), "holes", "plated", "drill_sizes", "least_track", "nets", "width", "height", "least_hole")
