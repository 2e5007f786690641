"""Scalar functions, checks, edits, templates and redaction over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents as D

FORBIDDEN = ["rights reserved", "MIT License", "the the"]
PAIRS = [("the", "<T>"), ("<T>", "THE"), ("and", "&")]


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _count(phrase: str, text: str = "text") -> str:
    return f"CAST((length({text}) - length(replace({text}, '{phrase}', ''))) // {len(phrase)} AS BIGINT)"


_ISSUES = " UNION ALL ".join(
    [f"""SELECT doc_id, 'error' AS severity, 'FORBIDDEN_TEXT' AS code, '"{p}" appears ' || {_count(p)} || ' times' AS message FROM documents WHERE {_count(p)} > 0""" for p in FORBIDDEN]
    + ["SELECT doc_id, 'info', 'NO_TEXT_LAYER', 'no text' FROM documents WHERE length(regexp_replace(text, '\\s', '', 'g')) = 0"]
    + ["SELECT doc_id, 'error', 'PLACEHOLDERS_LEFT', 'placeholders not filled: ' || array_to_string(regexp_extract_all(text, '\\{\\{\\s*[^{}]+?\\s*\\}\\}'), ' ') FROM documents WHERE regexp_matches(text, '\\{\\{\\s*[^{}]+?\\s*\\}\\}')"]
)


@query(_ISSUES)
def chk_document_issues(spark, d):
    return D.issues(_docs(spark, d), FORBIDDEN)


@query(f"WITH i AS ({_ISSUES}) SELECT d.doc_id, coalesce(n, 0) AS n_issues, coalesce(e, 0) = 0 AS passed FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (severity = 'error') AS e FROM i GROUP BY 1) x USING (doc_id)")
def chk_passed(spark, d):
    docs = _docs(spark, d)
    return D.passed(docs, D.issues(docs, FORBIDDEN))


@query(f"SELECT doc_id, {_count('the')} AS n_the, {_count('on on')} AS n_on FROM documents")
def agg_substring_count(spark, d):
    return _docs(spark, d).select("doc_id", X.count_of(F.col("text"), "the").alias("n_the"), X.count_of(F.col("text"), "on on").alias("n_on"))


@query("SELECT doc_id, md5(replace(replace(replace(text, 'the', '<T>'), '<T>', 'THE'), 'and', '&')) AS code FROM documents")
def scl_replace_in_order(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.replaced(F.col("text"), PAIRS).cast("binary")).alias("code"))


@query("SELECT doc_id, md5(regexp_replace(text, 'the', 'X$1', 'gi')) AS code FROM documents")
def scl_replace_ignoring_case(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.replaced_ignoring_case(F.col("text"), "the", "X$1").cast("binary")).alias("code"))


@query(r'''SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS dense, CAST(length(text) AS BIGINT) AS units, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS xml FROM documents''')
def scl_lengths_and_xml(spark, d):
    return _docs(spark, d).select("doc_id", X.dense_length(F.col("text")).alias("dense"), X.utf16_length(F.col("text")).alias("units"), F.md5(X.xml_escaped(F.col("text")).cast("binary")).alias("xml"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-zÀ-ɏḀ-ỿ]')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS digit,
  CAST(len(regexp_extract_all(text, '[가-힣ㄱ-ㆎ]')) AS BIGINT) AS hangul, CASE WHEN regexp_matches(text, '[A-Za-zÀ-ɏḀ-ỿ]') THEN 'la' ELSE 'other' END AS script FROM documents""")
def agg_script_counts(spark, d):
    c = X.script_counts(F.col("text"))
    return _docs(spark, d).select("doc_id", c["latin"].alias("latin"), c["digit"].alias("digit"), c["hangul"].alias("hangul"), X.line_script(F.col("text"), F.lit(1.0)).alias("script"))


@query("SELECT doc_id, round(length(text) * CAST(0.55 AS DOUBLE), 4) AS width FROM documents")
def scl_width_weight(spark, d):
    return _docs(spark, d).select("doc_id", F.round(X.width_weight(F.col("text")), 4).alias("width"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars * 10 / 1024.0 + 0.5) / 10) ELSE printf('%.2f MB', n_chars / 1048576.0) END AS size FROM documents")
def scl_byte_size(spark, d):
    return _docs(spark, d).select("doc_id", X.byte_size(F.col("n_chars")).alias("size"))


@query(r"""WITH n AS (SELECT c_custkey, c_mktsegment || '/' || substr(c_name, 1, 12) AS raw FROM customer), s AS (
  SELECT c_custkey, trim(regexp_replace(regexp_replace(raw, '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), '\s+', ' ', 'g')) || '.docx' AS name FROM n)
SELECT c_custkey, name, CASE WHEN row_number() OVER w = 1 THEN name ELSE regexp_extract(name, '^(.*?)(\.[^.]*)?$', 1) || '-' || row_number() OVER w || '.docx' END AS unique_name
FROM s WINDOW w AS (PARTITION BY name ORDER BY c_custkey)""")
def win_unique_names(spark, d):
    raw = F.concat("c_mktsegment", F.lit("/"), F.substring("c_name", 1, 12))
    named = _t(spark, d, "customer").select("c_custkey", X.safe_file_name(raw, F.col("c_custkey"), "docx").alias("name"))
    return D.unique_names(named, "name", "c_custkey")


@query("""SELECT c_custkey, k, c_name || CASE k WHEN 0 THEN '.docx' WHEN 1 THEN '-2.docx' ELSE '-2-2.docx' END AS unique_name FROM customer, (VALUES (0), (1), (2)) v(k)""")
def win_unique_names_taken(spark, d):
    """Twice the same name, and then a given name that the second has already taken."""
    rows = _t(spark, d, "customer").select("c_custkey", "c_name", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("k"))
    named = rows.withColumn("name", F.concat("c_name", F.when(F.col("k") == 2, "-2.docx").otherwise(".docx"))).withColumn("at", F.col("c_custkey") * 3 + F.col("k"))
    return D.unique_names(named, "name", "at").select("c_custkey", "k", "unique_name")


@query("""SELECT c_custkey, 'Dear {{c_mktsegment}}, {{ c_name }} {{c_name}}' AS text FROM customer""")
def tpl_values_with_marks(spark, d):
    """A value that holds a mark is not filled again."""
    data = _t(spark, d, "customer").select("c_custkey", F.lit("{{c_mktsegment}}").alias("a"), F.lit("{{ c_name }}").alias("b"), "c_mktsegment", F.lit("{{c_name}}").alias("c_name"))
    return D.fill_rows(data, "Dear {{a}}, {{b}} {{c_name}}", "c_custkey").select("c_custkey", "text")


_LETTER = "Dear {{c_name}},\nyour {{ c_mktsegment }} account holds {{c_acctbal}}. {{c_missing}}\n"


@query("SELECT c_custkey, 'Dear ' || c_name || ',' || chr(10) || 'your ' || c_mktsegment || ' account holds ' || c_custkey || '. {{c_missing}}' || chr(10) AS text, 0 AS rows_added, '{{c_missing}}' AS left_over FROM customer")
def tpl_fill_letters(spark, d):
    data = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_custkey").alias("c_acctbal"))
    return D.fill_rows(data, _LETTER, "c_custkey").select("c_custkey", "text", "rows_added", F.array_join("left", " ").alias("left_over"))


@query("""WITH l AS (SELECT l_orderkey, string_agg('- ' || l_partkey || ' x ' || CAST(l_quantity AS BIGINT) || chr(10), '' ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)) AS lines, CAST(count(*) AS INT) - 1 AS added FROM lineitem GROUP BY 1)
SELECT o_orderkey, 'Order ' || o_orderkey || chr(10) || coalesce(lines, '') || 'Priority ' || o_orderpriority AS text, coalesce(added, -1) AS rows_added FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def tpl_fill_repeating_rows(spark, d):
    item = F.struct("l_linenumber", F.col("l_partkey").alias("part"), F.col("l_quantity").cast("long").alias("qty"))
    items = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    data = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(items, "o_orderkey", "left")
    data = data.withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    out = D.fill_rows(data, "Order {{o_orderkey}}\n- {{items.part}} x {{items.qty}}\nPriority {{o_orderpriority}}", "o_orderkey", "- {{items.part}} x {{items.qty}}\n", "items")
    return out.select("o_orderkey", "text", "rows_added")


@query("SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS block_no, unnest(string_split(text, chr(10))) AS text FROM documents")
def src_blocks(spark, d):
    return D.blocks(_docs(spark, d))


@query("""WITH b AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS block_no, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT doc_id, CASE WHEN block_no > 0 THEN block_no + 2 ELSE block_no END AS block_no, text FROM b
UNION ALL SELECT doc_id, 1, 'first new' FROM b WHERE block_no = 0 UNION ALL SELECT doc_id, 2, 'second new' FROM b WHERE block_no = 0""")
def edt_insert_after(spark, d):
    return D.insert_after(D.blocks(_docs(spark, d)), 0, ["first new", "second new"])


@query("""WITH b AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS block_no, unnest(string_split(text, chr(10))) AS text FROM documents),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM b)
SELECT doc_id, CASE WHEN block_no > 0 THEN block_no - 1 ELSE block_no END AS block_no, text, CASE WHEN n = 1 THEN 'RULE' ELSE 'ok' END AS status FROM c WHERE block_no <> 0 OR n = 1""")
def edt_delete_block(spark, d):
    return D.delete_block(D.blocks(_docs(spark, d)), 0)


@query(f"SELECT doc_id, {_count('and')} AS n_replaced, CAST(0 AS BIGINT) AS n_left, md5(replace(text, 'and', 'AND')) AS code FROM documents")
def edt_replace_text(spark, d):
    parts = _docs(spark, d).select("doc_id", F.lit(0).alias("block_no"), "text")
    return D.replace_text(parts, "and", "AND").select("doc_id", "n_replaced", "n_left", F.md5(F.col("text").cast("binary")).alias("code"))


@query("""WITH s AS (SELECT doc_id, text, contains(text, 'the') AS a, contains(replace(text, 'the', 'THE'), 'All rights') AS b FROM documents)
SELECT doc_id, a AND b AS ok, CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 END AS failed_op, md5(CASE WHEN a AND b THEN replace(replace(text, 'the', 'THE'), 'All rights', 'No rights') ELSE text END) AS code FROM s""")
def edt_fold_operations(spark, d):
    out = D.fold_operations(_docs(spark, d), [{"find": "the", "replace": "THE"}, {"find": "All rights", "replace": "No rights"}])
    return out.select("doc_id", "ok", "failed_op", F.md5(F.col("text").cast("binary")).alias("code"))


@query(f"SELECT doc_id, CAST({_count('All rights reserved')} + {_count('License')} AS BIGINT) AS n_found, md5(replace(replace(text, 'All rights reserved', '###################'), 'License', '#######')) AS code, CAST(0 AS BIGINT) AS n_left, true AS proved FROM documents")
def red_mask_and_prove(spark, d):
    out = D.redact(_docs(spark, d), ["All rights reserved", "License"])
    return out.select("doc_id", "n_found", F.md5(F.col("redacted").cast("binary")).alias("code"), "n_left", "proved")


_CELLS = """c AS (SELECT l_orderkey AS doc_id, 0 AS table_no, l_linenumber - 1 AS row_idx, k AS col_idx, CASE WHEN l_linenumber = 2 AND k = 0 THEN 2 ELSE 1 END AS row_span,
  1 AS col_span, CASE k WHEN 0 THEN CAST(part AS VARCHAR) ELSE CAST(qty AS VARCHAR) END AS text FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, CAST(min(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ALL), (VALUES (0), (1)) v(k) WHERE NOT (l_linenumber = 3 AND k = 0))"""


def _cells(spark, d):
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("long").alias("qty"))
    rows = lines.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("col_idx")).where(~((F.col("l_linenumber") == 3) & (F.col("col_idx") == 0)))
    text = F.when(F.col("col_idx") == 0, F.col("part").cast("string")).otherwise(F.col("qty").cast("string"))
    span = F.when((F.col("l_linenumber") == 2) & (F.col("col_idx") == 0), 2).otherwise(1)
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_no"), (F.col("l_linenumber") - 1).alias("row_idx"), "col_idx", span.alias("row_span"), F.lit(1).alias("col_span"), text.alias("text"))


@query(f"""WITH {_CELLS}, t AS (SELECT doc_id, max(row_idx) + 1 AS n_rows, list(row_idx) FILTER (col_idx = 0) AS r0, list(row_idx) FILTER (col_idx = 1) AS r1 FROM c GROUP BY 1),
x AS (SELECT t.*, o.*, list_contains(r0, 1) AS has1, list_contains(CASE col_idx WHEN 0 THEN r0 ELSE r1 END, o.row_idx) AS has FROM t, (VALUES (0, 2, 0), (1, 2, 1), (2, 0, 1)) o(op_no, row_idx, col_idx))
SELECT doc_id, row_idx, col_idx, CASE WHEN row_idx >= n_rows THEN 'BAD_ARGUMENT' WHEN row_idx = 2 AND col_idx = 0 AND has1 THEN 'RULE' ELSE 'ok' END AS status,
  CASE WHEN row_idx >= n_rows THEN NULL WHEN row_idx = 2 AND col_idx = 0 AND has1 THEN 1 WHEN has THEN row_idx END AS anchor_row, CASE op_no WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS new_text FROM x""")
def edt_set_cell(spark, d):
    cells = _cells(spark, d)
    tables = cells.groupBy("doc_id", "table_no").agg((F.max("row_idx") + 1).alias("n_rows"), F.lit(2).alias("n_cols"))
    ops = spark.sql("select * from values (0, 2, 0, 'a'), (1, 2, 1, 'b'), (2, 0, 1, 'c') as t(op_no, row_idx, col_idx, new_text)")
    changes = tables.select("doc_id", "table_no").crossJoin(F.broadcast(ops))
    out = D.set_cells(cells, tables, changes)
    return out.select("doc_id", "row_idx", "col_idx", "status", F.when(F.col("status") != "BAD_ARGUMENT", F.col("anchor_row")).alias("anchor_row"), "new_text")


@query(f"""WITH {_CELLS}, m AS (SELECT doc_id, max(row_idx) AS last FROM c GROUP BY 1), p AS (SELECT c.doc_id, last FROM c JOIN m ON c.doc_id = m.doc_id AND row_idx = last GROUP BY 1, 2 HAVING max(greatest(row_span, col_span)) = 1)
SELECT doc_id, row_idx, col_idx, text FROM c UNION ALL SELECT c.doc_id, row_idx + 1, col_idx, CASE col_idx WHEN 0 THEN 'sum' ELSE '9' END FROM c JOIN p ON c.doc_id = p.doc_id AND c.row_idx = p.last""")
def edt_append_row(spark, d):
    return D.append_row(_cells(spark, d), ["sum", "9"]).select("doc_id", "row_idx", "col_idx", "text")


@query("SELECT CAST(count(*) AS BIGINT) AS n, code FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'NOT_FOUND' WHEN o_orderkey % 5 = 1 THEN 'PASSWORD_WRONG' WHEN o_orderkey % 5 = 2 THEN 'UNSUPPORTED' WHEN o_orderkey % 5 = 3 THEN 'BAD_ARGUMENT' ELSE 'UNREADABLE' END AS code FROM orders) GROUP BY code")
def res_error_codes(spark, d):
    said = F.element_at(F.array(*map(F.lit, ["ENOENT: no such file", "wrong password", "type is not supported", "page is out of range", "odd"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return _t(spark, d, "orders").select(X.error_code(said).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CAST(greatest(1, floor(800.0 + 0.5)) AS BIGINT) AS width, CAST(greatest(1, floor(800.0 * p_size / 60 + 0.5)) AS BIGINT) AS height FROM part WHERE p_size * 1000 >= 0")
def scl_target_size(spark, d):
    s = X.target_size(F.lit(6000.0), F.col("p_size") * 100.0, "width", 800.0)
    return _t(spark, d, "part").select("p_partkey", s["width"].alias("width"), s["height"].alias("height"))
