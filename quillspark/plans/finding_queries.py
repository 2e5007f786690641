"""Findings over whole tables: lines of documents as pages, their columns as fields; file functions of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boards as B
from ..operators import findings as N

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(r"""WITH f AS (SELECT doc_id, unnest(['source', 'lang', '', 'quality', 'link']) AS name, unnest([source, lang, NULL, NULL, NULL]) AS value, unnest(['text', 'text', 'text', CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'hyperlink' END, 'hyperlink']) AS type, unnest([0, 1, 2, 3, 4]) AS n FROM documents),
p AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS page FROM documents),
c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[\x00-\x7F]', '', 'g'), '')) AS ch FROM documents),
g AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2)
SELECT doc_id, 'warning' AS severity, 'EMPTY_FIELDS' AS code, 'fields without a value: ' || string_agg(name, ', ' ORDER BY n) AS message FROM f WHERE name <> '' AND type <> 'hyperlink' AND coalesce(value, '') = '' GROUP BY 1
UNION ALL SELECT doc_id, 'warning', 'MISSING_GLYPHS', sum(n)::BIGINT || ' characters no font has: ' || string_agg(ch, ', ' ORDER BY unicode(ch)) FROM g GROUP BY 1
UNION ALL SELECT doc_id, 'info', 'PAGES_WITHOUT_TEXT', 'pages without text: ' || string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page) FROM p WHERE regexp_full_match(text, '\s*') GROUP BY 1""")
def chk_found_issues(spark, d):
    """Characters outside ASCII have no glyph here; a document's quality is a field to fill for every third, else a link."""
    docs = _t(spark, d, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")
    field = lambda i, name, value, kind: F.struct(F.lit(i).alias("field_no"), F.lit(name).alias("name"), kind.alias("type"), value.cast("string").alias("value"))
    text, link, none = F.lit("text"), F.lit("hyperlink"), F.lit(None)
    every = F.array(field(0, "source", F.col("source"), text), field(1, "lang", F.col("lang"), text), field(2, "", none, text), field(3, "quality", none, F.when(F.col("doc_id") % 3 == 0, text).otherwise(link)), field(4, "link", none, link))
    return N.found(pages, docs.select("doc_id", F.inline(every)), r"[\x00-\x7F]")


_FUNCTIONS = ["Copper,L#,Top", "copper,L#,Inr,Plane", "Copper,L#", "Copper", "Plated,1,#,PTH", "NonPlated,1,2,NPTH", "Profile,NP", "Soldermask,Bot", "Legend,Top", "Paste,bottom", "Component,L#,Bot", "Glue,Top", "Other,Top", "VcutMap", "AssemblyDrawing,Bot", "Nothing,Top", ""]


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_size % 4 AS INT) AS n, replace({_FUNCTIONS}[p_partkey % {len(_FUNCTIONS)} + 1], '#', CAST(p_size % 4 AS VARCHAR)) AS f FROM part), w AS (SELECT *, lower(split_part(f, ',', 1)) AS w, lower(split_part(f, ',', 2)) AS a, lower(split_part(f, ',', 3)) AS b FROM p),
s AS (SELECT *, CASE WHEN left(CASE WHEN w IN ('copper', 'component') THEN b ELSE a END, 3) = 'top' THEN 'top' WHEN left(CASE WHEN w IN ('copper', 'component') THEN b ELSE a END, 3) = 'bot' THEN 'bottom' WHEN left(b, 3) = 'inr' THEN 'inner' END AS s,
CASE WHEN a = 'l' || n AND w IN ('copper', 'component') THEN n ELSE 0 END AS no FROM w),
k AS (SELECT *, CASE WHEN w IN ('copper', 'paste', 'component', 'other') THEN w WHEN w IN ('plated', 'nonplated') THEN 'drill' WHEN w = 'profile' THEN 'outline' WHEN w = 'soldermask' THEN 'mask' WHEN w = 'legend' THEN 'silk' WHEN w = 'glue' THEN 'other' WHEN w IN ('vcutmap', 'assemblydrawing') THEN 'drawing' END AS kind FROM s)
SELECT p_partkey, coalesce(kind, 'none') AS kind, coalesce(CASE WHEN kind = 'copper' THEN coalesce(s, CASE WHEN no = 1 THEN 'top' ELSE 'inner' END) WHEN kind IN ('drill', 'outline') THEN 'both' WHEN kind IS NOT NULL AND w <> 'other' THEN s END, 'none') AS side, CAST(no AS BIGINT) AS layer_no, CASE w WHEN 'plated' THEN 'yes' WHEN 'nonplated' THEN 'no' ELSE 'none' END AS plated FROM k""")
def scl_layer_functions(spark, d):
    """Every kind of file function, with layer numbers from 0 to 3."""
    p = _t(spark, d, "part")
    said = F.replace(F.element_at(F.array(*map(F.lit, _FUNCTIONS)), (F.col("p_partkey") % len(_FUNCTIONS) + 1).cast("int")), F.lit("#"), (F.col("p_size") % 4).cast("string"))
    out = p.select("p_partkey", B.layer_facts(said).alias("f"))
    none = lambda c: F.coalesce(F.col(c), F.lit("none"))
    return out.select("p_partkey", none("f.kind").alias("kind"), none("f.side").alias("side"), F.col("f.layer_no").cast("long").alias("layer_no"), F.when(F.col("f.plated"), "yes").when(~F.col("f.plated"), "no").otherwise("none").alias("plated"))
