"""Raw pages to headings, links, text and markdown, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import markup as M

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


@query(r"""SELECT page_id, len(h) AS n, array_to_string(list_transform(h, lambda x: substr(x, 3, 1) || ' ' || trim(regexp_replace(x, '<[^>]+>', '', 'g'))), chr(10)) AS text
FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>') AS h FROM pages)""")
def snk_page_headings(spark, d):
    """Headings of all levels, as they come."""
    h = M.headings(F.col("html"))
    text = F.array_join(F.transform(h, lambda x: F.concat(x["level"].cast("string"), F.lit(" "), x["text"])), "\n")
    return _pages(spark, d).select("page_id", F.size(h).cast("long").alias("n"), text.alias("text"))


@query(r"""SELECT page_id, len(l) AS n, array_to_string(l, ' ') AS hrefs FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1) AS l FROM pages)""")
def snk_page_links(spark, d):
    links = M.links(F.col("html"))
    return _pages(spark, d).select("page_id", F.size(links).cast("long").alias("n"), F.array_join(links, " ").alias("hrefs"))


@query(r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS code FROM pages""")
def snk_stripped_pages(spark, d):
    return _pages(spark, d).select("page_id", F.md5(M.stripped_html(F.col("html")).cast("binary")).alias("code"))


@query()
def snk_page_markdown(spark, d):
    return _pages(spark, d).select("page_id", M.markdown_of(F.col("html")).alias("markdown"))


@query()
def src_page_blocks(spark, d):
    return M.page_blocks(_pages(spark, d))
