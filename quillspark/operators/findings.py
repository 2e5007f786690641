"""Findings of documents from their pages, fields and characters: each rule an aggregate, together (doc_id, severity, code, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .structure import character_counts


def _rows(df: DataFrame, severity: str, code: str, message: Column) -> DataFrame:
    return df.select("doc_id", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def empty_fields(fields: DataFrame) -> DataFrame:
    """One row for each document with named fields (doc_id, field_no, name, type, value) that have no value; links are no fields to fill."""
    bare = fields.where("name <> '' and coalesce(type, '') <> 'hyperlink' and coalesce(value, '') = ''")
    names = F.array_sort(F.collect_list(F.struct("field_no", "name")))
    return _rows(bare.groupBy("doc_id").agg(F.array_join(F.transform(names, lambda r: r["name"]), ", ").alias("names")), "warning", "EMPTY_FIELDS", F.concat(F.lit("fields without a value: "), "names"))


def missing_glyphs(pages: DataFrame, has: str) -> DataFrame:
    """One row for each document with characters that the fonts (a regular expression of what they have) lack: how many, and which, by code point.

    Counted by character before a document's are put together, so a long text is a row for each different one.
    """
    lacking = character_counts(pages.where("text is not null").select("doc_id", "text"), has)
    chars = F.array_sort(F.collect_list(F.struct(F.ascii("char").alias("code"), "char")))
    each = lacking.groupBy("doc_id").agg(F.sum("n").alias("n"), F.array_join(F.transform(chars, lambda c: c["char"]), ", ").alias("chars"))
    return _rows(each, "warning", "MISSING_GLYPHS", F.concat(F.col("n").cast("string"), F.lit(" characters no font has: "), "chars"))


def pages_without_text(pages: DataFrame) -> DataFrame:
    """One row for each document with pages (doc_id, page, text) on which nothing but white space stands, some of its pages or all."""
    bare = pages.where(X.dense_length(F.coalesce("text", F.lit(""))) == 0)
    each = bare.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ", ").alias("numbers"))
    return _rows(each, "info", "PAGES_WITHOUT_TEXT", F.concat(F.lit("pages without text: "), "numbers"))


def found(pages: DataFrame, fields: DataFrame, has: str) -> DataFrame:
    """Empty fields, characters without a glyph and pages without text of all documents."""
    return empty_fields(fields).unionByName(missing_glyphs(pages, has)).unionByName(pages_without_text(pages))
