from pyspark.sql import functions as F

from quillspark.operators import boards as B
from quillspark.operators import findings as N


def test_found_by_rule(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, " \t"), (1, 3, None), (2, 1, "é😀é中"), (3, 1, ""), (None, 1, "ü")], "doc_id long, page int, text string")
    fields = spark.createDataFrame([(1, 2, "b", "text", ""), (1, 1, "a", None, None), (1, 3, "c", "text", "x"), (2, 1, "", "text", ""), (2, 2, None, "text", ""), (2, 3, "l", "hyperlink", ""), (3, 1, "d", "text", " ")], "doc_id long, field_no int, name string, type string, value string")
    got = {(r["doc_id"], r["code"]): r["message"] for r in N.found(pages, fields, r"[\x00-\x7F]").collect()}
    assert got == {
        (1, "EMPTY_FIELDS"): "fields without a value: a, b", (1, "PAGES_WITHOUT_TEXT"): "pages without text: 2, 3", (3, "PAGES_WITHOUT_TEXT"): "pages without text: 1",
        (2, "MISSING_GLYPHS"): "4 characters no font has: é, 中, 😀", (None, "MISSING_GLYPHS"): "1 characters no font has: ü",
    }
    assert N.found(pages.limit(0), fields.limit(0), "x").count() == 0


def test_a_long_text_is_a_row_for_each_character(spark):
    pages = spark.createDataFrame([(1, 1, "aé" * 300_000)], "doc_id long, page int, text string")
    assert [r["message"] for r in N.missing_glyphs(pages, "[a-z]").collect()] == ["300000 characters no font has: é"]


def test_layer_facts(spark):
    said = {
        "Copper,L1,Top": ("copper", "top", 1, None), "COPPER, l4 ,bottom": ("copper", "bottom", 4, None), "Copper,L1": ("copper", "top", 1, None), "Copper,L2": ("copper", "inner", 2, None), "Copper,x,Inr": ("copper", "inner", 0, None),
        "Plated,1,4,PTH": ("drill", "both", 0, True), "NonPlated,1,4": ("drill", "both", 0, False), "Profile": ("outline", "both", 0, None), "Soldermask": ("mask", None, 0, None), "Component,L4,Bot": ("component", "bottom", 4, None),
        "Pads,Top": ("other", "top", 0, None), "Other,Top": ("other", None, 0, None), "Drillmap": ("drawing", None, 0, None), "Top,Top": (None, None, 0, None), "": (None, None, 0, None), None: (None, None, 0, None),
    }
    df = spark.createDataFrame([(k,) for k in said], "f string").select("f", B.layer_facts(F.col("f")).alias("x"))
    assert {r["f"]: tuple(r["x"]) for r in df.collect()} == said
