import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators import documents as D
from quillspark.operators import geometry as G
from quillspark.operators import layout as L
from quillspark.operators import ranking as R
from quillspark.streaming import ingest


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_scalars(spark):
    t = F.col("t")
    assert one(spark, X.count_of(t, "aa"), t="aaaa aa") == 3
    assert one(spark, X.count_of(t, "."), t="a.b.") == 2
    assert one(spark, X.replaced(t, [("a", "b"), ("b", "c")]), t="ab") == "cc"
    assert one(spark, X.replaced_ignoring_case(t, "a.b", "$1\\"), t="A.B axb") == "$1\\ axb"
    assert one(spark, X.placeholders(t), t="{{ a }} {{b}} {{ a }} {{}}") == ["{{ a }}", "{{b}}"]
    assert one(spark, X.xml_unescaped(t), t="&amp;lt; &lt;") == "&lt; <"
    assert one(spark, X.dense_length(t), t="a" + chr(0xA0) + " b") == 2
    assert one(spark, X.utf16_length(t), t="a" + chr(0x1F600)) == 3
    assert one(spark, X.plain_lookalikes(t), t="a" + chr(0xA0) + chr(0x2212)) == "a -"
    assert one(spark, X.has_private_use(t), t=chr(0xE001)) and not one(spark, X.has_private_use(t), t="a")
    assert one(spark, X.circled_digits(t), t="".join(map(chr, (0xF080, 0xF081, 0xF08B, 0xF095)))) == "".join(map(chr, (0x24EA, 0x2460, 0x24FF, 0x277F)))
    assert one(spark, X.width_weight(t), t="a" + chr(0xAC00)) == pytest.approx(1.55)
    assert [one(spark, X.line_script(t, F.lit(c)), t=s) for s, c in ((chr(0x3042), 0.9), (chr(0x4E00), 0.9), ("abc", 0.9), ("abc", 0.5), ("12", 0.9), (chr(0x3B1), 0.9))] == ["ja", "han", "la", "other", "other", "gr"]
    assert one(spark, X.needs_thai(t), t=chr(0xE01)) and one(spark, X.needs_vietnamese(t), t=chr(0x1EA1))
    assert [one(spark, X.byte_size(F.col("n")), n=n) for n in (5, 1536, 3 << 20)] == ["5 B", "1.5 KB", "3.00 MB"]
    assert one(spark, X.exif_date(t), t=" 2024:01:02 03:04:05 ") == "2024-01-02 03:04:05"
    assert one(spark, X.js_round(F.col("n")), n=-2.5) == -2
    assert one(spark, X.safe_file_name(t, F.lit(7), "pdf"), t=' a/b:  c.pdf') == "a_b_ c.pdf" and one(spark, X.safe_file_name(t, F.lit(7), "pdf"), t="  ") == "7.pdf"
    assert one(spark, X.font_name(t), t="ABCDEF+Noto Sans-SemiBold").asDict() == {"family": "Noto Sans", "style": "SemiBold", "weight": 600}
    assert [one(spark, X.font_name(t), t=f"A-{s}")["weight"] for s in ("Bold", "ExtraBoldItalic", "UltraLight", "Light", "x")] == [700, 800, 200, 300, 400]
    assert one(spark, X.nearest_weight(F.lit(600), F.array(*map(F.lit, (400, 500, 700))))) == 700
    assert one(spark, X.tags_by_risk(F.array(F.lit("xmp"), F.lit("gps")))) == ["gps", "xmp"]
    assert one(spark, X.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert [one(spark, X.error_code(t), t=m) for m in ("ENOENT", "needs a password", "odd")] == ["NOT_FOUND", "PASSWORD_REQUIRED", "UNREADABLE"]
    assert one(spark, X.metadata_format(F.unhex(t)), t="89504E470D0A1A0A00") == "png"
    full = F.array(*[F.lit(3).cast("long")] * 32)
    assert one(spark, X.bitmap_similarity(full, full)) == 1.0


def test_templates(spark):
    data = spark.sql("select 1 as id, 'A$1' as name, cast(null as string) as note, array(named_struct('n', 'x'), named_struct('n', 'y')) as items union all select 2, 'B', 'k', array()")
    out = {r["id"]: r for r in D.fill_rows(data, "Hi {{name}} {{ note }}\n* {{items.n}}\nend {{other}}", "id", "* {{items.n}}\n", "items").collect()}
    assert out[1]["text"] == "Hi A$1 \n* x\n* y\nend {{other}}" and out[1]["rows_added"] == 1 and out[1]["left"] == ["{{other}}"]
    assert out[2]["text"] == "Hi B k\nend {{other}}" and out[2]["rows_added"] == -1
    names = spark.createDataFrame([(1, "a.pdf"), (2, "a.pdf"), (3, "b.pdf")], "n int, name string")
    assert [r["unique_name"] for r in D.unique_names(names, "name", "n").orderBy("n").collect()] == ["a.pdf", "a-2.pdf", "b.pdf"]


def test_edits_and_checks(spark):
    docs = spark.createDataFrame([(1, "one two\nthree {{x}}"), (2, "two"), (3, None), (4, " ")], "doc_id long, text string")
    found = D.issues(docs, ["two"])
    assert sorted((r["doc_id"], r["code"]) for r in found.collect()) == [(1, "FORBIDDEN_TEXT"), (1, "PLACEHOLDERS_LEFT"), (2, "FORBIDDEN_TEXT"), (3, "NO_TEXT_LAYER"), (4, "NO_TEXT_LAYER")]
    assert {r["doc_id"]: r["passed"] for r in D.passed(docs, found).collect()} == {1: False, 2: False, 3: True, 4: True}
    parts = D.blocks(docs)
    text = {r["doc_id"]: r["text"] for r in D.joined(D.insert_after(parts, 0, ["new"])).collect()}
    assert text[1] == "one two\nnew\nthree {{x}}" and text[2] == "two\nnew"
    gone = D.delete_block(parts, 0)
    assert {r["doc_id"]: r["status"] for r in gone.where("block_no = 0").collect()} == {1: "ok", 2: "RULE", 4: "RULE"}
    out = {r["doc_id"]: r for r in D.fold_operations(docs, [{"find": "two", "replace": "2"}, {"find": "three", "replace": "3"}]).collect()}
    assert (out[1]["ok"], out[1]["text"]) == (True, "one 2\n3 {{x}}") and (out[2]["ok"], out[2]["failed_op"], out[2]["text"]) == (False, 1, "two")
    red = {r["doc_id"]: r for r in D.redact(docs, ["two"]).collect()}
    assert red[1]["redacted"].startswith("one ###") and red[1]["proved"] and red[1]["n_found"] == 1
    runs = spark.createDataFrame([(1, 1, 10.0, 100.0, 60.0, 10.0, "abcabc")], "doc_id long, page int, x double, baseline double, w double, size double, text string")
    boxes = D.redaction_boxes(runs, spark.createDataFrame([("bc",)], "phrase string")).orderBy("x0").collect()
    assert [(round(b["x0"], 3), round(b["x1"], 3)) for b in boxes] == [(17.5, 42.5), (47.5, 72.5)]


def test_layout(spark):
    rows = []
    for i, line in enumerate([[("Name", 10), ("Qty", 100)], [("ab", 12), ("1", 104)], [("cd", 10), ("2", 100)], [("tail", 10)]]):
        rows += [(1, 1, float(x), 20.0 * i + (0.5 if x > 50 else 0.0), 6.0 * len(t), 10.0, t) for t, x in line]
    rows.append((1, 1, 36.0, 60.2, 12.0, 10.0, "end"))
    runs = spark.createDataFrame(rows, "doc_id long, page int, x double, y double, width double, size double, text string")
    lines = L.lines(runs).orderBy("line_no").collect()
    assert [r["text"] for r in lines] == ["Name\tQty", "ab\t1", "cd\t2", "tail end"]
    table = L.tables(L.lines(runs)).collect()
    assert [(r["first_line"], r["last_line"], r["columns"]) for r in table] == [(0, 2, [10.0, 100.0])]
    columns = spark.createDataFrame([(1, 1, 0, 10.0), (1, 1, 1, 100.0)], "doc_id long, page int, col_idx int, x double")
    snapped = {(r["line_no"], r["col_idx"]): r["text"] for r in L.snapped(L.cells(runs), columns).collect()}
    assert snapped[(1, 1)] == "1" and snapped[(1, 0)] == "ab"
    late = runs.union(spark.createDataFrame([(1, 1, 10.0, 140.0, 30.0, 16.0, "Big")], runs.schema))
    assert [(r["text"], r["heading"]) for r in L.paragraphs(L.lines(late)).orderBy("first_line").collect()][1:] == [("Big", True)]
    glyphs = runs.select("doc_id", "page", "x", "y", "size", "text")
    assert "cd" in {r["text"][:2] for r in L.svg_lines(glyphs).collect()}


def test_geometry(spark):
    items = spark.createDataFrame([("f", 0, i, "line", "L", float(i % 10), float(i // 10), float(i % 10) + 0.5, float(i // 10) + 0.5, f"t{i}") for i in range(100)], "file string, sheet int, item_no long, kind string, layer string, x0 double, y0 double, x1 double, y1 double, text string")
    rects = spark.createDataFrame([("f", 0, 0.0, 0.0, 6.0, 4.5), ("f", 0, 0.0, 5.0, 14.0, 15.0), ("f", 0, 1.0, 1.0, 5.0, 4.0), ("f", 0, 0.0, 0.0, 50.0, 1.0)], "file string, sheet int, x0 double, y0 double, x1 double, y1 double")
    got = G.frames(rects, items).orderBy("frame_no").collect()
    assert [(r["frame_no"], r["y0"], r["n_items"]) for r in got] == [(1, 5.0, 50), (2, 0.0, 30)]
    svg = G.sheet_svg(items.where("item_no < 2")).first()["svg"]
    assert svg.startswith('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 -0.5 1.5 0.5">') and svg.count("<line") == 2
    points = spark.createDataFrame([(1, 1, 1, 5.0, 5.0)], "point_id int, doc_id long, page int, px double, py double")
    runs = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 4.0, 4.0, 2.0, 2.0), (1, 1, 3, 50.0, 50.0, 1.0, 1.0)], "doc_id long, page int, run_no int, x double, y double, w double, h double")
    assert G.run_under_point(runs, points, 3.0).first()["run_no"] == 2
    assert one(spark, G.polygon_area(F.array(*map(F.lit, (0.0, 0.0, 4.0, 0.0, 4.0, 3.0, 0.0, 3.0))))) == 12.0


def test_ranking_and_dates(spark):
    bits = lambda v: [v] * 32
    seen = spark.createDataFrame([("a", bits(3)), ("b", bits(12))], "char string, seen array<long>")
    faces = spark.createDataFrame([("F", "a", bits(3)), ("F", "b", bits(12)), ("G", "a", bits(3))], "face string, char string, bits array<long>")
    assert {r["face"]: r["score"] for r in R.face_scores(seen, faces).collect()} == {"F": 1.0}
    assert [one(spark, R.sheet_date(F.col("n")), n=n) for n in (45292.0, 45292.5, 0.25)] == ["2024-01-01", "2024-01-01 12:00:00", "06:00:00"]
    assert one(spark, R.confidence(F.lit(0.9), F.lit(0.05))) == "high"


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a bad word"), (2, "fine")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = ingest.checked(ingest.stream_rows(spark, str(tmp_path / "in"), "doc_id long, text string"), ["bad"])
    ingest.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r["doc_id"]: r["passed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True}
    (tmp_path / "files").mkdir()
    (tmp_path / "files/x.html").write_text("<p>hi</p>")
    q = ingest.stream_files(spark, str(tmp_path / "files")).select("path", "kind").writeStream.format("memory").queryName("seen_files").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["kind"] for r in spark.table("seen_files").collect()] == ["web"]


def test_many_phrases_are_boxed(spark):
    text = "ab abc x"
    runs = spark.createDataFrame([(1, 1, 0.0, 10.0, 80.0, 10.0, text), (2, 1, 0.0, 10.0, 0.0, 10.0, "")], "doc_id long, page long, x double, baseline double, w double, size double, text string")
    phrases = [(f"zz{i}",) for i in range(12_000)] + [("ab",), ("abc x",), ("x",), ("nothing",), ("",)]
    got = D.redaction_boxes(runs, spark.createDataFrame(phrases, "phrase string")).groupBy("phrase").count().collect()
    assert {r["phrase"]: r["count"] for r in got} == {"ab": 2, "abc x": 1, "x": 1}
