import email.message
import io
import struct
import zipfile
import zlib

import numpy as np
import pytest

from quillspark.sources import cad, files, formats, markup, sinks

W = formats.W[1:-1]


def docx(body, extra=()):
    return formats.write_zip([("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'.encode()), *extra])


def frame(spark, *contents):
    return spark.createDataFrame([(f"/f/{i}", c) for i, c in enumerate(contents)], "path string, content binary")


def test_docx_blocks_cells_and_failures(spark):
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Hello {{cus</w:t></w:r><w:r><w:t>tomer}}</w:t></w:r></w:p>'
        '<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr>'
        '<w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>'
    )
    f = frame(spark, docx(body, [("word/header1.xml", f'<w:hdr xmlns:w="{W}"><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>'.encode())]), b"PK broken", b"")
    rows = files.docx_blocks(f).orderBy("path", "block_no").collect()
    assert [(r["kind"], r["text"]) for r in rows if r["ok"]] == [("heading", "Title"), ("paragraph", "Hello {{customer}}"), ("table", ""), ("paragraph", "new")]
    assert sorted(r["code"] for r in rows if not r["ok"]) == ["EMPTY", "UNREADABLE"]
    cells = {(r["row_idx"], r["col_idx"]): (r["row_span"], r["text"]) for r in files.docx_cells(f).where("ok").collect()}
    assert cells == {(0, 0): (2, "a|b"), (0, 1): (1, "x"), (1, 1): (1, "y")}
    facts = files.docx_facts(f).where("ok").first()
    assert (facts["n_tables"], facts["n_merged"], facts["tracked"], facts["parts"]) == (1, 1, True, "Head")
    assert files.docx_markdown(f).where("ok").first()["text"].startswith("## Title\n\nHello {{customer}}\n\n| a\\|b | x |\n| --- | --- |")


def test_written_office_files_read_back(spark):
    rows = spark.createDataFrame([("a", "S1", 0, ["name", "qty"]), ("a", "S1", 1, ["x<&>", "3"]), ("a", "S2", 0, [None, "z"])], "file string, sheet string, row_no int, values array<string>")
    made = sinks.xlsx_files(rows).withColumnRenamed("file", "path")
    got = {(r["sheet"], r["row_idx"], r["col_idx"]): r["value"] for r in files.xlsx_cells(made).collect()}
    assert got == {("S1", 0, 0): "name", ("S1", 0, 1): "qty", ("S1", 1, 0): "x<&>", ("S1", 1, 1): "3", ("S2", 0, 1): "z"}
    blocks = spark.createDataFrame([(1, 0, "heading", "T"), (1, 1, "paragraph", "p & q"), (1, 2, "list", None)], "doc_id long, block_no int, kind string, text string")
    back = files.docx_blocks(sinks.docx_files(blocks).withColumnRenamed("doc_id", "path")).orderBy("block_no").collect()
    assert [(r["kind"], r["text"]) for r in back] == [("heading", "T"), ("paragraph", "p & q"), ("list", "")]
    text = sinks.csv_text(rows.select("file", "row_no", "values").where("sheet = 'S1'")).first()["text"]
    assert text == chr(0xFEFF) + "name,qty\r\nx<&>,3"


@pytest.mark.parametrize("text,codec,name", [
    ("이름, 부서, 연락처 가나다", "cp949", "euc-kr"), ("plain é text", "utf-8", "utf-8"), ("日本語のテキストです。かなが多い", "cp932", "shift_jis"), ("x", "utf-16-le", "utf-16le"),
])
def test_decoding(text, codec, name):
    data = (b"\xff\xfe" if codec == "utf-16-le" else b"") + text.encode(codec)
    got = formats.decode_bytes(data, hint="ja" if name == "shift_jis" else "ko")
    assert got[:2] == (text, name)
    assert formats.decode_bytes(text.encode(codec), forced=name)[0] == text


def test_delimited_and_json(spark):
    f = frame(spark, "이름,부서\n홍길동,영업\n , \n".encode("cp949"))
    rows = files.delimited_rows(f).orderBy("row_no").collect()
    assert [(r["row_no"], list(r["values"]), r["encoding"]) for r in rows] == [(0, ["이름", "부서"], "euc-kr"), (1, ["홍길동", "영업"], "euc-kr")]


def test_mail(spark):
    m = email.message.EmailMessage()
    m["Subject"], m["From"], m["To"], m["Date"] = "Quote é", "Ann <a@example.com>", "b@example.com, C <c@example.com>", "Mon, 01 Jan 2024 10:00:00 +0900"
    m.set_content("Body text")
    m.add_alternative('<p>Body</p><img src="https://example.com/x.png">', subtype="html")
    m.add_attachment(b"%PDF-1", maintype="application", subtype="pdf", filename="quote.pdf")
    r = files.mails(frame(spark, m.as_bytes())).first()
    assert (r["subject"], r["from"], list(r["to"]), list(r["attachments"]), r["attachment_bytes"], r["remote_images"]) == ("Quote é", "Ann <a@example.com>", ["b@example.com", "C <c@example.com>"], ["quote.pdf"], 6, 1)
    text = markup.mail_text(files.mails(frame(spark, m.as_bytes()))).first()["text"]
    assert text.startswith("Subject: Quote é\nFrom: Ann <a@example.com>\nTo: b@example.com, C <c@example.com>\nDate: ") and text.rstrip().endswith("\n\nBody text")


def png(extra=b""):
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 3, 8, 2, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"\0" * 39)) + chunk(b"IEND", b"")


def exif():
    text = b"ACME\0"
    gps = struct.pack("<H", 2) + struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, 100) + b"\0" * 4
    first = struct.pack("<H", 2) + struct.pack("<HHII", 0x010F, 2, 5, 90) + struct.pack("<HHII", 0x8825, 4, 1, 50) + b"\0" * 4
    block = (b"II*\0" + struct.pack("<I", 8) + first).ljust(50, b"\0") + gps
    return block.ljust(90, b"\0") + text + b"\0" * 5 + struct.pack("<6I", 10, 1, 30, 1, 0, 1)


def test_images_and_metadata(spark):
    app1 = b"Exif\0\0" + exif()
    jpeg = b"\xff\xd8\xff\xe1" + (len(app1) + 2).to_bytes(2, "big") + app1 + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 8, 12) + b"\x03" + b"\0" * 9 + b"\xff\xda\x00\x02data"
    note = b"tEXtnote"
    chunk = (4).to_bytes(4, "big") + note + zlib.crc32(note).to_bytes(4, "big")
    f = frame(spark, jpeg, png(chunk), b"nothing here")
    facts = {r["path"]: (r["format"], r["width"], r["height"]) for r in files.image_facts(f).where("ok").collect()}
    assert facts == {"/f/0": ("jpeg", 12, 8), "/f/1": ("png", 4, 3)}
    meta = {r["key"]: r["value"] for r in files.metadata_rows(f).where("ok").collect()}
    assert meta == {"Make": "ACME", "Lat": "-10.500000"}
    out = {r["path"]: r for r in files.stripped(f).collect()}
    assert list(out["/f/0"]["tags"]) == ["exif"] and b"ACME" not in out["/f/0"]["data"] and bytes(out["/f/0"]["data"]).endswith(b"data")
    assert bytes(out["/f/1"]["data"]) == png() and out["/f/1"]["removed"] == 16 and out["/f/2"]["code"] == "UNSUPPORTED"


def test_html_markdown():
    html = '<html><head><title>t</title></head><body><h2>A <b>b</b></h2><p>x <a href="/u">link</a><br>y</p><ol><li>one<li>two</ol><ul><li>z</ul><blockquote>q</blockquote><table><tr><th>a|b<th>c<tr><td>1</table><div><p> </p><span>s</span></div><script>no()</script></body></html>'
    assert markup.html_markdown(html) == "## A **b**\n\nx [link](/u)  \ny\n\n1. one\n\n2. two\n\n- z\n\n> q\n\n| a\\|b | c |\n| --- | --- |\n| 1 |  |\n\ns"


def test_hwpx_zip_and_sniffing(spark):
    xml = lambda t: f'<s xmlns:hp="h"><hp:p><hp:run><hp:t>{t}</hp:t></hp:run></hp:p></s>'.encode()
    data = formats.write_zip([("Contents/section10.xml", xml("ten")), ("Contents/section2.xml", xml("two"))])
    assert [r["text"] for r in files.hwpx_blocks(frame(spark, data)).orderBy("section").collect()] == ["two", "ten"]
    inner = formats.write_zip([("a.txt", b"hi"), ("in.zip", formats.write_zip([("b.txt", b"ho")]))])
    assert {r["name"]: bytes(r["data"]) for r in files.archive_entries(frame(spark, inner)).collect()} == {"a.txt": b"hi", "in.zip/b.txt": b"ho"}
    kinds = [formats.sniff(x) for x in (b"%PDF-1.4", b"<!DOCTYPE html><p>", b"\0\0", data, png(), b"PK\x03\x04zz", b"From: a\n", b"text")]
    assert kinds == ["pdf", "web", "empty", "hwpx", "png", "damaged", "eml", "text"]


DXF = """0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n0\nLINE\n8\nIN\n10\n0\n20\n0\n11\n1\n21\n0\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES
0\nLINE\n8\nWALLS\n10\n0\n20\n0\n11\n4\n21\n3\n0\nTEXT\n8\nNOTES\n10\n1\n20\n2\n1\nFLOOR PLAN 1F\n0\nMTEXT\n8\nNOTES\n10\n1\n20\n2\n1\n{\\fArial|b0;Bold}\\Pnext
0\nARC\n8\nWALLS\n10\n0\n20\n0\n40\n2\n50\n0\n51\n90\n0\nINSERT\n8\nWALLS\n2\nB\n10\n10\n20\n10\n41\n3\n50\n90\n0\nLINE\n67\n1\n8\nPAPER\n10\n0\n20\n0\n11\n9\n21\n9\n0\nENDSEC\n0\nEOF\n"""


def test_drawings(spark):
    gerber = b"%FSLAX24Y24*%\n%MOIN*%\n%ADD10C,0.01*%\nD10*\nX0Y0D02*\nX10000Y0D01*\nX5000Y5000D03*\nM02*\n"
    drill = b"M48\nMETRIC,LZ\nT01C0.8\n%\nT01\nX010Y020\nM30\n"
    svg = b'<svg xmlns="http://www.w3.org/2000/svg"><rect x="1" y="2" width="3" height="4"/><text x="5" y="6">Hi</text></svg>'
    rows = files.drawing_items(frame(spark, DXF.encode(), gerber, drill, svg, b"zz")).orderBy("path", "item_no").collect()
    dxf = [(r["item_kind"], r["layer"], round(r["x0"], 6), round(r["y0"], 6), round(r["x1"], 6), round(r["y1"], 6), r["text"]) for r in rows if r["path"] == "/f/0"]
    assert dxf == [
        ("line", "WALLS", 0, 0, 4, 3, None), ("text", "NOTES", 1, 2, 1, 2, "FLOOR PLAN 1F"), ("text", "NOTES", 1, 2, 1, 2, "Bold\nnext"), ("arc", "WALLS", 0, 0, 2, 2, None), ("line", "IN", 10, 10, 10, 13, None),
    ]
    g = [(r["item_kind"], round(r["x0"], 3), round(r["x1"], 3)) for r in rows if r["path"] == "/f/1"]
    assert g == [("track", -0.127, 25.527), ("pad", 12.573, 12.827)]
    d = next(r for r in rows if r["path"] == "/f/2")
    assert (d["item_kind"], round(d["x0"], 3), round(d["y0"], 3)) == ("hole", 9.6, 19.6)
    assert [(r["item_kind"], r["text"]) for r in rows if r["path"] == "/f/3"] == [("fill", None), ("text", "Hi")]
    assert [r["code"] for r in rows if r["path"] == "/f/4"] == ["UNSUPPORTED"]


def test_meshes_and_step(spark):
    obj = b"o box\nv 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 2\nf 1 2 3 \\\n4\nf 1 2\nf -4 -3 -2\nf 1 2 99\n"
    facets = np.zeros(2, np.dtype([("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")]))
    facets["v"][0] = [[0, 0, 0], [1, 0, 0], [0, 1, 0]]
    facets["v"][1] = [[1, 1, 5], [1, 0, 0], [0, 1, 0]]
    stl = b"solid lies".ljust(80, b"\0") + struct.pack("<I", 2) + facets.tobytes()
    rows = {r["path"]: r for r in files.mesh_facts(frame(spark, obj, stl)).collect()}
    assert (rows["/f/0"]["element"], rows["/f/0"]["triangles"], rows["/f/0"]["dropped"], rows["/f/0"]["vertices"]) == ("box", 3, 2, 4)
    assert (rows["/f/1"]["triangles"], rows["/f/1"]["vertices"], rows["/f/1"]["z1"]) == (2, 4, 5.0)
    step = b"ISO-10303-21;\nDATA;\n#1=IFCWALL('a;b',#2);\n#2 = IFCSITE ('it''s', $);\nENDSEC;"
    got = [(r["id"], r["type"], r["args"]) for r in files.step_entities(frame(spark, step)).orderBy("id").collect()]
    assert got == [(1, "IFCWALL", "'a;b',#2"), (2, "IFCSITE", "'it''s', $")]


def test_files_from_a_folder(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "b.DOCX").write_bytes(docx("<w:p/>"))
    rows = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in files.read_files(spark, str(tmp_path)).collect()}
    assert rows == {"a.html": "web", "b.DOCX": "docx"}
    with pytest.raises(ValueError, match="BAD_ARGUMENT"):
        files.read_files(spark, "relative/path")
    out = spark.createDataFrame([("x.txt", b"hi")], "name string, content binary")
    assert sinks.write_each(out, str(tmp_path / "out")).first()["ok"] and (tmp_path / "out/x.txt").read_bytes() == b"hi"
    z = sinks.zipped(spark.createDataFrame([(1, "a", b"1"), (1, "b", b"2")], "k int, name string, content binary"), "k").first()
    assert sorted(zipfile.ZipFile(io.BytesIO(z["content"])).namelist()) == ["a", "b"]


def test_unpacked_gzip():
    import gzip

    assert cad.unpacked(gzip.compress(b"x")) == [("", b"x")]


def test_a_drawing_that_is_not_utf8_is_a_row(spark):
    from quillspark.sources import dxf

    body = b"0\nSECTION\n2\nHEADER\n9\n$DWGCODEPAGE\n3\nANSI_949\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nTEXT\n8\n\xb0\xa1\xb3\xaa\n10\n1.5\n0\nENDSEC\n0\nEOF\n"
    files = spark.createDataFrame([("bad", bytearray(body)), ("good", bytearray(body.replace(b"\xb0\xa1\xb3\xaa", b"ok")))], "path string, content binary")
    found = {r["path"]: r["layer"] for r in dxf.entities(files).collect()}
    assert found["good"] == "ok" and set(found["bad"]) == {chr(0xFFFD)}
    assert [tuple(r) for r in dxf.encoding_issues(files).collect()] == [("bad", "ENCODING", "not UTF-8; the file says ANSI_949")]
    assert {r["path"] for r in dxf.units(files).collect()} == {"bad", "good"}


def test_headings_read_only_the_references_of_their_sql(spark, tmp_path):
    import hashlib

    from quillspark.plans import file_queries as Q

    html = "<body><h1>a &lt;b&gt; &amp;lt; &quot;c&quot; &copy; &#65; d&amp</h1><ul><li><a href='/x'>x</a></li></ul></body>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    said = "# a <b> &lt; &quot;c&quot; &copy; &#65; d&amp\n- [x](/x)"
    assert Q.src_page_headings_and_items(spark, str(tmp_path)).first()["code"] == hashlib.md5(said.encode()).hexdigest()
    # The reader by itself reads all that HTML has.
    assert markup.html_blocks(html)[0] == ("heading", '# a <b> &lt; "c" \u00a9 A d&')


def test_template_taken_apart_is_as_filled_row_by_row():
    import random

    draw = random.Random(1)
    body = [("heading", "{{a}} & {{ b }} {{none}}"), ("paragraph", "plain <x>"), ("table", "")]
    made = formats.write_docx(body, [[["h"], ["{{items.p}} of {{a}}", "{{items.q}}"], ["sum {{b}}"]]])
    template = formats.docx_changed(made, lambda text: [], lambda xml: xml.replace("{{items", '{{it</w:t></w:r><w:r><w:t xml:space="preserve">ems'))
    filler = formats.FilledTemplate(template, ["a", "b"], "items", ["p", "q"])
    assert filler.simple
    some = lambda: draw.choice([None, "", "x", "<&>", "{{a}}", "}", "é y"])
    for _ in range(80):
        values, items = {"a": some(), "b": some()}, [{"p": some(), "q": some()} for _ in range(draw.randrange(4))]
        whole, added = formats.docx_filled(template, values, {"items": items})
        assert filler.fill(values, items) == (whole, added, filler._left(whole))
    # A mark whose name a value completes is filled row by row; a row that fills nothing is refused.
    odd = formats.FilledTemplate(formats.write_docx([("paragraph", "{{x{{a}}}}")]), ["a"], None, [])
    assert not odd.simple and odd.fill({"a": "1"}, [])[2] == ["{{x1}}"]
    with pytest.raises(formats.Unreadable):
        formats.FilledTemplate(formats.write_docx([("paragraph", "p")]), ["a"], None, []).fill({"a": "1"}, [])


def test_archives_are_as_zipfile_writes_and_reads_them():
    entries = [("a.xml", b"x" * 500), ("w/ü.xml", b""), ("b", bytes(range(256)) * 9)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    assert formats.write_zip(entries) == out.getvalue() and formats.zip_entries(out.getvalue()) == entries
    plain = formats.write_zip([("a", b"1" * 99), ("b", b"")])
    read = formats._Plain(plain)
    assert {n: read.read(n) for n in read.namelist()} == {"a": b"1" * 99, "b": b""}
    broken = bytearray(plain)
    broken[33] ^= 255
    with pytest.raises((zipfile.BadZipFile, formats.zlib.error)):
        formats._Plain(bytes(broken)).read("a")
    with pytest.raises(ValueError):
        formats._Plain(plain + b"x")


def test_a_filled_docx_is_read_once(spark, tmp_path):
    from quillspark.plans import file_queries as Q

    spark.createDataFrame([(1, "p")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, 2, 3.0)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = Q.tpl_filled_docx_read_again(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("MapInArrow") == 2


def test_headers_that_are_kept_are_as_parsed(monkeypatch):
    m = b"Subject: %s\r\nFrom: %s\r\nTo: b@example.com, =?utf-8?q?J=C3=BCrgen?= <j@example.com>\r\nCc: \"x, y\" <z@e.org>\r\nDate: Thu, 5 Nov 2026 10:00:00 +0900\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nbody\r\n"
    given = [(b"Order 7", b"Customer#000000007 <c7@example.com>"), (b"=?utf-8?b?w6k=?=", b"a@b"), (b" two  blanks", b"A B C <a@b.c.d>"), (b"", b""), (b"x: y\r\n folded", b"\"q\" <q@q.q>, r@r.r"), (b"Re", b"A <a@b.c> "), (b"A", b"A<a@b.c>")]
    mails = [m % x for x in given]
    ours, parsed = [formats.eml_fields(x) for x in mails], []
    monkeypatch.setattr(formats, "_MAIL", formats.email.policy.default)
    for x in mails:
        parsed.append(formats.eml_fields(x))
    assert ours == parsed
    monkeypatch.undo()
    # A second mail with the same headers parses none of them again.
    seen, parse = [], formats._HEADERS
    formats._common_header.cache_clear()
    monkeypatch.setattr(formats, "_HEADERS", lambda *a: seen.append(a) or parse(*a))
    formats.eml_fields(mails[0])
    n = len(seen)
    formats.eml_fields(mails[0])
    assert len(seen) == n <= 4
