"""HTML to markdown and blocks, and the properties of HWPX and PDF files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

class _Writer(HTMLParser):
    """Markdown blocks from the events of a page: start tags open blocks and marks, end tags and new blocks close them.

    A block's text is gathered in `text`; `marks` holds what is open inside it, with the place where it began. Scripts,
    styles and the head are left out; a mark without text vanishes, and one left open ends with its block.
    """

    WRAPS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}
    HIDDEN = {"script", "style", "head"}
    #: Tags that are part of a line of text; any other ends the block before it.
    INLINE = {*WRAPS, "a", "br", "img", "span", "small", "u", "sub", "sup", "font", "label", "abbr", "mark"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str]] = []
        self.hidden, self.kind, self.lead, self.text, self.marks, self.lists = 0, "paragraph", "", [], [], []
        self.rows: list[list[str]] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if self.hidden:
            return
        own = dict(attrs)
        if tag == "br":
            self.text.append("  \n")
        elif tag == "img":
            self.text.append(f"![{own.get('alt') or ''}]({own.get('src') or ''})")
        elif tag in self.WRAPS or tag == "a":
            self.marks.append((tag, own.get("href"), len(self.text)))
        elif tag in self.INLINE:
            return
        elif self.rows is not None and tag in ("td", "th"):
            self.cell()
            self.rows[-1].append("")
            self.kind = "cell"
        elif self.rows is not None and tag == "tr":
            self.cell()
            self.rows.append([])
        elif self.kind in ("list", "quote", "cell") and tag in ("p", "div"):
            self.text.append(" ")
        else:
            self.begin(tag)

    def begin(self, tag):
        self.finish()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            place = self.lists[-1] if self.lists else ["ul", 0]
            place[1] += 1
            self.kind, self.lead = "list", f"{place[1]}. " if place[0] == "ol" else "- "
        elif tag == "blockquote":
            self.kind, self.lead = "quote", "> "
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.kind, self.lead = "heading", "#" * int(tag[1]) + " "
        elif tag == "table" and self.rows is None:
            self.rows = []

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in self.WRAPS or tag == "a":
            if any(m[0] == tag for m in self.marks):
                while self.close_mark() != tag:
                    pass
        elif tag == "table" and self.rows is not None:
            self.cell()
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                lines.insert(1, "| " + " | ".join(["---"] * width) + " |")
                self.blocks.append(("table", "\n".join(lines)))
        elif tag in ("td", "th", "tr") and self.rows is not None:
            self.cell()
        elif tag not in self.INLINE and self.kind != "cell" and not (self.kind in ("list", "quote") and tag in ("p", "div")):
            self.finish()
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def close_mark(self):
        tag, href, at = self.marks.pop()
        inner = "".join(self.text[at:])
        if tag == "a":
            inner = f"[{inner}]({href})" if href else inner
        elif tag == "code" or inner.strip():
            inner = self.WRAPS[tag] + inner + self.WRAPS[tag]
        else:
            inner = ""
        self.text[at:] = [inner]
        return tag

    def taken(self) -> str:
        while self.marks:
            self.close_mark()
        said, self.text = "".join(self.text).strip(), []
        return said

    def cell(self):
        said = " ".join(self.taken().split()).replace("|", "\\|")
        if self.kind == "cell" and self.rows and self.rows[-1]:
            self.rows[-1][-1] = said
        self.kind = "paragraph"

    def finish(self):
        kind, lead, said = self.kind, self.lead, self.taken()
        self.kind, self.lead = "paragraph", ""
        if said:
            self.blocks.append((kind, lead + said))


def _only(references: tuple[str, ...], html: str) -> str:
    """A page in which the named references that end with a semicolon are read, and the & of any other stands for itself."""
    return re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)", "&amp;", html)


def html_blocks(html: str, references: tuple[str, ...] | None = None) -> list[tuple[str, str]]:
    """(kind, markdown) of the blocks of a page in order. References are read as HTML has them, or only those named (amp must be one)."""
    writer = _Writer()
    writer.feed(html if references is None else _only(references, html))
    writer.close()
    writer.finish()
    return writer.blocks


def html_markdown(html: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join(b for _, b in html_blocks(html))).strip()


def markdown_of(html: Column) -> Column:
    """Pages to markdown, in Arrow batches."""

    @F.pandas_udf("string")
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda h: html_markdown(h) if h is not None else None)

    return convert(html)


def page_blocks(pages: DataFrame, references: tuple[str, ...] | None = None) -> DataFrame:
    """page_id, block_no, kind, text of pages(page_id, html); references as in html_blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, k, t) for p, h in zip(batch["page_id"], batch["html"], strict=True) for i, (k, t) in enumerate(html_blocks(h or "", references))]
            yield pd.DataFrame(rows, columns=["page_id", "block_no", "kind", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, block_no int, kind string, text string")


def stripped_html(html: Column) -> Column:
    """Tags taken out in a fixed order: style, br, paragraph ends, tags, entities, blank lines. Native."""
    for pattern, by in (
        (r"(?is)<style.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (r"\n{3,}", "\n\n"),
    ):
        html = F.regexp_replace(html, pattern, by)
    return F.regexp_replace(html, r"^\s+|\s+$", "")


def mail_text(mails: DataFrame) -> DataFrame:
    """path, text: header lines, a blank line, and the text body or the stripped HTML."""
    head = F.concat_ws(
        "\n", F.concat(F.lit("Subject: "), "subject"), F.concat(F.lit("From: "), "from"), F.concat(F.lit("To: "), F.array_join("to", ", ")),
        F.when(F.size("cc") > 0, F.concat(F.lit("Cc: "), F.array_join("cc", ", "))), F.concat(F.lit("Date: "), "date"), F.lit(""), F.lit(""),
    )
    body = F.when(F.length("text") > 0, F.col("text")).otherwise(stripped_html(F.col("html")))
    return mails.select("path", F.concat(head, body).alias("text"))


def headings(html: Column) -> Column:
    """struct(level, text) of h1 to h6, native."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>.*?</h\1>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.regexp_extract(h, r"(?is)^<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace(h, r"<[^>]+>", "")).alias("text")))


def links(html: Column) -> Column:
    """href values of anchors, native."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def hwpx_properties(data: bytes) -> dict[str, str]:
    out = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for part in ("Contents/content.hpf", "version.xml"):
            if part in z.namelist():
                for e in ET.fromstring(z.read(part)).iter():
                    name = e.tag.rpartition("}")[2]
                    if name in ("title", "language", "creator", "description"):
                        out[name] = (e.text or "").strip()
                    elif name == "meta" and e.get("name") and (e.text or e.get("content")):
                        out[e.get("name")] = (e.text or e.get("content")).strip()
                    elif name == "HCFVersion":
                        out["version"] = e.get("appVersion", "") or e.get("major", "")
    return {k: v for k, v in out.items() if v}


def pdf_info(data: bytes) -> dict[str, str]:
    """Plain document properties of a PDF: pages, first size in millimetres, encryption, information entries."""
    out = {"encrypted": str(b"/Encrypt" in data[-4096:]).lower(), "pages": str(len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data)))}
    box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", data)
    if box:
        x0, y0, x1, y1 = map(float, box.groups())
        out["size_mm"] = f"{int((x1 - x0) / 72 * 25.4 + 0.5)} x {int((y1 - y0) / 72 * 25.4 + 0.5)}"
    for key in ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate"):
        m = re.search(rb"/" + key.encode() + rb"\s*\(((?:\\.|[^\\)])*)\)", data)
        if m:
            raw = re.sub(rb"\\(.)", rb"\1", m[1])
            out[key] = raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")
    return out
