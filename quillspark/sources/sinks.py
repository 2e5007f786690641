"""Sinks: CSV with a byte order mark, JSON records, XLSX and DOCX files, one output for each row, outputs read again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import formats

_BOM = chr(0xFEFF)


def csv_text(rows: DataFrame, key: str = "file") -> DataFrame:
    """key, text: rows (key, row_no, values) as one CSV with a byte order mark."""
    cell = lambda v: F.when(v.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(v, F.lit("")))
    line = F.array_join(F.transform("values", cell), ",")
    parts = F.array_sort(F.collect_list(F.struct("row_no", line.alias("line"))))
    return rows.groupBy(key).agg(F.concat(F.lit(_BOM), F.array_join(F.transform(parts, lambda p: p["line"]), "\r\n")).alias("text"))


def xlsx_files(rows: DataFrame, key: str = "file") -> DataFrame:
    """key, content: an XLSX for each key from rows (key, sheet, row_no, values)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        sheets = [(str(n), [list(v) for v in g.sort_values("row_no")["values"]]) for n, g in pdf.groupby("sheet", sort=True)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [formats.write_xlsx(sheets)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(build, f"{key} {kind}, content binary")


def docx_files(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: a DOCX for each key from blocks (key, block_no, kind, text)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("block_no")
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [formats.write_docx(list(zip(rows["kind"], rows["text"].fillna(""), strict=True)))]})

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.groupBy(key).applyInPandas(build, f"{key} {kind}, content binary")


def zipped(files: DataFrame, key: str) -> DataFrame:
    """key, content: an archive of each key's (name, content) rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [formats.write_zip([(n, bytes(c)) for n, c in zip(pdf["name"], pdf["content"], strict=True)])]})

    kind = files.schema[key].dataType.simpleString()
    return files.groupBy(key).applyInPandas(build, f"{key} {kind}, content binary")


def output_name(path: Column, ext: str, suffix: str = "") -> Column:
    """stem.ext or stem-suffix.ext beside the source, and never the source itself."""
    stem = F.regexp_replace(path, r"\.[^./]*$", "")
    name = F.concat(stem, F.lit(f"-{suffix}.{ext}" if suffix else f".{ext}"))
    return F.when(name == path, F.concat(stem, F.lit(f"-new.{ext}"))).otherwise(name)


def write_each(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files of a folder that executors share, read each again, and say what was written.

    Names may hold folders below the given one; where two rows have one name, the first by content is written and the
    others say NOT_APPLIED, so no file is overwritten by another row.
    """
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64("content"), "content"))
    rows = files.select("name", "content", turn.alias("turn"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for batch in batches:
            out = []
            for name, content, n in zip(batch["name"], batch["content"], batch["turn"], strict=True):
                target, said, fine = os.path.normpath(os.path.join(folder, name)), None, False
                try:
                    if n > 1:
                        raise OSError("another row has this name")
                    if not target.startswith(os.path.normpath(folder) + os.sep):
                        raise OSError("the name leads out of the folder")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target + ".part", "wb") as f:
                        f.write(content)
                    os.replace(target + ".part", target)
                    with open(target, "rb") as f:
                        fine = f.read() == bytes(content)
                    said = None if fine else "VERIFY_FAILED"
                except OSError as e:
                    said = f"NOT_APPLIED: {e}"
                out.append((name, fine, said, len(content)))
            yield pd.DataFrame(out, columns=["name", "ok", "message", "bytes"])

    return rows.mapInPandas(run, "name string, ok boolean, message string, bytes long")


def docx_tables(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, content: a DOCX for each key with its tables, from cells (key, table_no, row_idx, col_idx, text) without spans."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for _, t in pdf.sort_values(["table_no", "row_idx", "col_idx"]).groupby("table_no", sort=True):
            tables.append([["" if x is None else x for x in r["text"]] for _, r in t.groupby("row_idx", sort=True)])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [formats.write_docx([("table", "")] * len(tables), tables)]})

    kind = cells.schema[key].dataType.simpleString()
    return cells.groupBy(key).applyInPandas(build, f"{key} {kind}, content binary")
