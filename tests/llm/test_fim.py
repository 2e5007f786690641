import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from quillspark.llm import fim

RANDOM_TEXTS = ["", "a", " ", "ab cd", "Zürich 12 — ok\n\n", "x" * 3000, "-" * 700, "😀a😀b", "has <P> inside", "<S>", "ends with <", "<", "<<P", "M>", "word, " * 900, " é\r\n" * 40]


def by_hand(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, d = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_cuts_equal_the_plain_rule(spark):
    rows = [(i * 40 + k, t, "c") for k in range(40) for i, t in enumerate(RANDOM_TEXTS)] + [(None, "null id here", "c"), (None, None, "c"), (5, None, "c"), (5, "same id", "c"), (5, "same id", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for grain in (32, 3):
        made = fim.fill_in_middle(docs, grain)
        got = made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
        assert all(tuple(r)[2:7] == by_hand(r["doc_id"], r["text"]) and r["back"] == r["text"] for r in got)


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({fim.SQL})").fetchall()
    got = [tuple(r) for r in fim.op12_fill_in_middle(spark, sf_dir).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 100


def test_texts_move_once(spark, sf_dir):
    plan = fim.op12_fill_in_middle(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
