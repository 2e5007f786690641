"""Blocks, checks, edits, templates and redaction over document tables: DataFrame in, DataFrame out.

blocks(doc_id, block_no, text) holds a document's paragraphs in order, from 0. An edit is a column transform or a
join on addresses; its check is an aggregate over what was written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources import tables


def blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of a text as blocks; a null text has none."""
    return docs.select(key, F.posexplode(F.split("text", "\n", -1)).alias("block_no", "text"))


def joined(parts: DataFrame, key: str = "doc_id", order: str = "block_no") -> DataFrame:
    """Texts put together again from blocks."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


# --- checks -----------------------------------------------------------------------------------------------


def issues(docs: DataFrame, forbidden: list[str] = (), pages: Column | None = None, expect_pages: int | None = None, tracked: Column | None = None, comments: Column | None = None, empty_fields: Column | None = None, missing_glyphs: Column | None = None, bare_pages: Column | None = None) -> DataFrame:
    """issues(doc_id, severity, code, message) of texts: one pass, one row for each finding.

    empty_fields is an array of names, missing_glyphs a string of characters, bare_pages an array of page numbers.
    """
    text = F.coalesce("text", F.lit(""))
    # Counts are columns of their own, so that a hit is not counted again for its message.
    named = {"_left": X.placeholders(text), "_dense": X.dense_length(text)} | {f"_n{i}": X.count_of(text, p) for i, p in enumerate(forbidden)}
    named |= {f"_{k}": c for k, c in {"pages": pages, "tracked": tracked, "comments": comments, "fields": empty_fields, "glyphs": missing_glyphs, "bare": bare_pages}.items() if c is not None}
    counted = docs.select("doc_id", *(c.alias(k) for k, c in named.items()))
    c = F.col
    one = lambda ok, severity, code, message: F.when(ok, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message")))
    found = [one(F.size("_left") > 0, "error", "PLACEHOLDERS_LEFT", F.concat(F.lit("placeholders not filled: "), F.array_join("_left", " ")))]
    for i, phrase in enumerate(forbidden):
        found.append(one(c(f"_n{i}") > 0, "error", "FORBIDDEN_TEXT", F.concat(F.lit(f'"{phrase}" appears '), c(f"_n{i}").cast("string"), F.lit(" times"))))
    if pages is not None and expect_pages:
        found.append(one((c("_pages") > 0) & (c("_pages") != expect_pages), "error", "PAGE_COUNT", F.concat(c("_pages").cast("string"), F.lit(f" pages, expected {expect_pages}"))))
    if empty_fields is not None:
        found.append(one(F.size("_fields") > 0, "warning", "EMPTY_FIELDS", F.concat(F.lit("fields without a value: "), F.array_join("_fields", ", "))))
    if missing_glyphs is not None:
        found.append(one(F.length("_glyphs") > 0, "warning", "MISSING_GLYPHS", F.concat(F.lit("characters the fonts lack: "), c("_glyphs"))))
    if tracked is not None:
        found.append(one(c("_tracked"), "warning", "TRACKED_CHANGES", F.lit("tracked changes are not settled")))
    if comments is not None:
        found.append(one(c("_comments"), "warning", "COMMENTS", F.lit("comments are left")))
    if bare_pages is not None:
        found.append(one(F.size("_bare") > 0, "info", "PAGES_WITHOUT_TEXT", F.concat(F.lit("pages without text: "), F.array_join(F.transform("_bare", lambda p: p.cast("string")), ", "))))
    found.append(one(c("_dense") == 0, "info", "NO_TEXT_LAYER", F.lit("no text")))
    return counted.select("doc_id", F.explode(F.array_compact(F.array(*found))).alias("i")).select("doc_id", "i.severity", "i.code", "i.message")


def passed(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_issues, passed: passed when no issue is an error."""
    sums = found.groupBy("doc_id").agg(F.count("*").alias("n_issues"), F.count_if(F.col("severity") == "error").alias("errors"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


# --- edits ------------------------------------------------------------------------------------------------


def replace_text(parts: DataFrame, find: str, by: str) -> DataFrame:
    """blocks with text replaced, n_replaced and n_left (0 when the replacement holds the phrase)."""
    new = F.replace("text", F.lit(find), F.lit(by))
    return parts.select("*", X.count_of(F.col("text"), find).alias("n_replaced"), new.alias("_new")).withColumn("text", F.col("_new")).withColumn("n_left", X.left_after(F.col("_new"), find, by)).drop("_new")


def insert_after(parts: DataFrame, block_no: int, lines: list[str]) -> DataFrame:
    """Lines after a block of every document that has it; later blocks move on."""
    n = len(lines)
    moved = parts.withColumn("block_no", F.when(F.col("block_no") > block_no, F.col("block_no") + n).otherwise(F.col("block_no")))
    new = parts.where(F.col("block_no") == block_no).select("doc_id", F.posexplode(F.array(*map(F.lit, lines))).alias("at", "text")).select("doc_id", (F.col("at") + block_no + 1).alias("block_no"), "text")
    return moved.select("doc_id", "block_no", "text").unionByName(new)


def delete_block(parts: DataFrame, block_no: int) -> DataFrame:
    """A block taken out; a document's only block stays, with status RULE."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    marked = parts.withColumn("_n", n)
    kept = marked.where((F.col("block_no") != block_no) | (F.col("_n") == 1))
    status = F.when((F.col("_n") == 1) & (F.col("block_no") == block_no), "RULE").otherwise("ok")
    return kept.select("doc_id", F.when(F.col("block_no") > block_no, F.col("block_no") - 1).otherwise(F.col("block_no")).alias("block_no"), "text", status.alias("status"))


def set_cells(cells: DataFrame, tables: DataFrame, changes: DataFrame) -> DataFrame:
    """The outcome of changes (op_no, doc_id, table_no, row_idx, col_idx, new_text) on cells with spans.

    Outside the table: BAD_ARGUMENT. On a cell that a merged one covers: RULE, with the anchor's place. Else ok.
    """
    sized = changes.join(tables.select("doc_id", "table_no", "n_rows", "n_cols"), ["doc_id", "table_no"], "left")
    c = cells.select(F.col("doc_id").alias("_doc"), F.col("table_no").alias("_table"), F.col("row_idx").alias("anchor_row"), F.col("col_idx").alias("anchor_col"), "row_span", "col_span", "text")
    covers = F.expr("row_idx between anchor_row and anchor_row + row_span - 1 and col_idx between anchor_col and anchor_col + col_span - 1")
    met = sized.join(c, F.expr("doc_id = _doc and table_no = _table") & covers, "left")
    outside = F.col("n_rows").isNull() | (F.col("row_idx") < 0) | (F.col("col_idx") < 0) | (F.col("row_idx") >= F.col("n_rows")) | (F.col("col_idx") >= F.col("n_cols"))
    anchor = (F.col("anchor_row") == F.col("row_idx")) & (F.col("anchor_col") == F.col("col_idx"))
    status = F.when(outside, "BAD_ARGUMENT").when(F.col("anchor_row").isNotNull() & ~anchor, "RULE").otherwise("ok")
    return met.select("op_no", "doc_id", "table_no", "row_idx", "col_idx", "new_text", status.alias("status"), "anchor_row", "anchor_col", F.col("text").alias("old_text"))


def append_row(cells: DataFrame, values: list[str]) -> DataFrame:
    """A row after each table's last, its cells from left to right; a table whose last row has spans is left alone."""
    last = F.max("row_idx").over(Window.partitionBy("doc_id", "table_no"))
    tail = cells.withColumn("_last", last).where("row_idx = _last")
    plain = tail.groupBy("doc_id", "table_no", "_last").agg(F.max(F.greatest("row_span", "col_span")).alias("span")).where("span = 1")
    new = tail.join(plain.select("doc_id", "table_no"), ["doc_id", "table_no"], "left_semi")
    text = F.coalesce(F.get(F.array(*map(F.lit, values)), F.col("col_idx")), F.lit(""))
    new = new.select("doc_id", "table_no", (F.col("row_idx") + 1).alias("row_idx"), "col_idx", "row_span", "col_span", text.alias("text"))
    return cells.select(new.columns).unionByName(new)


def append_row_outcome(cells: DataFrame, row: int | None = None) -> DataFrame:
    """doc_id, table_no, status, plain_row: whether a row (the last by default) can be copied to a table's end.

    A row with merged cells cannot: RULE, with the first row after the head that has none (null if there is none). A row
    that the table has not: BAD_ARGUMENT. Cells that a span from above covers make a row merged as well.
    """
    span = F.sequence(F.col("row_idx"), F.col("row_idx") + F.col("row_span") - 1)
    reached = cells.select("doc_id", "table_no", F.explode(span).alias("row_idx"), (F.greatest("row_span", "col_span") > 1).alias("merged"))
    rows = reached.groupBy("doc_id", "table_no", "row_idx").agg(F.max("merged").alias("merged"))
    wanted = F.max("row_idx") if row is None else F.lit(row)
    each = rows.groupBy("doc_id", "table_no").agg(wanted.alias("_row"), F.collect_list(F.struct("row_idx", "merged")).alias("_rows"))
    own = F.filter("_rows", lambda r: r["row_idx"] == F.col("_row"))
    plain = F.array_min(F.transform(F.filter("_rows", lambda r: (r["row_idx"] > 0) & ~r["merged"]), lambda r: r["row_idx"]))
    status = F.when(F.size(own) == 0, "BAD_ARGUMENT").when(own[0]["merged"], "RULE").otherwise("ok")
    return each.select("doc_id", "table_no", status.alias("status"), F.when(status == "RULE", plain).alias("plain_row"))


def fold_operations(docs: DataFrame, operations: list[dict]) -> DataFrame:
    """doc_id, ok, failed_op, text after an ordered list of replace operations: the first without a hit undoes all.

    Failures are rows, not exceptions; failed_op counts from 0.
    """
    state, failed = F.col("text"), F.lit(None).cast("int")
    out = docs.withColumn("_text", state).withColumn("_failed", failed)
    for i, op in enumerate(operations):
        hit = X.count_of(F.col("_text"), op["find"]) > 0
        out = out.withColumn("_failed", F.when(F.col("_failed").isNull() & ~hit, i).otherwise(F.col("_failed")))
        out = out.withColumn("_text", F.replace("_text", F.lit(op["find"]), F.lit(op["replace"])))
    ok = F.col("_failed").isNull()
    return out.select("doc_id", ok.alias("ok"), F.col("_failed").alias("failed_op"), F.when(ok, F.col("_text")).otherwise(F.col("text")).alias("text"))


# --- templates --------------------------------------------------------------------------------------------


def fill_rows(data: DataFrame, template: str, key: str, repeat: str | None = None, list_column: str | None = None) -> DataFrame:
    """One text for each row of data: scalars into {{name}}, and the `repeat` line once for each item of a list.

    filled keys, what is left and how many lines were added come with it; a null is empty, an empty list takes the
    line away.
    """
    scalars = {c: F.col(c) for c, kind in data.dtypes if not kind.startswith("array")}
    head, mark, tail = template.partition(repeat) if repeat else (template, "", "")
    body = X.filled(head, scalars)
    added = F.lit(0)
    if mark:
        fields = data.schema[list_column].dataType.elementType.names
        lines = F.transform(F.coalesce(F.col(list_column), F.array().cast(data.schema[list_column].dataType)), lambda item: X.filled(mark, {f"{list_column}.{f}": item[f] for f in fields}))
        body = F.concat(body, F.array_join(lines, ""), X.filled(tail, scalars))
        added = F.greatest(F.lit(-1), F.size(F.col(list_column)) - 1)
    return data.select(F.col(key), body.alias("text"), added.alias("rows_added")).withColumn("left", X.placeholders(F.col("text")))


def _past_taken(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """rows (_name, _order, _k) with _k, their turn, made the _k-th number that no taken name of the same stem has.

    The i-th taken number k leaves k - i free ones below it, so it moves every turn beyond these on by one: a running count
    over turns and taken numbers together.
    """
    parts = F.regexp_extract(F.col("name"), r"^(.*)-([1-9][0-9]{0,8})(\.[^.]*)?$", 2).try_cast("int")
    stem = F.regexp_replace("name", r"-[1-9][0-9]{0,8}(\.[^.]*)?$", "$1")
    each = taken.select("name").distinct().select(F.explode(F.array(F.struct(F.col("name").alias("_name"), F.lit(1).alias("_n")), F.struct(stem.alias("_name"), parts.alias("_n")))).alias("t")).select("t.*")
    numbers = each.where("_n >= 1").distinct().join(rows.select("_name").distinct(), "_name", "left_semi").withColumn("_i", F.row_number().over(Window.partitionBy("_name").orderBy("_n")))
    both = rows.select("_name", "_order", F.col("_k").alias("_at"), F.lit(0).alias("_taken")).unionByName(numbers.select("_name", (F.col("_n") - F.col("_i") + 1).alias("_at"), F.lit(1).alias("_taken")), allowMissingColumns=True)
    moved = F.sum("_taken").over(Window.partitionBy("_name").orderBy("_at", F.desc("_taken")).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_k", (F.col("_at") + moved).cast("int")).where("_taken = 0").select("_name", "_order", "_k")


def unique_names(named: DataFrame, name: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """`unique_name`: in order, each row takes its name, or the first of name-2, name-3.. that no earlier row has taken.

    taken (name) are files that are there already: they come before all rows. Rows of one name count up among themselves;
    where a made name meets a name of other rows, the earlier row keeps it and the others of the later row's name move on,
    until no two rows meet. Each round is a few shuffles of narrow rows that are then written, so that no round runs those
    before it again; two rounds are the rule, and there are never more than chains of such meetings.
    """
    rows = named.select(F.col(name).alias("_name"), F.col(order).alias("_order")).distinct().withColumn("_k", F.row_number().over(Window.partitionBy("_name").orderBy("_order")))
    if taken is not None:
        rows = _past_taken(rows, taken)
    rows = tables.written(rows.withColumn("_skip", F.lit(0)), "names")
    made = lambda k: F.when(k == 1, F.col("_name")).otherwise(F.concat(F.regexp_extract("_name", r"^(.*?)(\.[^.]*)?$", 1), F.lit("-"), k.cast("string"), F.regexp_extract("_name", r"^(.*?)(\.[^.]*)?$", 2)))
    along = Window.partitionBy("_name").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        now = rows.withColumn("_made", made(F.col("_k") + F.col("_skip")))
        firsts = now.groupBy("_made").agg(F.min("_order").alias("_first"))
        if taken is not None:
            there = taken.select(F.col("name").alias("_made")).distinct().withColumn("_there", F.lit(True))
            firsts = firsts.join(there, "_made", "left").withColumn("_first", F.when(F.col("_there").isNull(), F.col("_first")))
        meets = (F.col("_first").isNull() | (F.col("_order") > F.col("_first"))).cast("int")
        now = tables.written(now.join(firsts.select("_made", "_first"), "_made").withColumn("_meets", meets), "names")
        if now.where("_meets = 1").isEmpty():
            break
        rows = now.select("_name", "_order", "_k", F.max(F.col("_skip") + F.col("_meets")).over(along).alias("_skip"))
    keyed = now.select("_name", "_order", F.col("_made").alias("unique_name"))
    return named.join(keyed, (F.col(name) == F.col("_name")) & (F.col(order) == F.col("_order"))).drop("_name", "_order")


# --- redaction --------------------------------------------------------------------------------------------


def redact(docs: DataFrame, phrases: list[str], mark: str = "#") -> DataFrame:
    """Phrases masked, with counts before and the proof that none is left."""
    text, found = F.coalesce("text", F.lit("")), F.lit(0)
    masked = text
    for p in phrases:
        found = found + X.count_of(text, p)
        masked = F.replace(masked, F.lit(p), F.lit(mark * len(p)))
    left = sum((X.count_of(F.col("redacted"), p) for p in phrases), F.lit(0))
    return docs.select("doc_id", found.alias("n_found"), masked.alias("redacted")).withColumn("n_left", left).withColumn("proved", F.col("n_left") == 0)


#: Characters of a phrase by which it is filed; shorter phrases are filed whole.
_FILED = 3


def redaction_boxes(runs: DataFrame, phrases: DataFrame, margin: float = 1.0) -> DataFrame:
    """Boxes over each occurrence of a phrase in text runs (x, baseline, w, size, text), by estimated widths.

    Phrases, however many, are filed by their first characters, and a run looks up the pieces of that length that it holds.
    """
    filed = phrases.where("phrase <> ''").select("phrase", F.substring("phrase", 1, _FILED).alias("_piece")).distinct()
    piece = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - n + 1)), lambda i: F.substring(F.col("text"), i, F.lit(n)))
    looked = runs.where("text <> ''").withColumn("_piece", F.explode(F.array_distinct(F.concat(*(piece(n) for n in range(1, _FILED + 1))))))
    hit = looked.join(filed, "_piece").drop("_piece").where("instr(text, phrase) > 0")
    pieces = hit.withColumn("parts", F.expr("split(text, concat('\\\\Q', phrase, '\\\\E'), -1)"))
    at = pieces.select("*", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    before = F.expr("array_join(slice(parts, 1, k), phrase)")
    whole = F.greatest(X.width_weight(F.col("text")), F.lit(1e-9))
    a, b = X.width_weight(before) / whole, X.width_weight(F.concat(before, F.col("phrase"))) / whole
    pad = F.col("size") * 0.15
    return at.select(
        "doc_id", "page", "phrase", (F.col("x") + F.col("w") * a - pad - margin).alias("x0"), (F.col("x") + F.col("w") * b + pad + margin).alias("x1"),
        (F.col("baseline") - F.col("size") * 0.95 - margin).alias("y0"), (F.col("baseline") + F.col("size") * 0.25 + margin).alias("y1"),
    )
