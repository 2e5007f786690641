"""Similarity ranking, line fits, pages, layer pairs and sheets: aggregates, windows and joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as X
from ..sources import tables


#: Queries of one block, which a task holds at a time.
QUERY_BLOCK = 256


def cosine_scores(vectors: DataFrame, queries: DataFrame, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, sim of unit vectors against all queries (query_id, query), a block of queries by a part of the vectors at a time."""
    blocks = queries.repartition(max(1, -(-queries.count() // block))).hint("shuffle_replicate_nl")
    return vectors.crossJoin(blocks).select("query_id", "vec_id", "label", X.dot(F.col("embedding"), F.col("query")).alias("sim"))


#: Vectors and queries that a task holds at a time, and by how much a fast product may be off before it is summed again in order.
VECTOR_CHUNK, SEARCH_BLOCK, SLACK = 16_384, 512, 1e-6


def _chunks(vectors: DataFrame, rows: int, tag: str) -> DataFrame:
    """ids, labels, n, flat: vectors (vec_id, label, embedding) by the chunk, written; those without an embedding are left out."""
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"ids array<{ids}>, labels array<{labels}>, flat array<float>"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def pack(batches):
        kept, n = [], 0

        def chunk(table):
            flat = pc.list_flatten(table["embedding"]).combine_chunks()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((table["vec_id"].to_pylist(), table["label"].to_pylist(), flat.to_numpy(zero_copy_only=False)), arrow, strict=True)], schema=arrow)

        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            while n >= rows:
                table = pa.Table.from_batches(kept)
                yield chunk(table[:rows])
                kept, n = table[rows:].to_batches(), n - rows
        if n:
            yield chunk(pa.Table.from_batches(kept))

    return tables.written(vectors.where("embedding is not null").select("vec_id", "label", "embedding").mapInArrow(pack, schema), tag)


def best_vectors(vectors: DataFrame, queries: DataFrame, k: int, by_label: bool = False, chunk: int = VECTOR_CHUNK, block: int = SEARCH_BLOCK) -> DataFrame:
    """query_id, vec_id, label, sim: of all vectors (vec_id, label, embedding) the k best of each query (query_id, query), of each label if asked.

    All pairs are looked at, a chunk of vectors by a block of queries at a time, as products of matrices. These find who
    may be among the best; their sims are then summed in the order of the elements, so that equal vectors tie exactly and
    the smaller vec_id wins. Only the best of a chunk leave their task.
    """
    asked = _chunks(queries.select(F.col("query_id").alias("vec_id"), F.lit(0).alias("label"), F.col("query").alias("embedding")).coalesce(max(1, -(-queries.count() // block))), block, "queries")
    mine = _chunks(vectors, chunk, "vectors").withColumnRenamed("flat", "own")
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {ids}, label {labels}, sim double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                vec, label, asks = (batch.column(c)[i].values for c in ("ids", "labels", "asks"))
                own, other = (batch.column(c)[i].values.to_numpy().reshape(n, -1).astype(float) for c, n in (("own", len(vec)), ("flat", len(asks))))
                group = np.zeros(len(vec), dtype=np.int64) if not by_label else label.dictionary_encode(null_encoding="encode").indices.to_numpy()
                order = np.argsort(group, kind="stable")
                group, own, number = group[order], own[order], vec.to_numpy()[order]
                sims = own @ other.T
                slack = SLACK * max(1.0, np.sqrt((own * own).sum(1).max() * (other * other).sum(1).max()))
                begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                ends = np.r_[begins[1:], len(group)]
                rows, cols = [], []
                for a, b in zip(begins, ends, strict=True):
                    part = sims[a:b]
                    least = np.partition(part, b - a - k, axis=0)[b - a - k] if b - a > k else np.full(len(asks), -np.inf)
                    r, c = np.nonzero(part >= least - slack)
                    rows.append(r + a)
                    cols.append(c)
                r, c = np.concatenate(rows), np.concatenate(cols)
                exact = np.zeros(len(r))
                for j in range(own.shape[1]):
                    exact += own[r, j] * other[c, j]
                best = np.lexsort((number[r], -exact, group[r], c))
                r, c, exact = r[best], c[best], exact[best]
                begin = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (group[r][1:] != group[r][:-1])])
                place = np.arange(len(r)) - np.repeat(begin, np.diff(np.r_[begin, len(r)]))
                r, c, exact = r[place < k], c[place < k], exact[place < k]
                at = pa.array(order[r])
                yield pa.RecordBatch.from_arrays([asks.take(pa.array(c)), vec.take(at), label.take(at), pa.array(exact)], schema=arrow)

    pairs = mine.crossJoin(asked.select(F.col("ids").alias("asks"), "flat").hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(search, schema)


def best_by_family(scores: DataFrame, family: str = "label") -> DataFrame:
    """The best member of each family for each query, ties to the smaller id."""
    best = F.max_by(F.struct("vec_id", "sim"), F.struct("sim", (-F.col("vec_id")).alias("o")))
    return scores.groupBy("query_id", family).agg(best.alias("b")).select("query_id", family, "b.vec_id", "b.sim")


def top_k(ranked: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query by sim, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_unit_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """The mean of each group's vectors, scaled to unit length."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("v"))
    rows = F.array_sort(F.collect_list(F.struct("i", "v")))
    mean = parts.groupBy(key).agg(F.transform(rows, lambda r: r["v"]).alias("mean"))
    norm = F.sqrt(X.dot(F.col("mean"), F.col("mean")))
    return mean.select(key, F.transform("mean", lambda v: F.when(norm > 0, v / norm).otherwise(0.0)).alias("mean"))


def line_fit(x: Column, y: Column) -> Column:
    """struct(slope, intercept) of least squares; below three points or without spread, the mean."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    flat = (n < 3) | (F.var_pop(x) * n < 1e-9)
    return F.struct(F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias("slope"), F.when(flat, F.avg(y)).otherwise(F.regr_intercept(y, x)).alias("intercept"))


def confidence(score: Column, margin: Column) -> Column:
    return F.when((score >= 0.85) & (margin >= 0.02), "high").when(score >= 0.7, "mid").otherwise("low")


#: Observed glyphs up to which they are broadcast to the faces.
MOST_OBSERVED = 20_000


def face_scores(observations: DataFrame, faces: DataFrame, coverage: float = 0.7) -> DataFrame:
    """Mean similarity of each face over the characters observed, of faces that cover enough of them."""
    n = observations.agg(F.count_distinct("char").alias("n"))
    small = observations.count() <= MOST_OBSERVED
    hit = faces.join(F.broadcast(observations) if small else observations, "char").select("face", "char", X.bitmap_similarity(F.col("bits"), F.col("seen")).alias("sim"))
    out = hit.groupBy("face").agg(F.avg("sim").alias("mean"), F.count_distinct("char").alias("covered")).join(F.broadcast(n))
    share = F.col("covered") / F.col("n")
    return out.where(share >= coverage).select("face", (F.col("mean") * (0.9 + 0.1 * share)).alias("score"), "covered")


# --- pages ------------------------------------------------------------------------------------------------


def select_pages(pages: DataFrame, order: list[int], key: str = "doc_id") -> DataFrame:
    """Pages in a requested order, which may repeat and drop; a page that does not exist fails the document's row with BAD_ARGUMENT."""
    spark = pages.sparkSession
    wanted = spark.sql("select * from values " + ", ".join(f"({i + 1}, {p})" for i, p in enumerate(order)) + " as t(new_page, page)")
    have = pages.groupBy(key).agg(F.max("page").alias("n_pages"))
    asked = have.join(F.broadcast(wanted))
    return asked.join(pages, [key, "page"], "left").withColumn("status", F.when(F.col("page") > F.col("n_pages"), "BAD_ARGUMENT").otherwise("ok"))


def split_pages(pages: DataFrame, cuts: list[int]) -> DataFrame:
    """part_no of pages: a part begins at page 1 and at each cut above 1."""
    starts = sorted({c for c in cuts if c > 1})
    return pages.withColumn("part_no", F.lit(1) + sum((F.when(F.col("page") >= c, 1).otherwise(0) for c in starts), F.lit(0)))


def merge_pages(parts: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Pages of several tables in turn, numbered through for each document."""
    out = None
    for i, p in enumerate(parts):
        part = p.withColumn("_part", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("page", F.row_number().over(Window.partitionBy(key).orderBy("_part", "page"))).drop("_part")


def rotated(angle: Column, by: int) -> Column:
    return F.pmod(angle + by, F.lit(360))


def headings_forward(pages: DataFrame, documents: DataFrame, key: str = "binder") -> DataFrame:
    """Each page with the name of the document that begins at or before it (documents: binder, name, first_page)."""
    marked = pages.join(documents.withColumnRenamed("first_page", "page"), [key, "page"], "left")
    return marked.withColumn("document", F.last("name", True).over(Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, key: str, order: str, gap: float, number: str = "island") -> DataFrame:
    """Rows numbered by island: a new one where the order column jumps by more than the gap."""
    w = Window.partitionBy(key).orderBy(order)
    jump = F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumn("_j", jump).withColumn(number, F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def collapse_repeats(steps: DataFrame, key: str, order: str, symbol: str, blank: int) -> DataFrame:
    """Best-path decoding: repeats run together, blanks dropped."""
    w = Window.partitionBy(key).orderBy(order)
    return steps.withColumn("_p", F.lag(symbol).over(w)).where((F.col(symbol) != blank) & (F.col("_p").isNull() | (F.col("_p") != F.col(symbol)))).drop("_p")


# --- layer pairs and sheets -------------------------------------------------------------------------------


def paired_layers(a: DataFrame, b: DataFrame, board: str = "board") -> DataFrame:
    """board, a_no, b_no, by: the layers (board, layer_no, function, name, file) of two versions of each board in pairs; leftovers stand alone.

    In the order of A, each layer takes the first of B that is left with its function, else with its name, else with its
    file. Boards are dealt out. What a layer finds depends on all before it, so a task goes through a board's layers in
    order; each of B waits in three queues, by function, name and file, and is passed over once in each when it is taken.
    """
    kinds, names = ("function", "name", "file"), ["layer_no", "function", "name", "file"]
    key, kind = (df.schema[c].dataType for df, c in ((a, board), (a, "layer_no")))
    schema = StructType([StructField(board, key), StructField("a_no", kind), StructField("b_no", kind), StructField("by", StringType())])
    arrow = to_arrow_schema(schema)

    def pair(group: pa.Table) -> pa.Table:
        sides = []
        for side in (0, 1):
            own = group.filter(pc.equal(group["_side"], side))
            rows = zip(*(own[c].to_pylist() for c in names), strict=True)
            sides.append(sorted(rows, key=lambda r: [(v is not None, v) for v in r]))
        at = group[board][0].as_py()
        queues, taken = {k: {} for k in kinds}, set()
        for row in reversed(sides[1]):  # so that the first is the last of its list, where it is taken from
            for k, v in zip(kinds, row[1:], strict=True):
                if v is not None and row[0] is not None and at is not None:
                    queues[k].setdefault(v, []).append(row[0])
        out = []
        for no, *said in sides[0]:
            for k, v in zip(kinds, said, strict=True):
                waiting = queues[k].get(v, [])
                while waiting and waiting[-1] in taken:
                    waiting.pop()
                if waiting:
                    taken.add(waiting[-1])
                    out.append((no, waiting.pop(), k))
                    break
            else:
                out.append((no, None, "only_a"))
        out += [(None, row[0], "only_b") for row in sides[1] if row[0] not in taken]
        columns = [[at] * len(out), *([r[i] for r in out] for i in range(3))]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    own = lambda df, side: df.select(board, *names, F.lit(side).alias("_side"))
    return own(a, 0).unionByName(own(b, 1)).groupBy(board).applyInArrow(pair, schema)


def sheet_json(rows: DataFrame, header: list[str]) -> DataFrame:
    """file, json lines of sheet rows (file, row_no, values): blank header names become col<i>, missing values null."""
    names = [h.strip() or f"col{i + 1}" for i, h in enumerate(header)]
    record = F.to_json(F.struct(*(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(names))), {"ignoreNullFields": "false"})
    return rows.where(F.exists("values", lambda v: v.isNotNull() & (F.trim(v) != ""))).select("file", "row_no", record.alias("json"))


def sheet_date(serial: Column) -> Column:
    """Text of a spreadsheet's serial date, a time alone below 1.

    Serials count days from 1899-12-30, and from a day later before serial 60, which stands for a 29 February 1900 that
    never was. The whole serial is rounded to seconds first, so a last half second goes over to the next day.
    """
    total = F.floor(serial * 86400 + 0.5)
    days, seconds = F.floor(total / 86400).cast("int"), F.pmod(total, F.lit(86400))
    time = F.date_format(F.timestamp_seconds(seconds), "HH:mm:ss")
    date = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days + F.when(days < 60, 1).otherwise(0)), "yyyy-MM-dd")
    day = F.when(days == 60, "1900-02-29").otherwise(date)
    return F.when(days < 1, time).when(seconds > 0, F.concat(day, F.lit(" "), time)).otherwise(day)


def board_facts(objects: DataFrame) -> DataFrame:
    """Facts of a board from objects (file, kind, plated, w, x0, y0, x1, y1, net): size, holes, sizes, least hole and track, nets."""
    hole, track = F.col("kind") == "hole", F.col("kind") == "track"
    return objects.groupBy("file").agg(
        (F.max("x1") - F.min("x0")).alias("width"), (F.max("y1") - F.min("y0")).alias("height"), F.count_if(hole).alias("holes"), F.count_if(hole & F.col("plated")).alias("plated"),
        F.count_distinct(F.when(hole, F.round(F.col("w") * 1000))).alias("drill_sizes"), F.min(F.when(hole, F.col("w"))).alias("least_hole"), F.min(F.when(track, F.col("w"))).alias("least_track"),
        F.count_distinct("net").alias("nets"),
    )
