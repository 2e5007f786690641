"""Exact deduplication by content-defined chunk recipes.

A text is normalised (all of [\\x20\\x09-\\x0D] deleted), cut where a rolling hash of its last 16 bytes
has a given pattern, and described by the ordered list of its chunks. A chunk's short fingerprint becomes an
identifier only after it is verified: chunks under one fingerprint with another length or SHA-256 get another
variant number. Two texts are equal when their identifier lists are. Only fingerprints and digests move, never
the text, so long documents cost a few dozen bytes a kilobyte in each shuffle.

Defined cases: a null text counts as empty; an empty text has an empty recipe and equals every other empty
text; of rows that repeat a doc_id with equal text one is kept; an empty table gives an empty result. Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import IS_SPACE, code_points, columns_of, flat_text, materialize, rows_of, splitmix

#: A cut falls after a byte where the low bits of the rolling hash are zero: 1 in 2**MASK_BITS bytes on average.
MASK_BITS = 10
#: Without a cut for so long, one is made; a cut so soon after the last is not made.
LONGEST, SHORTEST = 8192, 128

RECIPE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_code_points", T.LongType()),
    T.StructField("text_sha256", T.BinaryType()),
    T.StructField("chunks", T.ArrayType(T.StructType([
        T.StructField("fp", T.LongType()), T.StructField("len", T.IntegerType()), T.StructField("sha", T.BinaryType())
    ]))),
])
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_code_points", pa.int64()), ("text_sha256", pa.binary()),
    ("chunks", pa.list_(pa.struct([("fp", pa.int64()), ("len", pa.int32()), ("sha", pa.binary())]))),
])
_GEAR = (splitmix(256, 11) >> np.uint64(16)).astype(np.uint32)


def candidate_cuts(data: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Positions after which the hash of the 16 bytes up to there ends in mask_bits zero bits."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h << np.uint32(step)
        h[step:] += shifted[:-step]
    return np.flatnonzero((h >> np.uint32(16 - mask_bits)) & np.uint32((1 << mask_bits) - 1) == 0) + 1


def cut_points(text: bytes, mask_bits: int = MASK_BITS, shortest: int = SHORTEST, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of one normalised text."""
    if not text:
        return []
    return _bounded(candidate_cuts(np.frombuffer(text, np.uint8), mask_bits).tolist(), len(text), shortest, longest)


def _bounded(found: list[int], n: int, shortest: int, longest: int) -> list[int]:
    cuts, last = [], 0
    for c in found:
        while c - last > longest:
            last += longest
            cuts.append(last)
        if c - last >= shortest and c < n:
            cuts.append(c)
            last = c
    while n - last > longest:
        last += longest
        cuts.append(last)
    return [*cuts, n]


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        data, offsets = flat_text(batch)
        points = code_points(data, offsets)
        keep = ~IS_SPACE[data]
        moved = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=moved[1:])
        packed = data[keep]
        offsets = moved[offsets]
        blob = packed.tobytes()
        shas, fps, lens, digests, counts = [], [], [], [], [0]
        # The 16-byte window must not reach into the row before: each row is hashed by itself.
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            text = blob[a:b]
            shas.append(hashlib.sha256(text).digest())
            last, ends = 0, cut_points(text)
            for end in ends:
                chunk = text[last:end]
                fps.append(xxhash.xxh3_64_intdigest(chunk) - (1 << 63))
                lens.append(end - last)
                digests.append(shas[-1] if len(ends) == 1 else hashlib.sha256(chunk).digest())
                last = end
            counts.append(len(fps))
        chunks = pa.ListArray.from_arrays(
            pa.array(counts, pa.int32()),
            pa.StructArray.from_arrays([pa.array(fps, pa.int64()), pa.array(lens, pa.int32()), pa.array(digests, pa.binary())], ["fp", "len", "sha"]),
        )
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(points), pa.array(shas, pa.binary()), chunks], schema=_ARROW)


def recipes(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_code_points, text_sha256, chunks(fp, len, sha) of each row; row numbers the rows."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_recipes, RECIPE_SCHEMA)
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "*"), "recipes")


def verified_recipes(found: DataFrame) -> DataFrame:
    """The rows of recipes() with `recipe`: ordered verified identifiers, `fp` or, where fingerprints collide, `fp:variant`."""
    one = F.struct(F.col("c.len").alias("len"), F.col("c.sha").alias("sha"))
    chunks = found.select(F.explode("chunks").alias("c")).select(F.col("c.fp").alias("fp"), one.alias("content"))
    # Fingerprints under which more than one content was seen; with 64 bits nearly always none at all.
    torn = chunks.groupBy("fp").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("fp")
    variants = (
        chunks.join(torn, "fp", "left_semi").distinct()
        .withColumn("variant", F.row_number().over(Window.partitionBy("fp").orderBy("content")))
        .where("variant > 1")
    )
    spread = found.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", F.col("c.fp").alias("fp"), one.alias("content"))
    moved = (
        spread.join(variants, ["fp", "content"]).groupBy("row")
        .agg(F.map_from_entries(F.collect_list(F.struct("pos", "variant"))).alias("moved"))
    )
    fps = F.transform("chunks", lambda c: c["fp"].cast("string"))
    return found.join(moved, "row", "left").withColumn(
        "recipe", F.when(F.col("moved").isNull(), fps).otherwise(F.transform(fps, lambda f, i: F.concat_ws(":", f, F.col("moved")[i].cast("string"))))
    ).drop("moved")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """row, doc_id, keep_id, keep_row, group_size, kept, text_sha256 for each row of docs."""
    return _judged(recipes(docs))


def _judged(found: DataFrame) -> DataFrame:
    rows = verified_recipes(found).select("row", "doc_id", "n_code_points", "text_sha256", F.to_json("recipe").alias("recipe"))
    order = F.struct((-F.col("n_code_points")).alias("n"), "doc_id", "row")
    groups = rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Exactly the rows that exact_duplicates does not keep are dropped. Where ids repeat (null counts as one), they do
    not tell the rows apart: the rows are written with numbers then, and dropped by these.
    """
    key = f"row_{uuid.uuid4().hex}"  # no column of the input has this name
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = exact_duplicates(docs).where("not kept").select(F.col("doc_id").alias(key))
        return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(key)), "left_anti")
    numbered = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    ids = numbered.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    found = recipes(numbered.select(F.col(key).alias("doc_id"), "text")).drop("row").withColumnRenamed("doc_id", "row")
    gone = _judged(materialize(found.join(ids, "row"), "recipes")).where("not kept").select(F.col("row").alias(key))
    return numbered.join(gone, key, "left_anti").select(*columns_of(docs))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm,
         row_number() OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS n,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": SQL}
