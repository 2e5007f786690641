"""Token counts of whole texts, huge ones by overlapping chunks that are put together again.

A text of up to CHUNK code points is counted as one. A longer one is cut into blocks; each block with the first
OVERLAP code points of the next is a chunk, and chunks are encoded by themselves, wherever they lie, with offsets.
Where two neighbours meet, both hold tokens of the overlap. They are spliced at a boundary that both have and that is
proven stable: a new word of the pre-tokenizer begins there in both, it lies further from either chunk's edge than
any special string or lookahead reaches, and its first character joins no character before it when normalised. From
such a place on the right chunk's tokens are those of the whole text, and up to it the left one's are. Where no such
boundary is common, the overlap is widened, first by WIDER, then to whole chunks: all chunks along unbroken seams
become one, until every seam of the document is proven. A tokenizer without words (no pre-tokenizer) or with special
strings that take up blanks has no proven boundary, and its texts end up as single chunks.

Files ending in .json are read by tokenizers, those ending in .model by sentencepiece (texts of any length as one).

Defined cases: a null text is empty and has no tokens; special strings in a text count as the library counts them;
rows that repeat are counted each; a null doc_id stays null; an empty table gives an empty result; other columns are
not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, flat_text, materialize, rows_of
from .packing import tokenizer_path
from .tokenize import tokenizer

#: Code points of a block, and of the next block that a chunk holds as well; a seam that fails is tried again with WIDER times as many.
CHUNK, OVERLAP, WIDER = 32_768, 512, 8
#: Tokens of a window; longer texts are over the limit.
LIMIT = 2048
#: Code points that pre-tokenizer patterns look ahead.
LOOKAHEAD = 4

WHOLE_SCHEMA = "doc_id long, n_bytes long, n_tokens long"
_WHOLE_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
CHUNK_SCHEMA = "row long, first long, last long, n_tokens long, head array<struct<p:long,k:long>>, tail array<struct<p:long,k:long>>"
_POINTS = pa.list_(pa.struct([("p", pa.int64()), ("k", pa.int64())]))
_CHUNK_ARROW = pa.schema([("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("n_tokens", pa.int64()), ("head", _POINTS), ("tail", _POINTS)])


@cache
def library(path: str):
    """The worker's tokenizer of a file, by the library that reads such files."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _by_words(path: str) -> bool:
    """Whether tokenize.WordTokenizer, which keeps the ids of words, stands for this file: lower case, white space dropped, letters, single digits and signs."""
    if not path.endswith(".json"):
        return False
    made = json.loads(library(path).to_str())
    parts = [p.get("pattern", {}).get("Regex") for p in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
    return parts[:1] == [r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"] and "Lowercase" in [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]


def _whole_pass(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            data, offsets = flat_text(batch)
            if _by_words(path):
                counts = np.diff(tokenizer(path).ids(data, offsets)[1])
            else:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                if path.endswith(".model"):
                    found = library(path).encode(texts, num_threads=1)
                else:
                    found = [e.ids for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]
                counts = np.fromiter(map(len, found), np.int64, len(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts.astype(np.int64))], schema=_WHOLE_ARROW)

    return run


@cache
def _joining() -> frozenset[str]:
    """Characters that may join one before them in a canonical composition, or move before it."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.combining(ch):
            found.add(ch)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<":
            found |= {chr(int(x, 16)) for x in parts.split()[1:]} | {ch}
    return frozenset(found)


@cache
def _margin(path: str) -> int | None:
    """How far a boundary must lie from the edges of a chunk; None where nothing is proven."""
    added = json.loads(library(path).to_str())["added_tokens"]
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
        return None
    return LOOKAHEAD + max((len(t["content"]) for t in added), default=0)


def stable_boundaries(text: str, offsets: list, words: list, low: int, high: int, margin: int) -> list[tuple[int, int]]:
    """(place, token) of the boundaries in text[low:high] that do not depend on what lies outside text, `margin` from its edges."""
    low, high, found = max(low, margin), min(high, len(text) - margin), []
    k = max(1, int(np.searchsorted(np.fromiter((a for a, _ in offsets), np.int64, len(offsets)), low))) if low else 1
    for k in range(k, len(offsets)):
        p = offsets[k][0]
        if p >= high:
            break
        new = words[k] is not None and words[k - 1] is not None and words[k] != words[k - 1] and offsets[k - 1][1] <= p
        if new and (text[p].isascii() or text[p] not in _joining()):
            found.append((p, k))
    return found


def _chunk_pass(path: str, size: int, reach: int):
    """Encodes chunks: those in `head` may be common with the chunk before, those in `tail` with the one after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = _margin(path)
        for batch in rows_of(batches):
            out = []
            for row, first, last, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("row", "first", "last", "text")), strict=True):
                got = library(path).encode(text, add_special_tokens=False)
                head, tail, own = [], [], (last - first + 1) * size
                if margin is not None:
                    offsets, words = got.offsets, got.word_ids
                    head = stable_boundaries(text, offsets, words, 0, reach, margin) if first else []
                    tail = stable_boundaries(text, offsets, words, own, len(text), margin) if len(text) > own else []
                points = [[{"p": first * size + p, "k": k} for p, k in side] for side in (head, tail)]
                out.append((row, first, last, len(got.ids), *points))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)

    return run


def _blocks(huge: DataFrame, size: int, reach: int) -> DataFrame:
    """row, doc_id, n_bytes, block, text, ahead (what a chunk holds of the next block), spread over tasks."""
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = huge.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut.alias("parts"))
    # A last block that the chunk before would hold as a whole goes to that block.
    joined = F.concat(F.slice("parts", 1, F.size("parts") - 2), F.array(F.array_join(F.slice("parts", -2, 2), "")))
    rows = rows.withColumn("parts", F.when((F.size("parts") > 1) & (F.length(F.element_at("parts", -1)) <= reach), joined).otherwise(F.col("parts")))
    both = F.transform("parts", lambda b, i: F.struct(b.alias("text"), F.coalesce(F.left(F.get("parts", i + 1), F.lit(reach)), F.lit("")).alias("ahead")))
    each = rows.select("row", "doc_id", "n_bytes", F.posexplode(both).alias("block", "b"))
    return each.select("row", "doc_id", "n_bytes", F.col("block").cast("long").alias("block"), "b.text", "b.ahead").repartition("row", "block")


def _chunk_texts(plan: DataFrame, blocks: DataFrame, reach: int) -> DataFrame:
    """row, first, last, text of planned chunks: blocks first to last and `reach` code points more."""
    wanted = plan.select("row", "first", "last", F.explode(F.expr("sequence(first, last + 1)")).alias("block"))
    part = F.when(F.col("block") > F.col("last"), F.left("text", F.lit(reach))).otherwise(F.col("text"))
    held = wanted.join(blocks.select("row", "block", "text"), ["row", "block"]).groupBy("row", "first", "last")
    return held.agg(F.array_sort(F.collect_list(F.struct("block", part.alias("part")))).alias("s")).select("row", "first", "last", F.array_join("s.part", "").alias("text"))


def _seams(encoded: DataFrame) -> DataFrame:
    """row, first, last, and `gain` of each chunk: what its tokens add to the count before the next one's, null where the seam fails.

    The chunk that no other follows adds all its tokens. The sum of the gains of a document is its count.
    """
    after = encoded.select("row", F.col("first").alias("next"), F.col("head").alias("other"), F.lit(True).alias("followed"))
    both = encoded.withColumn("next", F.col("last") + 1).join(after, ["row", "next"], "left")
    place = F.array_min(F.array_intersect(F.col("tail.p"), F.col("other.p")))
    at = lambda side: F.get(F.filter(side, lambda x: x["p"] == F.col("place")), F.lit(0))["k"]
    gain = F.when(F.col("followed").isNull(), F.col("n_tokens")).otherwise(at("tail") - at("other"))
    return both.withColumn("place", place).select("row", "first", "last", gain.alias("gain"))


def _merged(seams: DataFrame) -> DataFrame:
    """The next plan: chunks along failed seams become one."""
    w = Window.partitionBy("row").orderBy("first")
    begins = F.lag("gain").over(w).isNotNull().cast("int")  # the seam before holds
    runs = seams.withColumn("begins", begins).withColumn("run", F.sum("begins").over(w))
    return runs.groupBy("row", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_chunks of each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if path.endswith(".model"):
        return rows.mapInArrow(_whole_pass(path), WHOLE_SCHEMA).withColumn("n_chunks", F.lit(1).cast("long"))
    counted = rows.where(F.length("text") <= chunk).mapInArrow(_whole_pass(path), WHOLE_SCHEMA).withColumn("n_chunks", F.lit(1).cast("long"))
    blocks = materialize(_blocks(rows.where(F.length("text") > chunk), chunk, overlap), "blocks")
    owners = materialize(blocks.where("block = 0").select("row", "doc_id", "n_bytes"), "owners")
    reach, plan = overlap, None
    while True:
        if plan is None:
            texts = blocks.select("row", F.col("block").alias("first"), F.col("block").alias("last"), F.concat("text", "ahead").alias("text"))
        else:
            texts = _chunk_texts(plan, blocks, reach)
        encoded = materialize(texts.mapInArrow(_chunk_pass(path, chunk, reach), CHUNK_SCHEMA), "chunks")
        seams = _seams(encoded)
        totals = seams.groupBy("row").agg(F.sum("gain").alias("n_tokens"), F.count("*").alias("n_chunks"), F.count_if(F.col("gain").isNull()).alias("failed"))
        counted = counted.unionByName(owners.join(totals.where("failed = 0").drop("failed"), "row").drop("row"))
        open_rows = totals.where("failed > 0").select("row")
        if open_rows.isEmpty():
            break
        rest = seams.join(open_rows, "row", "left_semi")
        plan = materialize(rest.select("row", "first", "last") if reach == overlap else _merged(rest), "plan")
        reach = overlap * WIDER
    discard(blocks)
    return counted


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    found = count_tokens(documents(spark, sf_dir), tokenizer_path())
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chunks")


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES: dict[str, str] = {}
