"""Shared pieces: materialised intermediates and flat, vectorised views of Arrow text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles at a time (a longer document is a step of its own).
STEP_BYTES = 1_000_000
#: Bins, and rows that are left to the driver, where a value of a rank is looked for.
FEW = 2000
#: The white space of the text contracts: [\x20\x09-\x0D].
WHITESPACE = b" \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        spark = df.sparkSession
        root = shared_dir(spark)
        folders = {f[: f.index("/", len(root) + 1)] for f in df.inputFiles() if f.startswith(root + "/")}
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def value_at(values: DataFrame, rank: int) -> float:
    """The value of a column of doubles (the only one, without nulls) that rank values precede in order; exact.

    Counts in bins narrow the range around that rank until few rows or one value are left: no more than bins or FEW rows
    come to the driver.
    """
    col = F.col(values.columns[0])
    low, high, left = values.agg(F.min(col), F.max(col), F.count(col)).first()
    while low < high and left > FEW:
        inside = values.where(col.between(low, high))
        place = F.least(F.floor((col - low) / (high - low) * FEW), F.lit(FEW - 1))  # the ends never share a bin
        for _, low, high, left in sorted(map(tuple, inside.groupBy(place).agg(F.min(col), F.max(col), F.count(col)).collect())):  # noqa: B020
            if rank < left:
                break
            rank -= left
    if low == high:
        return low
    return sorted(r[0] for r in values.where(col.between(low, high)).collect())[rank]


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names hold (dots, blanks, quotes)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, the split key of the held-out folds."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that the text column of each holds about STEP_BYTES at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(batch)[1:] - text_offsets(batch)[0]
        start = 0
        while start < batch.num_rows:
            base = 0 if start == 0 else ends[start - 1]
            stop = max(start + 1, int(np.searchsorted(ends, base + STEP_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system at a task's end: workers stay alive between tasks, idle ones too."""
    import ctypes
    import ctypes.util

    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c") if not _libc else None
    if name:
        _libc.append(ctypes.CDLL(name))
    if _libc and hasattr(_libc[0], "malloc_trim"):
        _libc[0].malloc_trim(0)


_libc: list = []


def text_offsets(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("text"))
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def flat_text(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the text column end to end, and the n+1 offsets of the rows in them (a null is empty)."""
    offsets = text_offsets(batch)
    col = batch.column(batch.schema.get_field_index("text"))
    data = col.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit constants from a seed (splitmix64)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for spans in rising order that do not overlap.

    Each code is mixed with its place in its span before the codes of a span are summed: no polynomial, so texts of
    regular build (Thue-Morse words and the like) collide no more often than any others. Differences of one running
    sum give all spans at once.
    """
    n = len(codes)
    if not len(starts):
        return np.zeros(0, np.uint64)
    first = np.zeros(n, np.int64)
    first[starts] = starts
    np.maximum.accumulate(first, out=first)
    place = np.subtract(np.arange(n), first, out=first).view(np.uint64)
    place *= np.uint64(0x9E3779B97F4A7C15)
    place += codes
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(place), dtype=np.uint64, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) ^ ((ends - starts).astype(np.uint64) << np.uint64(1)))


def _byte_codes() -> tuple[np.ndarray, np.ndarray]:
    plain = splitmix(256, 7)
    lowered = plain.copy()
    lowered[65:91] = plain[97:123]
    return plain, lowered


BYTE_CODES, LOWERED_CODES = _byte_codes()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITESPACE)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space) of every row, and the n+1 word offsets of the rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    begins = inside & ~before
    begins[cut] = inside[cut]
    stops = np.zeros(len(data) + 1, bool)
    stops[1:-1] = inside[:-1] & ~inside[1:]
    stops[-1] = inside[-1]
    stops[cut] |= inside[cut - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    return starts, ends, np.searchsorted(starts, offsets)


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each row: bytes that do not continue a UTF-8 sequence."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
