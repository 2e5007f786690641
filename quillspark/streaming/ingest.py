"""Continuous ingestion: new files and text rows through the same per-document transforms as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..sources.files import kind_of


def stream_files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of path, content, kind of files as they arrive under a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "modificationTime", "content", kind_of(F.col("path")).alias("kind"))


def stream_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counts_by_window(events: DataFrame, time: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by window and key; rows later than the watermark are dropped, and a window is given once it is closed."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def new_documents(docs: DataFrame, time: str, key: str = "doc_id", late: str = "1 hour") -> DataFrame:
    """Documents not seen before within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def checked(docs: DataFrame, forbidden: list[str]) -> DataFrame:
    """doc_id, n_forbidden, passed: the document check as a stateless transform."""
    n = sum((X.count_of(F.coalesce("text", F.lit("")), p) for p in forbidden), F.lit(0))
    return docs.select("doc_id", n.alias("n_forbidden"), (n == 0).alias("passed"))


def write_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet, exactly once by its checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there now and reads what it wrote: a table under folder, exactly once by its checkpoint."""
    query = write_parquet(stream, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
