"""Media columns in FLAC: texts stored as audio payloads, read back in blocks with seekable sample offsets.

encode_payloads writes a stream for each text, decode_payloads reads streams back (Rice residuals, linear
predictors, frame checksums, MD5), cuts the samples into PCM blocks at their sample offsets, digests these and computes
features of the samples; the tail is read a second time, by the last seek point alone. pcm_blocks writes the blocks as
rows with their sample offsets, and read_samples fetches a range by seek points.

Defined cases: a null text is empty; an empty text is one block of blanks; equal texts have equal streams and
features; rows that repeat are handled each; a damaged stream (or a null one) is a row whose status says so and whose
digests are null, and has no PCM blocks; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac
from .common import documents, rows_of

#: Payload bytes that one step encodes at a time.
BATCH_BYTES = 2_000_000


def payload_of(text: bytes) -> bytes:
    """The text padded with blanks to a positive multiple of a block."""
    size = max(1, -(-len(text) // flac.BLOCK)) * flac.BLOCK
    return text.ljust(size, b" ")


def _encode_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        texts = [b or b"" for b in batch.column(1).cast(pa.binary()).to_pylist()]
        streams = flac.encode_many([payload_of(t) for t in texts])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the FLAC stream)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_pass, "doc_id long, n_bytes long, media binary")


def feature_of(payload: bytes) -> str:
    """Level, energy, peak and crossings of the samples, as whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    n, total = len(x), int(x.sum())
    above = x * n > total
    return f"mean={total * 1000 // n};energy={int((x * x).sum(dtype=np.int64)) * 1000 // n};peak={int(np.abs(x).max())};crossings={int((above[1:] != above[:-1]).sum())};steps={int(np.abs(np.diff(x)).sum())}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, last_offset long, status string"
#: Frames of one PCM block.
BLOCK_FRAMES = 256


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        i = batch.schema.get_field_index("media")
        streams, at = [x or b"" for x in batch.column(i).to_pylist()], 0
        while at < len(streams):
            end, size = at, 0
            while end < len(streams) and (end == at or size + len(streams[end]) <= BATCH_BYTES):
                size += len(streams[end])
                end += 1
            yield batch.slice(at, end - at), streams[at:end]
            at = end


def _decoded(streams: list[bytes]) -> tuple[list[bytes | None], list[str]]:
    """Payload and status of each stream; None where it is damaged."""
    wrong = (flac.Damaged, ValueError, IndexError, OverflowError, struct.error)
    try:
        return flac.decode_many(streams), ["ok"] * len(streams)
    except wrong:
        payloads, status = [], []
        for s in streams:
            try:
                payloads += flac.decode_many([s])
                status.append("ok")
            except wrong as e:
                payloads.append(None)
                status.append(f"damaged: {e}" if s else "missing")
        return payloads, status


def blocks_of(payload: bytes, frames: int = BLOCK_FRAMES) -> list[tuple[int, bytes]]:
    """(sample offset, PCM) of a payload's blocks."""
    step = frames * flac.BLOCK
    return [(a, payload[a : a + step]) for a in range(0, len(payload), step)]


def _decode_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, streams in _groups(batches):
        payloads, status = _decoded(streams)
        good = [s for s, p in zip(streams, payloads, strict=True) if p is not None]
        tails = iter(flac.read_tails(good, 16))
        rows = []
        for s, p in zip(streams, payloads, strict=True):
            if p is None:
                rows.append((None, None, None, len(s), hashlib.sha256(s).hexdigest(), None, None, None))
                continue
            digest, offset, n = hashlib.sha256(), 0, 0
            for offset, pcm in blocks_of(p):  # noqa: B007
                digest.update(pcm)
                n += 1
            rows.append((len(p), digest.hexdigest(), zlib.crc32(next(tails)), len(s), hashlib.sha256(s).hexdigest(), feature_of(p), n, offset))
        columns = [list(c) for c in zip(*rows, strict=True)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(status)], names=[c.split()[0] for c in DIGEST.split(", ")]
        )


def decode_payloads(media: DataFrame) -> DataFrame:
    """Digests and features of streams (doc_id, n_bytes, media), all from the bytes read back."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_decode_pass, DIGEST)


def pcm_blocks(media: DataFrame, frames: int = BLOCK_FRAMES) -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm of sound streams, in blocks of so many frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, streams in _groups(batches):
            rows = []
            for doc, p in zip(batch.column(0).to_pylist(), _decoded(streams)[0], strict=True):
                rows += [(doc, a, pcm) for a, pcm in blocks_of(p or b"", frames)]
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()),
            ], names=["doc_id", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, sample_offset long, n_samples long, pcm binary")


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Samples start..start+count of a stream: decoding begins at the nearest seek point before."""
    info = flac.metadata(stream)
    point = max((p for p in info["seek"] if p[0] <= start), default=(0, 0, flac.BLOCK))
    at, position, out = info["first"] + point[1], point[0], []
    while position + len(out) < min(start + count, info["samples"]):
        values, _, at = flac.decode_frame(stream, at, info)
        out += values
    part = np.array(out[start - position : start - position + count], np.int16)
    return (part + 128).astype(np.uint8).tobytes()


def op7_flac_media(spark, sf_dir: str) -> DataFrame:
    return decode_payloads(encode_payloads(documents(spark, sf_dir)))


QUERIES = {"op7_flac_media": op7_flac_media}
ORACLES: dict[str, str] = {}
