import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import flac, media


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))


def lpc_frame(samples, number, weights, precision, down, k, parts=0, escape=None):
    """A frame with a general linear predictor, written bit by bit."""
    head = flac._header(number)
    order, w = len(weights), BitWriter()
    w.put(0, 1), w.put(31 + order, 6), w.put(0, 1)
    for s in samples[:order]:
        w.put(s & 255, 8)
    w.put(precision - 1, 4), w.put(down & 31, 5)
    for c in weights:
        w.put(c & (1 << precision) - 1, precision)
    w.put(0, 2), w.put(parts, 4)
    residual = [samples[i] - (sum(c * samples[i - 1 - j] for j, c in enumerate(weights)) >> down) for i in range(order, len(samples))]
    size, at = len(samples) >> parts, 0
    for p in range(1 << parts):
        n = size - (order if p == 0 else 0)
        w.put(15 if escape else k, 4)
        if escape:
            w.put(escape, 5)
        for r in residual[at : at + n]:
            if escape:
                w.put(r & (1 << escape) - 1, escape)
            else:
                f = -2 * r - 1 if r < 0 else 2 * r
                w.bits += [0] * (f >> k) + [1]
                w.put(f & (1 << k) - 1, k)
        at += n
    frame = head + w.bytes()
    return frame + flac.crc16(frame).to_bytes(2, "big")


def noisy(n, seed=1):
    rng = np.random.default_rng(seed)
    return np.clip(40 * np.sin(np.arange(n) / 9) + rng.integers(-5, 6, n), -128, 127).astype(int).tolist()


@pytest.mark.parametrize("form", [{}, {"parts": 2}, {"escape": 9}])
@pytest.mark.parametrize("weights,down", [([3, -2], 1), ([900, -410, 60, -7], 9)])
def test_linear_predictors_partitions_and_escapes(form, weights, down):
    samples = noisy(3 * flac.BLOCK)
    frames = [lpc_frame(samples[i * 192 : (i + 1) * 192], i, weights, 12, down, 4, **form) for i in range(3)]
    payload = (np.array(samples) + 128).astype(np.uint8).tobytes()
    stream = flac.assemble(payload, frames)
    assert flac.decode_many([stream, stream]) == [payload, payload]
    assert flac._decode_plainly(stream, flac.metadata(stream)) == payload


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=900), st.text(max_size=300).map(str.encode)), min_size=1, max_size=5))
def test_round_trip(texts):
    payloads = [media.payload_of(t) for t in texts]
    streams = flac.encode_many(payloads)
    assert flac.decode_many(streams) == payloads
    for s, p in zip(streams, payloads, strict=True):
        assert flac._decode_plainly(s, flac.metadata(s)) == p


def test_long_stream_numbers_and_seeking():
    payload = bytes(np.random.default_rng(2).integers(90, 110, 192 * 2500, dtype=np.uint8))
    stream = flac.encode_many([payload])[0]
    assert flac.decode_many([stream]) == [payload]
    for start, count in ((0, 10), (192 * 2100 + 5, 400), (len(payload) - 3, 50)):
        assert media.read_samples(stream, start, count) == payload[start : start + count]


@pytest.mark.parametrize("at", [0, 30, 200, -1])
def test_damage_is_found(at):
    stream = bytearray(flac.encode_many([media.payload_of(b"some words of text " * 40)])[0])
    stream[at] ^= 4
    with pytest.raises((flac.Damaged, KeyError, StopIteration)):
        flac.decode_many([bytes(stream)])


def test_query_and_odd_tables(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = media.op7_flac_media(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = media.payload_of(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:])
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "x" * 100_000, 3), (3, "y", 3)], "doc_id long, text string, media int")
    got = media.decode_payloads(media.encode_payloads(docs)).collect()
    assert sorted(r["payload_bytes"] for r in got) == [192, 192, 192, 100_032]
    blocks = media.pcm_blocks(media.encode_payloads(docs), frames=100).where("doc_id = 3").orderBy("sample_offset").collect()
    assert bytes(b"".join(b["pcm"] for b in blocks if b["n_samples"] > 192))[:100_000] == b"x" * 100_000
    assert media.decode_payloads(media.encode_payloads(docs.limit(0))).count() == 0
