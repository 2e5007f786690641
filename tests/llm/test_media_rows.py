import hashlib
import zlib

from quillspark.llm import flac, media


def test_damaged_streams_are_rows(spark):
    good = flac.encode_many([media.payload_of(b"some text " * 90)])[0]
    cases = [good, good[:-20], good[:60], b"no stream at all", None, good[:200] + bytes([good[200] ^ 255]) + good[201:], good]
    rows = [(i, 900, None if s is None else bytearray(s), "x") for i, s in enumerate(cases)]
    streams = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, status string")
    got = {r["doc_id"]: r for r in media.decode_payloads(streams).collect()}
    assert [got[i]["status"] == "ok" for i in range(7)] == [True, False, False, False, False, False, True]
    assert got[4]["status"] == "missing" and all(got[i]["payload_sha256"] is None for i in range(1, 6))
    assert got[0]["payload_sha256"] == got[6]["payload_sha256"] == hashlib.sha256(media.payload_of(b"some text " * 90)).hexdigest()
    assert {r["doc_id"] for r in media.pcm_blocks(streams).collect()} == {0, 6}


def test_tails_by_seek_points():
    texts = [b"", b"a", b"abc " * 5000, bytes(range(256)) * 90, b"\x00\xff" * 30_000, b"x" * 192 * 33]
    payloads = [media.payload_of(t) for t in texts]
    streams = flac.encode_many(payloads)
    assert flac.read_tails(streams, 16) == [p[-16:] for p in payloads]
    assert flac.read_tails(streams, 192) == [p[-192:] for p in payloads]


def test_blocks_and_offsets(spark):
    text = "The river, the old town and the mill. " * 9000
    docs = spark.createDataFrame([(1, text), (2, None), (2, None)], "doc_id long, text string")
    stored = media.encode_payloads(docs)
    digest = {r["doc_id"]: r for r in media.decode_payloads(stored).collect()}
    blocks = {}
    for r in media.pcm_blocks(stored).collect():
        blocks.setdefault(r["doc_id"], []).append((r["sample_offset"], r["pcm"]))
    own = sorted(blocks[1])
    assert len(own) == digest[1]["n_blocks"] and own[-1][0] == digest[1]["last_offset"]
    whole = b"".join(bytes(p) for _, p in own)
    assert whole == media.payload_of(text.encode()) and digest[1]["tail_crc32"] == zlib.crc32(whole[-16:])
    assert len(blocks[2]) == 2 and digest[2]["n_bytes"] == 0 and digest[2]["payload_bytes"] == 192
