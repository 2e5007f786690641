import json
import zlib

import numpy as np

from quillspark.llm import packing


def test_a_vocabulary_beyond_two_bytes(spark, tmp_path):
    """Ids lie in four bytes there; pieces that are cut have the codes of their own ids."""
    from tokenizers import Tokenizer

    made = json.load(open(packing.tokenizer_path()))
    top = max(made["model"]["vocab"].values())
    made["model"]["vocab"] |= {f"unused{i}": top + 1000 + i for i in range(20_000)}
    path = str(tmp_path / "wide.json")
    json.dump(made, open(path, "w"))
    texts = {i: "the old town and the river, 12 times " * (i * 37 % 90) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    lib = Tokenizer.from_file(path)
    assert lib.get_vocab_size() > 1 << 16
    ids = {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces = packing.pack_documents(docs, path, window=256).collect()
    assert any(r["start"] % 256 for r in pieces)
    for r in pieces:
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert sum(r["length"] for r in pieces) == sum(map(len, ids.values()))
