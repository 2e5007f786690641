"""A Merkle manifest of a dataset, with a proof for each row, by fractal traversal of aligned blocks.

Each row is a leaf; leaves of a language, ordered by id, form a tree (two neighbours become their digest, a lone last
one becomes its own), and the languages' roots form a tree over these. Leaves are numbered by a range sort and a small
table of counts, so no language lies in one task. Aligned blocks of 2**BLOCK_BITS leaves are subtrees: a first pass
reduces every block to its root, block roots are numbered by their block and reduced likewise until a language has one
node. Proofs then come down: each block gets the proof of its root as a header row, and its leaves' paths are emitted
by fractal traversal, a stack of existing subtrees of LAYER levels (which hold the nodes of the current leaf's path)
and of desired ones that grow by a leaf a step until they take over. A task holds the leaves of one block and the nodes
of a few small subtrees, whatever the size of the dataset.

Defined cases: null fields are `-` in a leaf; null languages form a group of their own, before all others; null ids
come first; rows with equal ids lie in the order of their leaves, and each has its proof; a lone leaf is the root of
its language; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_of_id, discard, documents, materialize

#: Leaves of a block are 2**BLOCK_BITS; levels of one existing or desired subtree.
BLOCK_BITS, LAYER = 12, 4
#: Rows whose id's crc32 this divides are presented with another n_chars.
TAMPER_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def height_of(n: int, bits: int) -> int:
    """Levels above the leaves of a block in a tree of n leaves."""
    return min(bits, (n - 1).bit_length())


def subtree_root(leaves: list[bytes], height: int) -> bytes:
    """The root of a block, leaf by leaf with a stack of one node a level."""
    stack: list[tuple[int, bytes]] = []
    for leaf in leaves:
        level, node = 0, leaf
        while stack and stack[-1][0] == level:
            level, node = level + 1, digest(stack.pop()[1], node)
        stack.append((level, node))
    level, node = stack.pop()
    while level < height:
        if stack and stack[-1][0] == level:
            node = digest(stack.pop()[1], node)
        else:
            node = digest(node)
        level += 1
    return node


class _Subtree:
    """Nodes of the levels low .. high - 1 under the number-th node of level high; grows by one leaf a step."""

    def __init__(self, leaves: list[bytes], low: int, high: int, number: int):
        self.leaves, self.low, self.high = leaves, low, high
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.stack: list[bytes] = []
        self.at, self.end = number << high, min((number + 1) << high, len(leaves))

    def step(self) -> None:
        if self.at >= self.end:
            return
        i, node, last = self.at, self.leaves[self.at], len(self.leaves) - 1
        self.at += 1
        for level in range(self.high):
            if level >= self.low:
                self.nodes[level, i] = node
            if i & 1:
                node = digest(self.stack.pop(), node)
            elif i == last >> level and self.at == self.end:
                node = digest(node)
            else:
                self.stack.append(node)
                return
            i >>= 1

    def finish(self) -> _Subtree:
        while self.at < self.end:
            self.step()
        return self


def fractal_paths(leaves: list[bytes], height: int, layer: int = LAYER) -> Iterator[list[tuple[str, bytes]]]:
    """The authentication path of each leaf in turn: ('l', node) for a sibling to the left, ('r', node), or ('-', b'') for none."""
    spans = [(low, min(low + layer, height)) for low in range(0, height, layer)]
    existing = [_Subtree(leaves, low, high, 0).finish() for low, high in spans]
    desired = [_Subtree(leaves, low, high, 1) for low, high in spans]
    for s in range(len(leaves)):
        for k, (low, high) in enumerate(spans):
            if s and not s & ((1 << high) - 1):  # the desired subtree of this layer takes over
                existing[k] = desired[k].finish()
                desired[k] = _Subtree(leaves, low, high, (s >> high) + 1)
            desired[k].step()
        path = []
        for k, (low, high) in enumerate(spans):
            nodes = existing[k].nodes
            for level in range(low, high):
                i = s >> level
                sibling = nodes.get((level, i ^ 1))
                path.append(("-", b"") if sibling is None else ("l" if i & 1 else "r", sibling))
        yield path


def fold(leaf: bytes, steps: bytes) -> bytes:
    """The root that a leaf and the steps of its proof lead to; steps are `-`, or l or r with 64 hex digits."""
    node, at = leaf, 0
    while at < len(steps):
        side = steps[at : at + 1]
        if side == b"-":
            node, at = digest(node), at + 1
            continue
        other, at = steps[at + 1 : at + 65], at + 65
        node = digest(other, node) if side == b"l" else digest(node, other)
    return node


def siblings(steps: bytes) -> bytes:
    """The siblings of a proof end to end: its steps without the sides."""
    return steps.translate(None, b"lr-")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, list[dict]]]:
    """Header and rows of each block; rows come sorted by group, block, pos, a header first."""
    header, rows, now = None, [], None
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["grp"], r["block"])
            if key != now:
                if rows:
                    yield header, rows
                header, rows, now = None, [], key
            if r["pos"] < 0:
                header = r
            else:
                rows.append(r)
    if rows:
        yield header, rows


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_NODE = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])
_STEPS = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("steps", pa.string()), ("subroot", pa.string())])
_PROOF = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "presented", "subroot", "steps", "proof_sha256", "folded_root"))])
_NODES_SQL = "grp string, pos long, n long, node string"
_STEPS_SQL = "grp string, pos long, steps string, subroot string"
_PROOF_SQL = "doc_id long, leaf string, presented string, subroot string, steps string, proof_sha256 string, folded_root string"


def _roots_pass(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches):
            n = rows[0]["n"]
            root = subtree_root([r["node"].encode() for r in rows], height_of(n, bits))
            yield _emit([(rows[0]["grp"], rows[0]["block"], -(-n >> bits) if n > 1 else 1, root.decode())], _NODE)

    return run


def _paths(header: dict, rows: list[dict], bits: int) -> Iterator[tuple[dict, bytes]]:
    leaves, upper = [r["node"].encode() for r in rows], header["steps"].encode()
    for r, path in zip(rows, fractal_paths(leaves, height_of(rows[0]["n"], bits)), strict=True):
        yield r, b"".join(side.encode() + node for side, node in path) + upper


def _steps_pass(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for header, rows in _blocks(batches):
            yield _emit([(r["grp"], r["pos"], steps.decode(), header["subroot"]) for r, steps in _paths(header, rows, bits)], _STEPS)

    return run


def _proof_pass(bits: int, keep_steps: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for header, rows in _blocks(batches):
            out = []
            for r, steps in _paths(header, rows, bits):
                shown = r["presented"] or r["node"]
                kept = steps.decode() if keep_steps else None
                out.append((r["doc_id"], r["node"], shown, header["subroot"], kept, digest(siblings(steps)).decode(), fold(shown.encode(), steps).decode()))
            yield _emit(out, _PROOF)

    return run


def leaf_of(fields: dict[str, Column] | None = None) -> Column:
    """The digest of a row: each field its UTF-8 length, a colon and its value, or `-`."""
    cols = {c: F.col(c).cast("string") for c in FIELDS} | (fields or {})
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (cols[f] for f in FIELDS))), 256)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with pos, their place in their grp by the order of `by`, and n, the rows of the grp; written once, sorted by range."""
    keys = ["grp", *by]
    placed = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "leaves")
    part = F.shiftright("at", 33)
    counts = placed.groupBy("grp", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    w = Window.partitionBy("grp")
    starts = counts.select(
        F.col("grp").alias("g"), F.col("part").alias("p"), F.sum("rows").over(w).alias("n"),
        (F.coalesce(F.sum("rows").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
    )
    found = placed.join(starts, (F.col("grp") == F.col("g")) & (part == F.col("p"))).select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "n")
    found = materialize(found, "numbered")
    discard(placed)
    return found


def _by_block(nodes: DataFrame, bits: int, headers: DataFrame | None = None) -> DataFrame:
    """nodes with their block, all of a block in one task and in order; headers (grp, pos, steps, subroot) lead the blocks of their pos."""
    rows = nodes.withColumn("block", F.shiftright("pos", bits))
    if headers is not None:
        lead = headers.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "steps", "subroot")
        rows = rows.unionByName(lead, allowMissingColumns=True)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _reduced(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The levels of a forest: nodes (grp, pos, n, node), the roots of their blocks, and so on until every grp has one."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 1
    while most > 1:
        blocks = _by_block(levels[-1].select("grp", "pos", "n", "node"), bits)
        levels.append(materialize(blocks.mapInArrow(_roots_pass(bits), _NODES_SQL), "roots"))
        most = -(-most >> bits)
    return levels


def _brought_down(levels: list[DataFrame], top: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, steps, subroot) of the nodes just above the lowest level, from those of the uppermost."""
    for nodes in reversed(levels[1:-1]):
        top = _by_block(nodes, bits, top).mapInArrow(_steps_pass(bits), _STEPS_SQL)
    return top


def manifest(docs: DataFrame, bits: int = BLOCK_BITS, tamper_every: int = TAMPER_EVERY, keep_steps: bool = True) -> DataFrame:
    """doc_id, leaf, presented (the leaf shown to the proof), subroot, root, steps (the proof), proof_sha256, folded_root of each row of docs."""
    changed = F.when(crc_of_id(F.col("doc_id")) % tamper_every == 0, leaf_of({"n_chars": (F.col("n_chars").cast("long") + 1).cast("string")}))
    # Groups in the order of their languages, null first: `0`, then `1` and the language.
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    leaves = numbered(docs.select(group.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("node"), changed.alias("presented")), ["doc_id", "node"])
    levels = _reduced(leaves, bits)
    langs = numbered(levels[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "node"), ["lang"])
    above = _reduced(langs, bits)
    top = above[-1].select("node").first()  # one row
    none = above[-1].select("grp", "pos", F.lit("").alias("steps"), F.lit("").alias("subroot"))
    lang_steps = none if len(above) == 1 else _by_block(langs, bits, _brought_down(above, none, bits)).mapInArrow(_steps_pass(bits), _STEPS_SQL)
    proofs = langs.join(lang_steps.select("pos", "steps"), "pos").select(F.col("lang").alias("grp"), F.lit(0).cast("long").alias("pos"), "steps", F.col("node").alias("subroot"))
    lead = _brought_down(levels, materialize(proofs, "proofs"), bits)
    made = _by_block(leaves, bits, lead).mapInArrow(_proof_pass(bits, keep_steps), _PROOF_SQL)
    return made.withColumn("root", F.lit(top[0] if top else None).cast("string"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    made = manifest(documents(spark, sf_dir), keep_steps=False)
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The table's bits of crc32, one byte a step, as lists.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = f"""
WITH RECURSIVE marked AS (SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} END AS tampered FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS row FROM marked
), low(lvl, lang, pos, n, node) AS (
  SELECT 0, lang, pos, n, leaf FROM leaves
  UNION ALL
  SELECT lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lvl, lang, pos // 2, n
), subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY lang IS NOT NULL, encode(coalesce(lang, ''))) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high(lvl, pos, n, node) AS (
  SELECT 0, pos, n, node FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n
), steps AS (
  SELECT l.row, a.lvl AS step, a.pos & 1 AS side, s.node
  FROM leaves l JOIN low a ON a.lang IS NOT DISTINCT FROM l.lang AND a.pos = l.pos >> a.lvl AND a.n > 1
  LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM a.lang AND s.lvl = a.lvl AND s.pos = xor(a.pos, 1)
  UNION ALL
  SELECT l.row, 1000 + a.lvl, a.pos & 1, s.node
  FROM leaves l JOIN subroots t ON t.lang IS NOT DISTINCT FROM l.lang JOIN high a ON a.pos = t.pos >> a.lvl AND a.n > 1
  LEFT JOIN high s ON s.lvl = a.lvl AND s.pos = xor(a.pos, 1)
), path AS (
  SELECT row, sha256(coalesce(string_agg(node, '' ORDER BY step), '')) AS proof, list(struct_pack(side := side, node := node) ORDER BY step) AS steps FROM steps GROUP BY row
), folded(row, i, node) AS (
  SELECT row, 0, coalesce(tampered, leaf) FROM leaves
  UNION ALL
  SELECT f.row, i + 1, sha256(CASE WHEN p.steps[i + 1].node IS NULL THEN f.node WHEN p.steps[i + 1].side = 1 THEN p.steps[i + 1].node || f.node ELSE f.node || p.steps[i + 1].node END)
  FROM folded f JOIN path p USING (row) WHERE i < len(p.steps)
), last AS (SELECT row, arg_max(node, i) AS node FROM folded GROUP BY row), top AS (SELECT node FROM high WHERE n = 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, top.node AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = top.node AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN last f USING (row) LEFT JOIN path p USING (row) CROSS JOIN top
"""
QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
ORACLES = {"op13_merkle_manifest": SQL}
