"""Packing by non-negative least squares on the histogram of lengths.

Every document is tokenized once and ends with an end id. Full windows are cut off first; what remains (1 to
window - 1 ids) is packed whole: lengths are put into bins of GRAIN ids, all combinations of up to DEPTH bins that
fill a window are enumerated, non-negative least squares finds how often to use each so that the histogram is used
up, counts are rounded to what is there, and the residual pieces are packed greedily end to end, the one that
overruns a window being cut there.

Only the histogram (a row for each length) and the plan made from it come to the driver; both are bounded by the
window, not by the corpus. A piece finds its place from its rank among the pieces of its length: ranks within a task
are counted while tokenizing, and a small table of counts by task and length makes them global, so no text and no id
is sorted or shuffled to be packed.

Defined cases: null and empty texts are one end id; rows that repeat a doc_id are packed each; ties of length go by
task and row; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, flat_text, materialize, rows_of
from .tokenize import tokenizer

WINDOW = 2048
#: Ids that one bin of the histogram spans, and pieces in a combination at most.
GRAIN, DEPTH = 8, 3
#: Cut pieces up to which they are broadcast to the token table, so that no ids are shuffled to code them.
BROADCAST_CUTS = 200_000
#: A task's own full windows are numbered from (task + 1) * TASK_SPAN; packed windows stay below TASK_SPAN.
TASK_SPAN = 1 << 40

TOKEN_SCHEMA = "task long, seq long, doc_id long, n long, rest int, rank long, windows_before long, crcs array<long>, ids binary"
_TOKEN_ARROW = pa.schema([
    ("task", pa.int64()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("rest", pa.int32()), ("rank", pa.int64()),
    ("windows_before", pa.int64()), ("crcs", pa.list_(pa.int64())), ("ids", pa.binary()),
])


def _tokens_pass(path: str, end_id: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        task, seq, windows = TaskContext.get().partitionId(), 0, 0
        ranks = np.zeros(window, np.int64)
        for batch in rows_of(batches):
            ids, at = words.ids(*flat_text(batch))
            wide = ids.astype("<u4")
            end, stop = np.array([end_id], "<u4").tobytes(), np.array([end_id], words.dtype).tobytes()
            blob, short, w = wide.tobytes(), ids.tobytes(), words.dtype.itemsize
            counts, rest, rank, before, crcs, owned, crc_at = [], [], [], [], [], [], [0]
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                n = b - a + 1
                text = blob[4 * a : 4 * b] + end
                crcs += [zlib.crc32(text[4 * s : 4 * (s + window)]) for s in range(0, n, window)]
                crc_at.append(len(crcs))
                r = n % window
                counts.append(n)
                rest.append(r)
                rank.append(int(ranks[r]))
                ranks[r] += 1
                before.append(windows)
                windows += n // window
                owned.append(short[w * a : w * b] + stop)
            m = len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(m, task, np.int64)), pa.array(np.arange(seq, seq + m)), batch.column(0), pa.array(counts, pa.int64()), pa.array(rest, pa.int32()),
                pa.array(rank, pa.int64()), pa.array(before, pa.int64()), pa.ListArray.from_arrays(pa.array(crc_at, pa.int32()), pa.array(crcs, pa.int64())), pa.array(owned, pa.binary()),
            ], schema=_TOKEN_ARROW)
            seq += m

    return run


def token_table(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """A row for each row of docs, with its ids (little-endian, 2 bytes each up to 65536 entries, else 4), in the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(texts.mapInArrow(_tokens_pass(path, end_id, window), TOKEN_SCHEMA), "tokens")


# --- the plan ---------------------------------------------------------------------------------------------


def combinations(bins: int, depth: int) -> np.ndarray:
    """All multisets of at most depth bins (1..bins) whose sum is bins, one a row, zeros for unused places."""
    rows = [np.array([[bins] + [0] * (depth - 1)])]
    if depth > 1:
        low = np.arange(1, bins // 2 + 1)
        rows.append(np.stack([bins - low, low] + [np.zeros_like(low)] * (depth - 2), 1))
    for places in range(3, depth + 1):
        grown = rows[-1][:, : places - 1]
        out = []
        for row in grown:  # split the largest place into two, keeping places in falling order
            top, least = row[0], row[1] if places > 2 else 1
            low = np.arange(1, top // 2 + 1)
            low = low[top - low >= least]
            part = np.column_stack([top - low, np.repeat(row[None, 1:], len(low), 0), low])
            out.append(np.sort(part, 1)[:, ::-1])
        rows.append(np.unique(np.pad(np.concatenate(out), ((0, 0), (0, depth - places))), axis=0))
    return np.concatenate(rows)


def non_negative_least_squares(places: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |A x - b| by active sets; column j of A counts the bins in places[j]."""
    m = len(b)
    columns = np.zeros((m + 1, len(places)))
    for p in places.T:
        np.add.at(columns, (p, np.arange(len(places))), 1.0)
    columns = columns[1:]
    x, active = np.zeros(len(places)), np.zeros(len(places), bool)
    tolerance, ridge = 1e-9 * max(1.0, float(np.abs(b).sum())), 1e-10
    for _ in range(rounds or 3 * m):
        slope = columns.T @ (b - columns[:, active] @ x[active])
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= tolerance:
            break
        active[j] = True
        while True:
            on = np.flatnonzero(active)
            part = columns[:, on]
            s = np.linalg.solve(part.T @ part + ridge * np.eye(len(on)), part.T @ b)
            if (s > 0).all():
                x[:] = 0
                x[on] = s
                break
            drop = s <= 0
            step = np.min(x[on][drop] / np.maximum(x[on][drop] - s[drop], 1e-300))
            x[on] += step * (s - x[on])
            active[on[x[on] <= 1e-12]] = False
            x[~active] = 0
    return x


class Plan:
    """Where the pieces of each length go.

    Pieces stand in one row, by length and then rank; `starts` are the places in that row where an interval
    begins, with `first` the sequence of its first piece (-1: residual) and `before` the intervals' places whose
    pieces precede it in the same sequences.
    """

    def __init__(self, counts: np.ndarray, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH):
        self.window, bins = window, window // grain
        self.below = np.concatenate(([0], np.cumsum(counts)))  # pieces shorter than a length
        bin_of = -(-np.arange(window) // grain)
        have = np.bincount(bin_of, counts, bins + 1).astype(np.int64)
        bin_start = np.concatenate(([0], np.cumsum(have)))[:-1]
        places = combinations(bins, depth)
        places = places[(have[places] > 0).all(1, where=places > 0)]
        left = have.copy()
        taken = np.zeros_like(have)
        intervals, sequence = [], 0
        if len(places):
            wanted = non_negative_least_squares(places, have[1:].astype(float))
            for j in np.argsort(-wanted, kind="stable"):
                kinds, times = np.unique(places[j][places[j] > 0], return_counts=True)
                use = min(int(wanted[j] + 0.5), *(int(left[k] // t) for k, t in zip(kinds, times, strict=True)))
                if use <= 0:
                    continue
                spots = []
                for k in places[j][places[j] > 0]:
                    start = bin_start[k] + taken[k]
                    intervals.append((start, sequence, [*spots, *[-1] * (depth - 1 - len(spots))][: depth - 1], 0))
                    spots.append(start)
                    taken[k] += use
                    left[k] -= use
                sequence += use
        stream = 0
        for k in np.flatnonzero(left)[::-1]:
            start = bin_start[k] + taken[k]
            intervals.append((start, -1, [-1] * (depth - 1), stream))
            stream += int(self.tokens_before(np.array([start + left[k]]))[0] - self.tokens_before(np.array([start]))[0])
        intervals.sort(key=lambda x: x[0])
        self.starts = np.array([x[0] for x in intervals], np.int64)
        self.first = np.array([x[1] for x in intervals], np.int64)
        self.before = np.array([x[2] for x in intervals], np.int64).reshape(len(intervals), depth - 1)
        self.stream = np.array([x[3] for x in intervals], np.int64)
        self.residual_from, self.residual_ids = sequence, stream

    def length_at(self, spot: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.below, spot, side="right") - 1

    def tokens_before(self, spot: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(np.diff(self.below) * np.arange(len(self.below) - 1))))
        length = np.minimum(self.length_at(spot), len(self.below) - 2)
        return sums[length] + (spot - self.below[length]) * length

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, residual) of pieces; a residual piece may run on into the next sequence."""
        spot = self.below[length] + rank
        i = np.searchsorted(self.starts, spot, side="right") - 1
        residual = self.first[i] < 0
        j = spot - self.starts[i]
        offset = np.zeros(len(spot), np.int64)
        for column in self.before[i].T:
            offset += np.where(column >= 0, self.length_at(np.maximum(column, 0) + j), 0)
        along = self.stream[i] + self.tokens_before(spot) - self.tokens_before(self.starts[i])
        sequence = np.where(residual, self.residual_from + along // self.window, self.first[i] + j)
        return sequence, np.where(residual, along % self.window, offset), residual


# --- pieces -----------------------------------------------------------------------------------------------

PIECE_SCHEMA = "task long, seq long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE_SCHEMA.split(", ")])


def _piece_pass(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        window = p.window
        for batch in batches:
            if not batch.num_rows:
                continue
            task, seq, n, rest, rank, base, before = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("task", "seq", "n", "rest", "rank", "base", "windows_before"))
            doc, crcs = batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("crcs"))
            crc, crc_at = crcs.values.to_numpy(), crcs.offsets.to_numpy().astype(np.int64)
            full = n // window
            # Full windows
            row = np.repeat(np.arange(len(n)), full)
            k = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
            parts = [(row, k * window, np.full(len(row), window), crc[crc_at[row] + k], (task[row] + 1) * TASK_SPAN + before[row] + k, np.zeros(len(row), np.int64), np.zeros(len(row), bool))]
            # Remainders
            row = np.flatnonzero(rest > 0)
            if len(row):
                length = rest[row].astype(np.int64)
                sequence, offset, residual = p.place(length, base[row].astype(np.int64) + rank[row])
                cut = residual & (offset + length > window)
                start = full[row] * window
                head = np.where(cut, window - offset, length)
                parts.append((row, start, head, crc[crc_at[row + 1] - 1], sequence, offset, cut))
                r = row[cut]
                parts.append((r, start[cut] + head[cut], length[cut] - head[cut], np.zeros(len(r), np.int64), sequence[cut] + 1, np.zeros(len(r), np.int64), np.ones(len(r), bool)))
            row, start, length, code, sequence, offset, cut = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([
                pa.array(task[row]), pa.array(seq[row]), doc.take(pa.array(row)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)),
                pa.array(code.astype(np.int64), mask=cut), pa.array(n[row]), pa.array(sequence.astype(np.int64)), pa.array(offset.astype(np.int64)),
            ], schema=_PIECE_ARROW)

    return run


def pack_tokens(tokens: DataFrame, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH, id_bytes: int = 2) -> DataFrame:
    """The pieces of a token_table(): PIECE_SCHEMA. (task, seq) names the row of the token table a piece comes from."""
    spark = tokens.sparkSession
    by_task = materialize(tokens.where("rest > 0").groupBy("task", "rest").agg(F.count("*").alias("m")), "lengths")
    counts = np.zeros(window, np.int64)
    for row in by_task.groupBy("rest").agg(F.sum("m").alias("m")).collect():  # at most window - 1 rows
        counts[row["rest"]] = row["m"]
    plan = spark.sparkContext.broadcast(Plan(counts, window, grain, depth))
    earlier = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "rest", F.coalesce(F.sum("m").over(earlier), F.lit(0)).cast("long").alias("base"))
    # base grows with the tasks: merged by a shuffle of narrow rows, never broadcast.
    ranked = tokens.drop("ids").join(base.hint("merge"), ["task", "rest"], "left")
    pieces = materialize(ranked.withColumn("base", F.coalesce("base", F.lit(0).cast("long"))).mapInArrow(_piece_pass(plan), PIECE_SCHEMA), "pieces")
    cut = pieces.where("ids_crc32 is null").drop("ids_crc32", "doc_id", "doc_tokens")
    small = cut.count() <= BROADCAST_CUTS
    read = tokens.select("task", "seq", "doc_id", F.col("n").alias("doc_tokens"), "ids").join(F.broadcast(cut) if small else cut, ["task", "seq"])
    part = F.expr(f"substring(ids, cast({id_bytes} * start + 1 as int), cast({id_bytes} * length as int))")
    coded = read.withColumn("part", part).drop("ids").mapInArrow(_crc_pass(id_bytes), PIECE_SCHEMA)
    return pieces.where("ids_crc32 is not null").unionByName(coded)


def _crc_pass(id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{id_bytes}").astype("<u4").tobytes()) for x in batch.column(batch.schema.get_field_index("part"))]
            names = [f.name for f in _PIECE_ARROW]
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()) if c == "ids_crc32" else batch.column(batch.schema.get_field_index(c)) for c in names], schema=_PIECE_ARROW)

    return run


def packed_sequences(pieces: DataFrame, tokens: DataFrame, id_bytes: int = 2) -> DataFrame:
    """sequence_id and the ids of each sequence, unpadded: one shuffle of the ids, for writing training shards."""
    cut = pieces.join(tokens.select("task", "seq", "ids"), ["task", "seq"]).withColumn(
        "part", F.expr(f"substring(ids, cast({id_bytes} * start + 1 as int), cast({id_bytes} * length as int))")
    )
    spans = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "part")))
    return cut.groupBy("sequence_id").agg(spans.alias("parts"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    width = tokenizer(path).dtype.itemsize  # ids of large vocabularies lie in four bytes
    return pack_tokens(token_table(docs, path, end_id, window), window, id_bytes=width)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nnls_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_nnls_packing": op1_nnls_packing}
ORACLES: dict[str, str] = {}
