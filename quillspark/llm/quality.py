"""Quality scores by Bradley-Terry pairwise ranking.

Each learned-from document of label 1 is paired with each one of label 0. The chance that one is preferred is a logistic
function of the difference of their scores, and a score is linear in a document's features, so the weights minimise
logistic loss over all these pairs (Newton steps with a ridge). A threshold is then set at a quantile of the learned
scores: the share of label 0. Scores are squashed so that the threshold stands at CUT.

Features are of the whole text, on byte and word level: shares of capitals, signs, digits, letters and white space,
word and line lengths, repeated neighbours, distinct words and lines, the longest run of one word, the share of words
that are no prose (repeats, words that end in signs, lone signs, words in capitals). All labelled documents are learned
from, each read whole, and all pairs count without being formed: the sum over pairs depends on scores by smooth functions
of a difference, so each task gives the documents of a label and a cell of scores of width 1 over to NODES Chebyshev
points of that cell (an interpolation, exact to some 1e-13), and pairs of points stand for pairs of documents. What a
round brings to the driver is bounded by the range of scores. The threshold is the exact value of its rank.
Weights are rounded at DIGITS places and each row is scored by itself, so partitions and batches change no score.

Defined cases: null and empty texts have the features of an empty text and a score from them; ties keep equal scores;
rows that repeat are scored each, and of rows that repeat a labelled doc_id one is learned from (the least by its
features); labels of documents that are not there count for nothing; without documents of both labels every score is 1;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, crc_of_id, discard, documents, flat_text, materialize, rows_of, span_hashes, table, value_at, word_spans

CUT = 0.3
RIDGE = 1e-3
NODES = 12
DIGITS = 6
_KINDS = 7


def _kinds() -> np.ndarray:
    kind = np.full(256, 6, np.uint8)  # other signs
    kind[65:91] = 0
    kind[97:123] = 1
    kind[0x80:] = 2
    kind[48:58] = 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    kind[[ord(","), ord("."), ord("'")]] = 5
    return kind


_KIND = _kinds()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _KIND[data]
    shares = []
    for k in range(_KINDS):
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == k, out=sums[1:])
        shares.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1))
    starts, ends, word_at = word_spans(data, offsets)
    words = span_hashes(BYTE_CODES[data], starts, ends)
    m = np.diff(word_at).astype(float)

    def per_row(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flag) + 1)
        np.cumsum(flag, out=sums[1:])
        return sums[word_at[1:]] - sums[word_at[:-1]]

    def same_as(step: int) -> np.ndarray:
        flag = np.zeros(len(words), bool)
        flag[step:] = words[step:] == words[:-step] if len(words) > step else flag[step:]
        for i in range(step):  # the row before has no say
            flag[(word_at[:-1] + i)[word_at[:-1] + i < word_at[1:]]] = False
        return per_row(flag)

    repeat = same_as(1) / np.maximum(m, 1)
    second = same_as(2) / np.maximum(m, 1)
    loud = per_row((_KIND[data[starts]] == 0) & (_KIND[data[np.minimum(starts + 1, max(len(data) - 1, 0))]] == 0) & (ends - starts > 1)) / np.maximum(m, 1) if len(words) else np.zeros(n)
    signed = per_row((_KIND[data[ends - 1]] == 6)) / np.maximum(m, 1) if len(words) else np.zeros(n)
    lone = per_row((ends - starts == 1) & (_KIND[data[starts]] == 6)) / np.maximum(m, 1) if len(words) else np.zeros(n)
    length = per_row(ends - starts) / np.maximum(m, 1) if len(words) else np.zeros(n)
    # Words that are no prose: repeats of the word before, words that end in signs, in capitals, or are signs alone.
    odd, longest = np.zeros(n), np.zeros(n)
    if len(words):
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        again[word_at[:-1][word_at[:-1] < len(words)]] = False
        capital = (_KIND[data[starts]] == 0) & (_KIND[data[np.minimum(starts + 1, len(data) - 1)]] == 0) & (ends - starts > 1)
        odd = per_row(again | capital | (_KIND[data[ends - 1]] == 6)) / np.maximum(m, 1)
        place = np.arange(len(words))
        run = place - np.maximum.accumulate(np.where(again, 0, place))
        full = m > 0
        longest[full] = np.maximum.reduceat(run, word_at[:-1][full]) / m[full]
    distinct, top = np.ones(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True)):
        if b - a > 1:
            s = np.sort(words[a:b])
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            run = np.diff(at)
            distinct[i] = len(run) / (b - a) ** 0.85
            top[i] = run.max() / (b - a)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == 10, out=breaks[1:])
    lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
    return np.column_stack([
        *shares, repeat, second, loud, signed, lone, np.minimum(length, 40) / 10, np.minimum(distinct, 3), top,
        np.log1p(size) / 10, np.log1p(m) / 10, lines / np.maximum(m, 1),
        odd, np.minimum(1, 4 * odd), longest, np.minimum(1, 8 * loud), np.minimum(1, 8 * signed), np.minimum(1, 8 * repeat), np.minimum(1, 8 * lone),
    ])


_POINTS = np.cos((np.arange(NODES) + 0.5) * np.pi / NODES)


def _chebyshev(at: np.ndarray) -> np.ndarray:
    return np.cos(np.arange(NODES) * np.arccos(np.clip(at, -1, 1))[:, None])


#: Values of the Chebyshev polynomials to the share of each point.
_TO_SHARES = _chebyshev(_POINTS).T * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES

#: By label and cell of scores: what its points hold of counts and features, and the sums of products of two features.
Sums = dict[tuple[int, int], np.ndarray]


def cell_sums(quality: np.ndarray, z: np.ndarray, weights: np.ndarray, into: Sums) -> None:
    """Adds rows of standardised features to the sums of their labels and cells."""
    raw = z @ weights
    cell = np.floor(raw)
    shares = _chebyshev(2 * (raw - cell) - 1) @ _TO_SHARES
    one = np.column_stack((np.ones(len(z)), z))
    upper = np.triu_indices(z.shape[1])
    order = np.lexsort((cell, quality))
    keys = np.column_stack((quality, cell))[order]
    ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(z)]
    for start, end in zip([0, *ends[:-1]], ends, strict=True):
        rows = order[start:end]
        found = np.concatenate(((shares[rows].T @ one[rows]).ravel(), (z[rows].T @ z[rows])[upper]))
        key = (int(keys[start, 0]), int(keys[start, 1]))
        into[key] = into[key] + found if key in into else found


def _newton(sums: Sums, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss over all pairs with the ridge, its slope downwards, and its bend as it is when each pair of cells has one."""
    d = len(weights)
    upper = np.triu_indices(d)
    sides = []
    for q in (1, 0):
        cells = sorted(c for label, c in sums if label == q)
        held = [sums[q, c] for c in cells]
        points = np.concatenate([c + (_POINTS + 1) / 2 for c in cells])
        nodes = np.concatenate([h[: NODES * (1 + d)].reshape(NODES, 1 + d) for h in held])
        square = np.zeros((len(cells), d, d))
        square[:, upper[0], upper[1]] = square[:, upper[1], upper[0]] = [h[NODES * (1 + d) :] for h in held]
        sides.append((points, nodes[:, 0], nodes[:, 1:], nodes.reshape(len(cells), NODES, 1 + d).sum(1), square))
    (at, count, x, cells, square), (at0, count0, x0, cells0, square0) = sides
    pairs = count.sum() * count0.sum()
    gap = at0 - at[:, None]
    wrong = np.exp(-np.logaddexp(0, -gap))  # chance of the wrong order
    loss = count @ np.logaddexp(0, gap) @ count0 / pairs + RIDGE / 2 * weights @ weights
    slope = (x.T @ (wrong @ count0) - x0.T @ (count @ wrong)) / pairs - RIDGE * weights
    each = (count[:, None] * (wrong * (1 - wrong)) * count0).reshape(len(cells), NODES, len(cells0), NODES).sum((1, 3))
    each = np.maximum(each / (cells[:, :1] * cells0[:, 0]), 0)
    across = cells[:, 1:].T @ each @ cells0[:, 1:]
    bend = np.tensordot(each @ cells0[:, 0], square, 1) + np.tensordot(cells[:, 0] @ each, square0, 1) - across - across.T
    return loss, slope, bend / pairs + RIDGE * np.eye(d)


class Ranker:
    """Weights of standardised features and the threshold; score(x) in 0..1 with the threshold at CUT."""

    def __init__(self, good: np.ndarray, bad: np.ndarray, cut: float = CUT):
        """Learned from rows of features in memory."""
        self.cut, self.ready = cut, len(good) > 0 and len(bad) > 0
        if not self.ready:
            return
        both, quality = np.concatenate((good, bad)), np.repeat((1, 0), (len(good), len(bad)))
        self.standardise(both.mean(0), both.std(0))

        def sums(weights: np.ndarray) -> Sums:
            found: Sums = {}
            cell_sums(quality, self.standard(both), weights, found)
            return found

        self.fit(sums)
        raw = np.sort(self.raw(both))
        self.squash(raw[len(bad) - 1], raw[len(bad)], raw.std())

    def standardise(self, mean: np.ndarray, spread: np.ndarray) -> None:
        # Rounded, so that the order in which rows were summed does not show.
        self.mean, self.scale = (np.array([float(f"{v:.9g}") for v in vs]) for vs in (mean, np.maximum(spread, 1e-6)))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def fit(self, sums: Callable[[np.ndarray], Sums]) -> None:
        """Weights of the least loss over all pairs; sums gives the sums of all rows by their scores under weights."""
        base = weights = step = np.zeros(len(self.mean))
        before = np.inf
        while True:
            loss, slope, bend = _newton(sums(weights), weights)
            if loss >= before:  # too far: half of the way
                step = step / 2
            else:
                base, before, step = weights, loss, np.linalg.solve(bend, slope)
            weights = base + step
            if np.abs(step).max() < 1e-7:
                break
        self.weights = np.round(weights, DIGITS)

    def squash(self, below: float, above: float, width: float) -> None:
        """The last score of the share of label 0 and the next one (a gap between the labels is split evenly), and the spread of scores."""
        self.threshold, self.width = float(below + above) / 2, max(1e-6, float(f"{width:.9g}"))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (self.standard(x) * self.weights).sum(1)  # by row: the same in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.ones(len(x))
        return 1 / (1 + np.exp(np.clip(-(self.raw(x) - self.threshold) / self.width + np.log(1 / self.cut - 1), -60, 60)))


def _feature_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches):
        x = features(*flat_text(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sum_rows(sums: Sums) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.list_(pa.float64()))], names=["quality", "cell", "sums"])


_SUM_SCHEMA = "quality int, cell long, sums array<double>"


def _sum_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker, weights = model.value
        found: Sums = {}
        for batch in batches:
            if batch.num_rows:
                cell_sums(batch.column("quality").to_numpy(), ranker.standard(_matrix(batch)), weights, found)
        yield _sum_rows(found)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Sums = {}
    for batch in batches:
        for q, c, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            v = v.values.to_numpy()
            found[q, c] = found[q, c] + v if (q, c) in found else v.copy()
    yield _sum_rows(found)


def _raw_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.value.raw(_matrix(batch)))], names=["raw"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Ranker:
    """A ranker from all documents (doc_id, text) that labels (doc_id, quality) mark."""
    spark = docs.sparkSession
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Features take the place of texts before anything is shuffled.
    found = texts.mapInArrow(_feature_pass, "doc_id long, x array<double>").join(known, "doc_id")
    rows = materialize(found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("quality", "x"), "features")
    counts = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    ranker = Ranker(np.zeros((0, 0)), np.zeros((0, 0)))
    ranker.ready = len(counts) == 2
    if ranker.ready:
        width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
        each = [F.col("x")[i] for i in range(width)]
        spread = rows.agg(*map(F.avg, each), *map(F.stddev_pop, each)).first()
        ranker.standardise(np.array(spread[:width]), np.array(spread[width:]))

        def sums(weights: np.ndarray) -> Sums:
            model = spark.sparkContext.broadcast((ranker, weights))
            parts = rows.mapInArrow(_sum_pass(model), _SUM_SCHEMA).repartition("quality", "cell").mapInArrow(_add_up, _SUM_SCHEMA)
            got = {(r["quality"], r["cell"]): np.array(r["sums"]) for r in parts.collect()}
            model.destroy()
            return got

        ranker.fit(sums)
        raw = materialize(rows.mapInArrow(_raw_pass(spark.sparkContext.broadcast(ranker)), "raw double"), "raw")
        ranker.squash(value_at(raw, counts[0] - 1), value_at(raw, counts[0]), raw.agg(F.stddev_pop("raw")).first()[0])
        discard(raw)
    discard(rows)
    return ranker


def _score_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker: Ranker = model.value
        for batch in rows_of(batches):
            s = ranker.score(features(*flat_text(batch)))
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s), pa.array((s >= ranker.cut).astype(np.int32))], names=[*names, "score", "predicted"])

    return run


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score, predicted for docs with (doc_id, held_out, text)."""
    model = docs.sparkSession.sparkContext.broadcast(ranker)
    rows = docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_pass(model), "doc_id long, held_out boolean, score double, predicted int")


def _held_out(df: DataFrame):
    return crc_of_id(df["doc_id"]) % 5 == 0


def learned_from(spark, docs: DataFrame, sf_dir: str) -> Ranker:
    labels = table(spark, sf_dir, "labels")
    return learn(docs.where(~_held_out(docs)), labels.where(~_held_out(labels)))


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of docs, with all their columns, that score at the cut or above; by text, in one pass."""
    model = docs.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r: Ranker = model.value
        for batch in rows_of(batches):
            yield batch.filter(pa.array(r.score(features(*flat_text(batch))) >= r.cut))

    return docs.mapInArrow(run, docs.schema)


def op8_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    ranker = learned_from(spark, docs, sf_dir)
    return score(docs.select("doc_id", _held_out(docs).alias("held_out"), "text"), ranker)


QUERIES = {"op8_bradley_terry_quality": op8_bradley_terry_quality}
ORACLES: dict[str, str] = {}
