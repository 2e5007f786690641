"""Language identification by rank-order profiles of character n-grams.

A language's profile is its TOP most frequent n-grams (one to five characters of one word, words marked by blanks at
both ends) in rank order, learned from labelled documents. A document's own TOP n-grams are ranked likewise; the
out-of-place distance to a language sums, over the document's n-grams, how far apart the two ranks are, or a full
penalty where the language lacks the n-gram. The nearest language wins, ties by name.

Texts are lower-cased; words are runs of letters and of marks that combine with them, of any script, and all their
n-grams are counted as they stand. The learning sample is a documented bound: about SAMPLE_PER_LANGUAGE different
documents of each language, taken by hash of id and text, read whole; their n-grams are counted and summed in tasks, and
TOP rows a language come to the driver. More than MOST_LANGUAGES languages are refused.

Defined cases: null texts and texts without a letter are `und` with score 0; ties of frequency go by n-gram; rows
that repeat are judged each and learned from once; without any labelled document with a letter all are `und`; an empty
table gives an empty result; other columns are not read. Only the text is looked at to predict.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_of_id, documents, rows_of

TOP = 300
LONGEST = 5
SAMPLE_PER_LANGUAGE = 400
MOST_LANGUAGES = 10_000
#: Characters of a word that are no letters, and those that are.
_MARK, _LETTER = 1, 2

_tables: dict[str, np.ndarray] = {}


def kinds() -> np.ndarray:
    """_LETTER, _MARK or 0 of each code point."""
    if "kinds" not in _tables:
        names = (unicodedata.category(chr(i)) for i in range(0x110000))
        kind = {"L": _LETTER, "Mn": _MARK, "Mc": _MARK}
        _tables["kinds"] = np.fromiter((kind.get(c, kind.get(c[0], 0)) for c in names), np.uint8, 0x110000)
    return _tables["kinds"]


def ranked_grams(text: str, top: int | None = TOP) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text, a row of LONGEST code points each (zeros after its end), most frequent first, and their counts; none without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    kind = kinds()[points]
    if not (kind == _LETTER).any():
        return np.zeros((0, LONGEST), np.uint32), np.zeros(0, np.int64)
    # Blanks at both ends and one between words.
    s = np.full(len(points) + 2, 32, np.uint32)
    s[1:-1] = np.where(kind > 0, points, 32)
    s = s[np.concatenate(([True], (s[1:] != 32) | (s[:-1] != 32)))]
    alphabet, symbol = np.unique(s, return_inverse=True)
    symbol = symbol.astype(np.int64) + 1  # 0 is the end of an n-gram; the order of code points stays
    blank = s == 32
    before = np.concatenate(([0], np.cumsum(blank)))
    bits = int(len(alphabet)).bit_length()
    wide = LONGEST * bits > 63  # thousands of different letters: two words a key
    low = 0 if not wide else 2 * bits
    keys, tails = [], []
    for n in range(1, LONGEST + 1):
        m = len(s) - n + 1
        if m <= 0:
            break
        # An n-gram stays within a word: no blank but at its ends, and not a blank alone.
        ok = ~blank[:m] if n == 1 else before[n - 1 : n - 1 + m] == before[1 : m + 1]
        if n == 2:
            ok = ~(blank[:m] & blank[1:])
        at = np.flatnonzero(ok)
        head, tail = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for i in range(LONGEST):
            part = symbol[at + i] if i < n else 0
            if wide and i >= LONGEST - 2:
                tail = tail << bits | part
            else:
                head = head << bits | part
        keys.append(head)
        tails.append(tail)
    if wide:
        head, tail = np.concatenate(keys), np.concatenate(tails)
        order = np.lexsort((tail, head))
        head, tail = head[order], tail[order]
        first = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))))
        counts = np.diff(np.append(first, len(head)))
        head, tail = head[first], tail[first]
    else:
        every = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
        counts, head, tail = np.diff(np.append(first, len(every))), every[first], None
    if top is not None and len(counts) > 4 * top:
        # Only those that may come into the first places are ordered.
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        near = np.flatnonzero(counts >= least)
        counts, head, tail = counts[near], head[near], None if tail is None else tail[near]
    order = np.argsort(-counts, kind="stable")[:top]
    counts, head, tail = counts[order], head[order], None if tail is None else tail[order]
    letters = np.concatenate(([0], alphabet)).astype(np.uint32)
    mask = (1 << bits) - 1
    whole = LONGEST - 2 if wide else LONGEST
    out = np.zeros((len(head), LONGEST), np.uint32)
    for i in range(LONGEST):
        code = head >> bits * (whole - 1 - i) if i < whole else tail >> bits * (LONGEST - 1 - i)
        out[:, i] = letters[code & mask]
    return out, counts


def gram_text(row: np.ndarray) -> str:
    return "".join(map(chr, row[row > 0].tolist()))


class Profiles:
    """languages, and the rank of each of their n-grams in each of them (top where a language lacks it)."""

    def __init__(self, ranked: dict[str, list[str]], top: int = TOP):
        self.top, self.languages = top, sorted(ranked)
        grams = sorted({g for own in ranked.values() for g in own[:top]})
        self.grams = np.zeros((len(grams), LONGEST), np.uint32)
        for i, g in enumerate(grams):
            self.grams[i, : len(g)] = list(map(ord, g))
        self.keys = self._keys(self.grams)
        order = np.argsort(self.keys, kind="stable")
        self.grams, self.keys = self.grams[order], self.keys[order]
        at = {grams[j]: i for i, j in enumerate(order.tolist())}
        self.ranks = np.full((len(grams) + 1, len(self.languages)), top, np.int32)
        for j, lang in enumerate(self.languages):
            for rank, g in enumerate(ranked[lang][:top]):
                self.ranks[at[g], j] = rank

    @staticmethod
    def _keys(grams: np.ndarray) -> np.ndarray:
        key = np.zeros(len(grams), np.uint64)
        for i in range(LONGEST):
            key = key * np.uint64(0x9E3779B97F4A7C15) + grams[:, i]
        return key

    def places(self, grams: np.ndarray) -> np.ndarray:
        """The row of ranks of each n-gram; the last row where no profile has it."""
        none = len(self.keys)
        if not none:
            return np.zeros(len(grams), np.int64)
        key = self._keys(grams)
        at = np.minimum(np.searchsorted(self.keys, key), none - 1)
        out = np.where((self.grams[at] == grams).all(1), at, none)
        for i in np.flatnonzero((self.keys[at] == key) & (out == none)):  # another n-gram under the same key: look on
            for j in range(at[i], none):
                if self.keys[j] != key[i]:
                    break
                if (self.grams[j] == grams[i]).all():
                    out[i] = j
        return out

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return "und", 0.0
        grams, _ = ranked_grams(text, self.top)
        if not len(grams):
            return "und", 0.0
        ranks = self.ranks[self.places(grams)]
        away = np.abs(ranks - np.arange(len(grams))[:, None])
        away[ranks == self.top] = self.top
        distance = away.sum(0)
        best = np.argsort(distance, kind="stable")
        near, far = distance[best[0]], distance[best[1]] if len(best) > 1 else len(grams) * self.top
        return self.languages[best[0]], float((far - near) / far) if far else 0.0


def _judge_pass(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles: Profiles = model.value
        for batch in rows_of(batches):
            found = [profiles.judge(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


_FLUSH = 200_000


def _count_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to counts (lang, gram, n), summed for up to _FLUSH n-grams at a time."""
    sums: dict[tuple[str, str], int] = {}

    def rows():
        out = pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(list(sums.values()), pa.int64())
        ], names=["lang", "gram", "n"])
        sums.clear()
        return out

    for batch in rows_of(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams, counts = ranked_grams(text, None)
            for row, n in zip(grams, counts.tolist(), strict=True):
                key = (lang, gram_text(row))
                sums[key] = sums.get(key, 0) + n
            if len(sums) > _FLUSH:
                yield rows()
    if sums:
        yield rows()


def learn_profiles(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, top: int = TOP) -> Profiles:
    """Profiles from (doc_id, text, lang); about per_language documents of each language are read."""
    rows = labelled.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"lang holds more than {MOST_LANGUAGES} values: not a column of languages")
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n"))
    # The hash is even over its range, so a language's share of it holds that share of its documents.
    chosen = rows.join(F.broadcast(sizes.select("lang", share.alias("share"))), "lang").where((F.shiftrightunsigned("h", 11) / float(1 << 53)) < F.col("share"))
    once = chosen.groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    counts = once.mapInArrow(_count_pass, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    found: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "rank").collect():  # top rows a language
        found.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(found, top)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred, score for docs with (doc_id, text, held_out)."""
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), "held_out")
    return rows.mapInArrow(_judge_pass(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op5_rank_order_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out"))
    return identify(docs, learn_profiles(docs.where("not held_out")))


QUERIES = {"op5_rank_order_language": op5_rank_order_language}
ORACLES: dict[str, str] = {}
