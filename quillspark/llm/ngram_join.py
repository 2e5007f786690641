"""N-gram Jaccard join with token-combination prefixes, exact, for connected near-duplicate classes.

A document is the set of its distinct k-word shingles ("tokens", 64-bit hashes). Tokens are counted over the
whole corpus and split into two classes: rare ones and frequent ones, the latter in levels by the logarithm of
their count. Every set is ordered rare first, then by level. For a set of n tokens and a similarity t, with

    E = n - ceil(t n)            tokens that a partner may lack, and
    D = floor((1 - t) n / t)     tokens in which a partner may differ in all,

* if more than E tokens are rare, the first E + 1 rare ones are indexed singly;
* else all r rare ones are indexed singly, and the prefix is extended to E - r + (c - 1) (D - r + 1) + 1 frequent
  tokens, whose runs of c neighbours are indexed as combinations. When no rare token is shared, of the frequent
  tokens in the prefix of that set whose prefix ends first x <= E - r are not shared, and y more of the partner's
  stand between them, x + y <= D - r; these part the others into x + y + 1 runs at most, so one run has c tokens or
  more and is the same in both.

c grows with the set: the largest up to LARGEST for which a set of that size is long enough. Sets near the size
where c changes are indexed for both, so partners always have one in common.

Sharing an indexed key makes a bucket. A bucket of at most SMALL sets yields all its pairs of fitting sizes. A larger
one is first dealt into blocks of BLOCK sets of about one size, each with the block's own sets and a pivot of each
size within reach, so its rows grow with the bucket and not with its square; a forest of the nearest sets in each
block is verified on whole texts and makes classes. Only then, where a bucket still holds several classes, the sets
outside its largest class are compared with all its sets of fitting sizes. Comparisons are by parity sketches (a bit
for each of 2n ranges of hashes: whether it holds an odd number of tokens; two sets differ in at least as many
tokens as their sketches do in bits), which move only for the sets of a block: pairs that a sketch refutes are never
formed, and every other pair of different classes is verified, so no link between different sets is lost while
copies are not expanded into pairs. Equal sets are joined through their digest alone.

Defined cases: null or empty text and text without words has an empty set, linked with nothing; fewer words than
k make one token of the whole sequence; rows that repeat a doc_id stand for one document and each get its class;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWERED_CODES, columns_of, discard, documents, flat_text, materialize, mix64, rows_of, span_hashes, word_spans
from .components import connected_components

#: Tokens in fewer documents than this are rare.
RARE_BELOW = 16
#: Tokens of one combination at most.
LARGEST = 3
#: Slots of the table of levels that each task holds, a byte each. Tokens that share a slot share its higher level:
#: any classes of tokens give the same links, so the table needs no more room for a larger corpus.
LEVEL_SLOTS = 1 << 24
#: Buckets up to this size yield all their pairs at once.
SMALL = 8
#: Sets of a large bucket that are compared as one block.
BLOCK = 512
#: Sets of a bucket that one block of the rest is compared with in one task.
CHUNK = 4096
#: Pairs of a bucket's rest with its sets from which on the nearest are tried before all.
FEW_PAIRS = 1 << 14
#: Large buckets by which a set is compared at first: those of its least keys.
FIRST_BUCKETS = 3
#: Bits of the largest sketch.
MOST_BITS = 1 << 15
#: Members of one bucket that a task holds before it passes them on.
BUFFER = 1 << 18
#: Candidate documents up to which their ids are broadcast rather than joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of text whose tokens are counted as one range, and the bits of the number of ranges at most.
RANGE_BYTES, MOST_RANGE_BITS = 1 << 25, 24


def token_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; words lose A-Z case only."""
    starts, ends, word_at = word_spans(data, offsets)
    words = span_hashes(LOWERED_CODES[data], starts, ends)
    grams = np.zeros(0, np.uint64)
    if len(words) >= k:
        m = len(words) - k + 1
        grams = words[:m].copy()
        for i in range(1, k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m]
        grams = mix64(grams)
    out = []
    for a, b in zip(word_at[:-1].tolist(), word_at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s if len(s) == 1 else s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), 1)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def allowed(n, num: int, den: int):
    """E and D of sets of n tokens at similarity num / den."""
    return n - -(-num * n // den), (den - num) * n // num


@cache
def least_sizes(num: int, den: int) -> tuple[int, ...]:
    """For c = 1, 2, .. up to LARGEST: the size from which on all sets are long enough for runs of c; fewer entries if none is."""
    out, tried = [0], 4096
    for c in range(2, LARGEST + 1):
        short = [n for n in range(1, tried) if (e := allowed(n, num, den))[0] + (c - 1) * (e[1] + 1) + 1 > n]
        if short and short[-1] > tried // 2:
            break
        # Above the last short one both sides grow in proportion.
        out.append(max(out[-1], short[-1] + 1 if short else 0))
    return tuple(out)


def signatures(tokens: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index keys of one set: single rare tokens and runs of neighbouring frequent ones."""
    n = len(tokens)
    lack, differ = allowed(n, num, den)
    if differ == 0:
        return tokens[:0]  # only an equal set is similar enough
    rare = tokens[level == 0]
    if len(rare) > lack:
        return rare[: lack + 1]
    order = np.argsort(level[level > 0], kind="stable")
    frequent = tokens[level > 0][order]
    least = least_sizes(num, den)
    keys, r = [rare], len(rare)
    for c, size in enumerate(least, 1):
        # A partner has num / den of the tokens at least and den / num of them at most.
        if n < size or (c < len(least) and n * num >= least[c] * den):
            continue
        part = frequent[: lack - r + (c - 1) * max(0, differ - r + 1) + 1]
        m = len(part) - c + 1
        if m > 0:
            run = part[:m]
            for i in range(1, c):
                run = mix64(run * np.uint64(0xBF58476D1CE4E5B9) + part[i : i + m])
            keys.append(run if c < 3 else mix64(run + np.uint64(c)))
    return np.concatenate(keys)


# --- counts -----------------------------------------------------------------------------------------------

_COUNT_SCHEMA = "range int, keys binary, doc_id long, n long, digest binary, sketch binary"
_COUNT_ARROW = pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in equal ranges of hashes, 64 ranges at least and about two a token."""
    if not len(tokens):
        return b""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(rows: list[bytes], size: int) -> np.ndarray:
    """Sketches of one size or more, brought to that size, a row of 64-bit words each."""
    out = np.zeros((len(rows), size // 8), np.uint64)
    for i, r in enumerate(rows):
        if len(r) > size:
            odd = np.unpackbits(np.frombuffer(r, np.uint8)).reshape(8 * size, -1).sum(1) & 1
            r = np.packbits(odd.astype(np.uint8)).tobytes()
        out[i] = np.frombuffer(r, np.uint64)
    return out


def _count_pass(k: int, range_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in rows_of(batches):
            sets = token_sets(*flat_text(batch), k)
            ids = batch.column(0).to_pylist()
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            fresh = []
            for s, d in zip(sets, digests, strict=True):
                if d not in seen:
                    seen.add(d)
                    fresh.append(s)
            every = np.sort(np.concatenate(fresh)) if fresh else np.zeros(0, np.uint64)
            where = (every >> np.uint64(64 - range_bits)).astype(np.int32)
            low = ((every >> np.uint64(32 - range_bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            at = np.searchsorted(where, np.arange((1 << range_bits) + 1)).tolist()
            rows = [(r, low[a:b].tobytes()) for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
            spread = [int.from_bytes(d[:2], "big") % (1 << range_bits) for d in digests]
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([
                pa.array([r for r, _ in rows] + spread, pa.int32()), pa.array([b for _, b in rows] + [None] * len(ids), pa.binary()),
                pa.array(none + ids, pa.int64()), pa.array(none + [len(s) for s in sets], pa.int64()), pa.array(none + digests, pa.binary()),
                pa.array(none + [sketch(s) for s in sets], pa.binary()),
            ], schema=_COUNT_ARROW)

    return run


_COUNTED_SCHEMA = "key long, count long, doc_id long, n long, digest binary, sketch binary"
_COUNTED_ARROW = pa.schema([("key", pa.int64()), ("count", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])


def _counted(rare_below: int):
    def run(table: pa.Table) -> pa.Table:
        r = table.column("range")[0].as_py()
        blobs = table.filter(pa.compute.is_valid(table.column("keys"))).column("keys").to_pylist()
        docs = table.filter(pa.compute.is_null(table.column("keys")))
        keys, counts = np.unique(np.frombuffer(b"".join(blobs), np.uint32), return_counts=True)
        del blobs
        frequent = counts >= rare_below
        keys, counts = keys[frequent].astype(np.int64) | (r << 32), counts[frequent]
        m, d = len(keys), docs.num_rows
        none_d, none_m = pa.nulls(d, pa.int64()), pa.nulls(m, pa.int64())
        return pa.Table.from_arrays([
            pa.chunked_array([pa.array(keys), none_d]), pa.chunked_array([pa.array(counts.astype(np.int64)), none_d]),
            pa.chunked_array([none_m, *docs.column("doc_id").chunks]), pa.chunked_array([none_m, *docs.column("n").chunks]),
            pa.chunked_array([pa.nulls(m, pa.binary()), *docs.column("digest").chunks]), pa.chunked_array([pa.nulls(m, pa.binary()), *docs.column("sketch").chunks]),
        ], schema=_COUNTED_ARROW)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _range_bits(docs: DataFrame) -> int:
    """Ranges of the counting shuffle: four a shuffle partition, and as many as keep a range's tokens small."""
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    most = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), text // RANGE_BYTES)
    return min(MOST_RANGE_BITS, max(8, int(most).bit_length()))


def _levels(counted: DataFrame, range_bits: int, slots: int) -> np.ndarray:
    """The level of each slot of tokens: 0 where all are rare."""
    kept = 32 + range_bits  # bits of a key
    bits = slots.bit_length() - 1
    slot = F.shiftrightunsigned("key", kept - bits) if kept > bits else F.shiftleft("key", bits - kept)
    level = F.floor(F.log2(F.col("count"))).cast("byte")
    found = counted.where("key is not null").groupBy(slot.cast("int").alias("slot")).agg(F.max(level).alias("level")).toArrow()
    out = np.zeros(slots, np.uint8)
    out[found.column("slot").to_numpy()] = found.column("level").to_numpy()
    return out


# --- candidates -------------------------------------------------------------------------------------------

_SIG_ARROW = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64())])


def _signature_pass(k: int, num: int, den: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        down = np.uint64(64 - len(table).bit_length() + 1)
        seen = set()
        for batch in rows_of(batches):
            ids, sets = batch.column(0).to_pylist(), token_sets(*flat_text(batch), k)
            sigs, ns, owners = [], [], []
            for doc, s in zip(ids, sets, strict=True):
                d = xxhash.xxh3_128_digest(s.tobytes())
                if d in seen:
                    continue
                seen.add(d)
                level = table[(s >> down).astype(np.int64)]
                own = signatures(s, level, num, den)
                if len(own):
                    sigs.append(own)
                    ns.append(len(s))
                    owners.append(doc)
            if sigs:
                counts = [len(x) for x in sigs]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ns, np.int64), counts)), pa.array(np.repeat(np.array(owners, np.int64), counts)),
                ], schema=_SIG_ARROW)

    return run


_CAND_SCHEMA = "sig long, n long, a long, b long"
_CAND_ARROW = pa.schema([("sig", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _bucket_pass(num: int, den: int, small: int, buffer: int):
    """Sorted (sig, n, doc_id) rows to candidate pairs (a, b) and, of large buckets, members (sig, n, a, null)."""

    def members(sig, n, doc):
        m = len(sig)
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(n), pa.array(doc), pa.nulls(m, pa.int64())], schema=_CAND_ARROW)

    def emit(sig, n, doc):
        head = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(head, len(sig)))
        head, size = head[size > 1], size[size > 1]
        firsts, seconds = [], []
        few = size <= small
        for step in range(1, small):
            at = _spread(head[few], np.maximum(size[few] - step, 0))
            firsts.append(at)
            seconds.append(at + step)
        x, y = np.concatenate(firsts), np.concatenate(seconds)
        fits = (num * n[y] <= den * n[x]) & (doc[x] != doc[y])
        x, y = doc[x[fits]], doc[y[fits]]
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
        member = _spread(head[~few], size[~few])
        m = len(member)
        if len(pairs) or m:
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(sig[member])]), pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(n[member])]),
                pa.array(np.concatenate((pairs[:, 0], doc[member]))), pa.concat_arrays([pa.array(pairs[:, 1].copy()), pa.nulls(m, pa.int64())]),
            ], schema=_CAND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate((r, batch.column(i).to_numpy())) for i, r in enumerate(rest)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))  # the last bucket may go on in the next batch
            yield from emit(*(c[:last] for c in now))
            rest = [c[last:] for c in now]
            if len(rest[0]) > buffer:
                # More than a buffer of one bucket: members; the last small + 1 stay, so that what follows is large too.
                yield members(*(c[: -small - 1] for c in rest))
                rest = [c[-small - 1 :] for c in rest]
        if len(rest[0]):
            yield from emit(*rest)

    return run


def _spread(head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """head, head + 1, .. for size entries each, end to end."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    return np.repeat(head - before, size) + np.arange(total)


def _nearest_forest(away: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of nearest pairs over rows in classes; away holds distances, or FAR where a pair is none."""
    _, group = np.unique(comp, return_inverse=True)
    xs, ys = [], []
    while True:
        cross = np.where(group[:, None] != group[None, :], away, _FAR)
        to = cross.argmin(1)
        least = cross[np.arange(len(cross)), to]
        order = np.lexsort((np.arange(len(group)), least, group))
        first = order[np.concatenate(([True], group[order][1:] != group[order][:-1]))]
        first = first[least[first] < _FAR]
        if not len(first):
            break
        xs.append(first)
        ys.append(to[first])
        root = np.arange(group.max() + 1)
        for x, y in zip(group[first].tolist(), group[to[first]].tolist(), strict=True):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]
        group = root[group]
    none = np.zeros(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


_FAR = 1 << 30


def _distances(n, rows: list[bytes], x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bits in which the sketches of x and y differ, FAR where sizes or sketches refute the pair."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    away = np.full((len(x), len(y)), _FAR, np.int32)
    # Sizes that fit differ by less than half, so their sketches are of one size or of neighbouring sizes.
    for width in np.unique(size).tolist():
        here = [np.flatnonzero((size[part] == width) | (size[part] == 2 * width)) for part in (x, y)]
        if not len(here[0]) or not len(here[1]):
            continue
        words = [folded([rows[i] for i in part[h]], width) for part, h in zip((x, y), here, strict=True)]
        step = max(1, 4_000_000 // (len(here[1]) * width // 8 + 1))
        right, own = words[1], y[here[1]]
        for a in range(0, len(here[0]), step):
            at = here[0][a : a + step]
            part = x[at]
            bits = np.bitwise_count(words[0][a : a + step, None, :] ^ right[None, :, :]).sum(2, dtype=np.int32)
            most = (den - num) * (n[part][:, None] + n[own][None, :]) // (den + num)
            fits = (bits <= most) & (num * np.maximum(n[part][:, None], n[own][None, :]) <= den * np.minimum(n[part][:, None], n[own][None, :]))
            fits &= (size[part] == width)[:, None] | (size[own] == width)[None, :]
            grid = np.ix_(at, here[1])
            away[grid] = np.where(fits, np.minimum(away[grid], bits), away[grid])
    return away


def _pairs_of(doc: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    x, y = doc[x], doc[y]
    both = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def _group_pass(found):
    """A pass over rows sorted by group: found(n, doc, comp, rest, sketches) gives the pairs (x, y) of rows of each group.

    Rows are (group columns.., n, doc_id, comp, rest, sketch). A group is bounded by BLOCK and CHUNK and may go on in the
    next batch; a task goes through all of its groups in one go, which most of them are too small to be worth a call of.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def pairs(table: pa.Table, ends: list[int]) -> pa.RecordBatch:
            n, doc, comp, flag = (table.column(c).to_numpy() for c in ("n", "doc_id", "comp", "rest"))
            sketches, xs, ys, at = table.column("sketch").to_pylist(), [], [], 0
            for end in ends:
                x, y = found(n[at:end], doc[at:end], comp[at:end], flag[at:end], sketches[at:end])
                xs.append(x + at)
                ys.append(y + at)
                at = end
            return _pairs_of(doc, np.concatenate(xs), np.concatenate(ys))

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            keys = [table.column(c).to_numpy() for c in table.schema.names[: table.schema.get_field_index("n")]]
            ends = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1 if keys else np.zeros(0, np.int64)
            if len(ends):
                yield pairs(table.slice(0, int(ends[-1])), ends.tolist())
            rest = table.slice(int(ends[-1]) if len(ends) else 0)
        if rest is not None and rest.num_rows:
            yield pairs(rest, [rest.num_rows])

    return run


def _in_groups(rows: DataFrame, keys: list[str], found) -> DataFrame:
    """Pairs (a, b) of rows (keys.., doc_id, comp, rest, n, sketch) of the same keys."""
    dealt = rows.select(*keys, "n", "doc_id", "comp", "rest", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(_group_pass(found), "a long, b long").distinct()


def _forest(num: int, den: int):
    """A forest of the nearest pairs of one block."""

    def found(n, doc, comp, rest, sketches):
        every = np.arange(len(n))
        away = _distances(n, sketches, every, every, num, den)
        away[doc[:, None] == doc[None, :]] = _FAR
        return _nearest_forest(away, doc)

    return found


def _of_rest(num: int, den: int, every: bool):
    """Pairs of a block of the rest with other sets of other classes: all that no sketch refutes, or each one's nearest."""

    def found(n, doc, comp, rest, sketches):
        x, y = np.flatnonzero(rest), np.flatnonzero(~rest)
        if not len(x) or not len(y):
            return x[:0], y[:0]
        away = _distances(n, sketches, x, y, num, den)
        away[comp[x][:, None] == comp[y][None, :]] = _FAR
        if every:
            i, j = np.nonzero(away < _FAR)
        else:
            j = away.argmin(1)
            i = np.flatnonzero(away[np.arange(len(x)), j] < _FAR)
            j = j[i]
        return x[i], y[j]

    return found


def _refute_pass(num: int, den: int):
    """Pairs (a, b, n_a, n_b, sketch_a, sketch_b) that the sketches do not refute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = ((den - num) * (na + nb) // (den + num)).tolist()
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if len(x) != len(y):
                    x, y = (folded([z], min(len(x), len(y)))[0].tobytes() for z in (x, y))
                if (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= most[i]:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


# --- verification -----------------------------------------------------------------------------------------


def _overlap(left: np.ndarray, right: np.ndarray) -> int:
    short, long = (left, right) if len(left) <= len(right) else (right, left)
    if not len(short):
        return 0
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    return int((long[at] == short).sum())


def _verify_pass(k: int, num: int, den: int):
    """Rows (a, b, text of b, text of a), those of one a together, to the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in rows_of(batches):
            keep, first = [], batch.column(batch.schema.get_field_index("text_a"))
            sets = token_sets(*flat_text(batch), k)
            for i, (a, right) in enumerate(zip(batch.column(0).to_pylist(), sets, strict=True)):
                if a != last:
                    last = a
                    left = token_sets(*flat_text(pa.record_batch([first.slice(i, 1)], names=["text"])), k)[0]
                both = _overlap(left, right)
                if both and den * both >= num * (len(left) + len(right) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _verified(docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar enough, judged on whole texts.

    Texts are moved rather than token sets: compressed they are a fraction of the hashes' size.
    """
    need = materialize(pairs.select(F.col("a").alias("need")).union(pairs.select("b")).distinct(), "need")
    small = need.count() <= BROADCAST_IDS
    texts = materialize(_texts(docs).join(F.broadcast(need) if small else need, F.col("doc_id") == F.col("need"), "left_semi"), "texts")
    right = pairs.join(texts.select(F.col("doc_id").alias("b"), "text"), "b")
    both = right.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text", "text_a")
    return materialize(both.mapInArrow(_verify_pass(k, num, den), "a long, b long"), "links")


def _of_class(num: int, den: int):
    """The size class of n: sets within reach of one another are at most two classes apart."""
    return F.floor(F.log(F.col("n")) / F.lit(0.5 * log(den / num))).cast("int")


def _spread_join(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """rows (with doc_id) joined to a row for each key, with a hot key's rows in SALTS tasks."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"]).drop("salt")


SALTS = 16


def _dealt(count, part: int):
    """How many parts so many sets make, and in which of them a set is."""
    parts = F.ceil(count / part).cast("int")
    return parts, lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("parts")).cast("int")


def _first_pairs(members: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of a forest in each block of members (sig, n, doc_id); rows grow with the members."""
    sized = members.withColumn("cls", _of_class(num, den))
    parts, block = _dealt(F.count("*"), BLOCK)
    stats = materialize(sized.groupBy("sig", "cls").agg(parts.alias("parts"), F.min("doc_id").alias("pivot")), "blocks")
    own = _spread_join(sized, stats, ["sig", "cls"]).select("sig", "cls", block(1).alias("block"), "doc_id")
    near = stats.select("sig", F.explode(F.sequence(F.col("cls"), F.col("cls") + 2)).alias("cls"), F.col("pivot").alias("doc_id"))
    pivots = near.join(stats.select("sig", "cls", "parts"), ["sig", "cls"])
    pivots = pivots.select("sig", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "doc_id")
    blocks = own.union(pivots).join(sketches, "doc_id").withColumn("comp", F.col("doc_id")).withColumn("rest", F.lit(True))
    return _in_groups(blocks, ["sig", "cls", "block"], _forest(num, den))


def _rest_pairs(members: DataFrame, sketches: DataFrame, classes: DataFrame, num: int, den: int, every: bool) -> DataFrame:
    """Pairs between classes of one bucket: its sets outside its largest class against all of fitting size."""
    placed = members.join(classes, F.col("doc_id") == F.col("id"), "left").select("sig", "n", "doc_id", F.coalesce("component_id", "doc_id").alias("comp"))
    placed = materialize(placed.withColumn("cls", _of_class(num, den)), "placed")
    code = [F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    shares = placed.groupBy("sig", "comp").agg(F.count("*").alias("m"), *code)
    torn = shares.groupBy("sig").agg(
        F.count("*").alias("classes"), F.max_by(F.struct("comp", "m", "h1", "h2"), F.struct("m", "comp")).alias("most"), F.sum("m").alias("m"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2")
    ).where("classes > 1")
    if not every:  # where few sets are left apart, all their pairs are as cheap as the nearest
        torn = torn.where((F.col("m") - F.col("most.m")) * F.col("m") > FEW_PAIRS)
    # Buckets with the same sets outside the same largest class are one: their sets are compared once and not once a key.
    rest_of = [F.col("most.comp").alias("main"), F.col("m") - F.col("most.m"), *(F.col(f"h{i}").bitwiseXOR(F.col(f"most.h{i}")) for i in (1, 2))]
    torn = materialize(torn.select("sig", rest_of[0], F.xxhash64(*rest_of).alias("group")), "torn")
    held = _spread_join(placed, torn, ["sig"]).select(F.col("group").alias("sig"), "main", "doc_id", "comp", "cls").distinct()
    held = materialize(held, "held")
    rest = held.where("comp <> main")
    parts, block = _dealt(F.count("*"), BLOCK)
    chunks, _ = _dealt(F.count("*"), CHUNK)
    rest_sizes = rest.groupBy("sig", "cls").agg(parts.alias("blocks")).withColumn("other", F.explode(F.sequence(F.col("cls") - 2, F.col("cls") + 2)))
    all_sizes = held.groupBy("sig", F.col("cls").alias("other")).agg(chunks.alias("chunks"))
    met = materialize(rest_sizes.join(all_sizes, ["sig", "other"]), "met")
    of_rest = met.groupBy("sig", "cls").agg(F.first("blocks").alias("parts"), F.collect_list(F.struct("other", "chunks")).alias("met"))
    of_all = met.groupBy("sig", "other").agg(F.first("chunks").alias("parts"), F.collect_list(F.struct(F.col("cls").alias("small"), "blocks")).alias("met"))
    left = _spread_join(rest, of_rest, ["sig", "cls"]).withColumn("block", block(1)).withColumn("x", F.explode("met"))
    left = left.select("sig", "cls", "block", F.col("x.other").alias("other"), F.explode(F.sequence(F.lit(0), F.col("x.chunks") - 1)).alias("chunk"), "doc_id", "comp", F.lit(True).alias("rest"))
    right = _spread_join(held.withColumn("other", F.col("cls")).drop("cls"), of_all, ["sig", "other"]).withColumn("chunk", block(2)).withColumn("x", F.explode("met"))
    right = right.select("sig", F.col("x.small").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("x.blocks") - 1)).alias("block"), "other", "chunk", "doc_id", "comp", F.lit(False).alias("rest"))
    both = left.unionByName(right).join(sketches, "doc_id")
    return _in_groups(both, ["sig", "cls", "block", "other", "chunk"], _of_rest(num, den, every))


def _classes(texts: DataFrame, k: int, num: int, den: int, rare_below: int, small: int) -> DataFrame:
    """doc_id, n_shingles, component_id of texts (doc_id, text) whose ids are unique and not null."""
    spark = texts.sparkSession
    bits = _range_bits(texts)
    counted = materialize(
        texts.mapInArrow(_count_pass(k, bits), _COUNT_SCHEMA).groupBy("range").applyInArrow(_counted(rare_below), _COUNTED_SCHEMA), "tokens"
    )
    rows = counted.where("key is null").select("doc_id", "n", "digest")
    sketches = counted.where("key is null").select("doc_id", "n", "sketch")
    frequent = counted.where("key is not null").count()
    slots = min(LEVEL_SLOTS, max(1 << 12, 1 << (16 * frequent).bit_length()))
    levels = spark.sparkContext.broadcast(_levels(counted, bits, slots))

    keys = texts.mapInArrow(_signature_pass(k, num, den, levels), "sig long, n long, doc_id long")
    found = materialize(
        keys.repartition("sig").sortWithinPartitions("sig", "n", "doc_id").mapInArrow(_bucket_pass(num, den, small, BUFFER), _CAND_SCHEMA), "candidates"
    )
    members = found.where("b is null").select("sig", "n", F.col("a").alias("doc_id")).distinct()

    # First: pairs of small buckets, and a forest of each set's first large buckets.
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("sig"))
    first = materialize(members.withColumn("turn", turn).where(F.col("turn") <= FIRST_BUCKETS).drop("turn"), "members")
    few = found.where("b is not null").select("a", "b").distinct()
    of = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    drawn = few.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    close = _first_pairs(first, sketches, num, den)
    tested = materialize(drawn.mapInArrow(_refute_pass(num, den), "a long, b long").union(close).distinct(), "pairs")
    links = _verified(texts, tested, k, num, den)

    equal = rows.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1")
    copies = rows.join(equal, "digest").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).where("a <> b")
    classes = materialize(connected_components(links.union(copies)), "classes")

    # Then: what large buckets still hold apart; the nearest once more, and at last every pair that may be similar.
    for every in (False, True):
        more = materialize(_rest_pairs(members, sketches, classes, num, den, every).join(tested, ["a", "b"], "left_anti"), "more")
        if more.isEmpty():
            if every:
                break
            continue
        further = _verified(texts, more, k, num, den)
        tested = materialize(tested.union(more), "pairs")
        if not further.isEmpty():
            # The classes so far stand for the links so far.
            edges = classes.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(further)
            classes = materialize(connected_components(edges), "classes")
    out = rows.join(classes, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    discard(found, first, links, tested)
    return out


def _ids_repeat(docs: DataFrame) -> bool:
    """Whether an id is null or that of several rows."""
    return not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()


def _numbered_classes(numbered: DataFrame, k: int, num: int, den: int, rare_below: int, small: int) -> DataFrame:
    """row, doc_id, n_shingles, class (a row number) of rows numbered by `row`."""
    found = _classes(numbered.select(F.col("row").alias("doc_id"), "text"), k, num, den, rare_below, small)
    found = found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("class"))
    return numbered.select("row", "doc_id").join(found, "row")


def similar_classes(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rare_below: int = RARE_BELOW, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: classes of texts linked at Jaccard >= num / den.

    Where ids repeat or are null, each row is a document of its own: its component_id is the smallest id of its
    class that is not null.
    """
    texts = _texts(docs)
    if not _ids_repeat(texts):
        return _classes(texts, k, num, den, rare_below, small)
    numbered = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = materialize(_numbered_classes(numbered, k, num, den, rare_below, small), "rows")
    least = found.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "class").select("doc_id", "n_shingles", "component_id")


def keep_one_of_each_class(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without those whose class has a smaller doc_id; of equal ids one row stays, and rows with a null doc_id all do."""
    texts = _texts(docs)
    gone = f"gone_{uuid.uuid4().hex}"  # no column of the input has this name
    if not _ids_repeat(texts):
        classes = _classes(texts, k, num, den, RARE_BELOW, SMALL)
        drop = materialize(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(gone)), "near")
        return docs.join(drop, docs["doc_id"].cast("long") == drop[gone], "left_anti")
    numbered = materialize(docs.withColumn(gone, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(gone).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = materialize(_numbered_classes(rows, k, num, den, RARE_BELOW, SMALL), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = found.groupBy("class").agg(F.min(order)["row"].alias("best"))
    drop = found.join(best, "class").where("row <> best and doc_id is not null").select(F.col("row").alias(gone))
    return numbered.join(drop, gone, "left_anti").select(*columns_of(docs))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(documents(spark, sf_dir), k=4, num=85, den=100)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS g
  FROM w
), sets AS MATERIALIZED (
  SELECT doc_id, len(g) AS n, g, md5(array_to_string(list_sort(g), chr(10))) AS k FROM s
), classes AS MATERIALIZED (
  SELECT k, min(doc_id) AS rep, any_value(n) AS n, any_value(g) AS g FROM sets WHERE n > 0 GROUP BY k
), tokens AS MATERIALIZED (
  SELECT rep, n, unnest(g) AS t FROM classes
), pairs AS (
  SELECT x.rep AS a, y.rep AS b, x.n AS na, y.n AS nb, count(*) AS common
  FROM tokens x JOIN tokens y ON x.t = y.t AND x.rep < y.rep AND 85 * greatest(x.n, y.n) <= 100 * least(x.n, y.n)
  GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS rep, a AS r FROM both_ways UNION SELECT reach.rep, e.b FROM reach JOIN both_ways e ON reach.r = e.a
), comp AS (
  SELECT rep, min(r) AS c FROM reach GROUP BY rep
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, coalesce(comp.c, c.rep, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.k = c.k AND s.n > 0 LEFT JOIN comp ON comp.rep = c.rep
"""
QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
ORACLES = {"op4_ngram_jaccard_join": SQL}
