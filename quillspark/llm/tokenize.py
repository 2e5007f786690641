"""Token ids of whole texts by a public tokenizer, with its work cached by word.

The tokenizer (lower case, white space dropped, `letters | one digit | other` pieces) never looks across ASCII
white space, so a text's ids are those of its words end to end. Words of ASCII and Latin-1 letters, digits and
signs are cut into pieces by byte classes, all words of a batch at once; a piece's ids come from the tokenizer's
own model. Any other word (other scripts, apostrophes, control characters, special tokens) goes to the whole
tokenizer. Each distinct piece is asked for once and kept in a bounded cache, by its bytes: hashes only group the
pieces of a batch, and every piece is compared byte by byte with the one that stands for its group.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa

from .common import splitmix, span_hashes, word_spans

#: Distinct pieces kept by a Python worker; beyond, the cache starts anew.
CACHE_PIECES = 400_000

_OTHER, _LETTER, _DIGIT, _SIGN = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[[ord("'"), ord("<")]] = _OTHER  # contractions and special tokens
_CLASS[0xC3] = _LETTER
_CLASS[0x80:0xC0] = _LETTER
_CODES = splitmix(256, 23)
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_LOW[0x80:0x9F] += 32  # second bytes of the Latin-1 letters


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """ids(data, offsets): token ids of many UTF-8 texts that lie end to end."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = _byte_letters()
        self.wide = self.whole.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[tuple[bytes, bool], bytes] = {}

    def piece(self, raw: bytes, simple: bool) -> bytes:
        if simple:
            low = raw.decode().lower()
            text = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(text)]
        else:
            ids = self.whole.encode(raw.decode(), add_special_tokens=False).ids
        return array("I" if self.wide else "H", ids).tobytes()

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the n+1 offsets of the rows in them."""
        starts, ends, _ = word_spans(data, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        kind = _CLASS[data]
        # 0xC3 with 0x97 or 0xB7 are signs; a continuation byte without 0xC3 before belongs to another script.
        tail = (data & 0xC0) == 0x80
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == 0xC3
        odd = (tail & ~after) | (tail & ((data == 0x97) | (data == 0xB7)))
        odd |= (kind == _OTHER) & (data > 32)
        odd |= (data < 32) & ~((data >= 9) & (data <= 13))
        begins = np.zeros(len(data), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        low = _LOW[data]
        begins[ends[ends < len(data)]] = False
        begins[starts] = True
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        begins &= np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        bad = np.flatnonzero(odd)
        hard = None
        if len(bad):
            words = np.unique(np.searchsorted(starts, bad, side="right") - 1)
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts[words]] += 1
            edge[ends[words]] -= 1
            hard = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            first = np.zeros(len(data), bool)
            first[starts[words]] = True
            begins &= ~hard | first
            low[hard] = data[hard]
        p_start = np.flatnonzero(begins)
        # A piece ends where the next one begins, or where its word ends.
        word_end = ends[np.searchsorted(starts, p_start, side="right") - 1]
        p_end = np.minimum(np.append(p_start[1:], len(data)), word_end)
        which, first = _groups(low, p_start, p_end)
        keys = [(low[a:b].tobytes(), hard is None or not hard[a]) for a, b in zip(p_start[first].tolist(), p_end[first].tolist(), strict=True)]
        if len(self.cache) + len(keys) > CACHE_PIECES:
            self.cache.clear()
        known = list(map(self.cache.get, keys))
        for i in [i for i, x in enumerate(known) if x is None]:
            known[i] = self.cache[keys[i]] = self.piece(*keys[i])
        width = self.dtype.itemsize
        pool = np.frombuffer(b"".join(known), self.dtype)
        size = np.fromiter(map(len, known), np.int64, len(known)) // width
        at = np.cumsum(size) - size
        lens = size[which]
        stops = np.cumsum(lens)
        total = int(stops[-1])
        out = pool[np.repeat(at[which] - (stops - lens), lens) + np.arange(total)]
        sums = np.append(0, stops)
        return out, sums[np.searchsorted(p_start, offsets)]


def _groups(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each span's group of equal bytes, and the first span of each group."""
    coded = pa.array(span_hashes(_CODES[data], starts, ends)).dictionary_encode()
    which = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    size, like = ends - starts, first[which]
    same = (size == size[like]).all()
    if same:
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        same = (data[at] == data[at + np.repeat(starts[like] - starts, size)]).all()
    if not same:  # a hash stands for two texts: group by the bytes themselves
        coded = pa.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]).dictionary_encode()
        which = coded.indices.to_numpy()
        first = np.empty(len(coded.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return which, first


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; it and its cache serve all tasks of the worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]
