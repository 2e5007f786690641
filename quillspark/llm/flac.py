"""FLAC streams of mono 8-bit samples: a vectorised encoder and decoder, and a plain decoder for any other frame.

The encoder writes frames of BLOCK samples with constant, verbatim or fixed-predictor subframes and Rice-coded
residuals, a STREAMINFO with the samples' MD5 and a SEEKTABLE. The decoder finds the frames by their headers
(sync code, CRC-8, running number), decodes the Rice residuals of all frames of a batch side by side, undoes fixed
and general linear predictors, and verifies each frame's CRC-16, the seek points and the MD5. Frames outside the
vectorised form (Rice partitions, escapes, other block sizes) go through decode_frame, one at a time.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np

#: Samples of a frame, the fixed block size with code 1.
BLOCK = 192
RATE = 8000
#: Frames between two seek points, and frames handled in one vectorised step.
SEEK_EVERY, STEP = 32, 16384
_HEAD = b"\xff\xf8\x14\x02"  # sync, fixed block size; 192 samples at 8 kHz; mono, 8 bits
_MOST_ZEROS = 20  # longest unary part the encoder writes


def _table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ int(CRC16[(c >> 8) ^ b])
    return c


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1)) if n < 1 << 31 else 7
    out = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size) & 0xFF | n >> 6 * (size - 1), *out])


def _header(n: int) -> bytes:
    h = _HEAD + coded_number(n)
    return h + bytes([crc8(h)])


# --- encoding ---------------------------------------------------------------------------------------------


def _folded(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """One frame for each row of BLOCK samples (-128..127)."""
    count = len(samples)
    out: list[bytes] = [b""] * count
    x = samples.astype(np.int32)
    levels = [x]
    for _ in range(4):
        levels.append(np.diff(levels[-1], axis=1))
    cost = np.stack([np.abs(d).sum(1, dtype=np.int64) * BLOCK // d.shape[1] for d in levels], 1)
    order = cost.argmin(1)
    constant = (x == x[:, :1]).all(1)
    kind = np.where(constant, -1, order)
    shift = np.zeros(count, np.int32)
    for o in range(5):
        rows = np.flatnonzero(kind == o)
        if not len(rows):
            continue
        f = _folded(levels[o][rows])
        bits = np.stack([(f >> k).sum(1) + f.shape[1] * (1 + k) for k in range(12)], 1)
        best = bits.argmin(1)
        most = f.max(1)
        while ((most >> best) > _MOST_ZEROS).any():
            best = best + ((most >> best) > _MOST_ZEROS)
        size = 8 * o + 10 + np.take_along_axis(bits, np.minimum(best, 11)[:, None], 1)[:, 0]
        shift[rows] = best
        kind[rows[(size >= 8 * BLOCK) | (best > 11)]] = -2
    heads: dict[int, bytes] = {}
    for k in range(-2, 5):
        rows = np.flatnonzero(kind == k)
        if len(rows):
            for i, body in zip(rows.tolist(), _bodies(x[rows], levels[k][rows] if k >= 0 else None, k, shift[rows]), strict=True):
                n = int(numbers[i])
                if n not in heads:
                    heads[n] = _header(n)
                out[i] = heads[n] + body
    width = max(map(len, out))
    flat = np.frombuffer(b"".join(f.ljust(width, b"\0") for f in out), np.uint8).reshape(count, width)
    codes = _crc16_rows(flat, np.fromiter(map(len, out), np.int64, count))
    return [f + struct.pack(">H", c) for f, c in zip(out, codes.tolist(), strict=True)]


def _bodies(x: np.ndarray, residual: np.ndarray | None, kind: int, shift: np.ndarray) -> list[bytes]:
    n = len(x)
    if kind < 0:
        flat = (x[:, :1] if kind == -1 else x).astype(np.int8).tobytes()
        w = 1 if kind == -1 else BLOCK
        return [(b"\0" if kind == -1 else b"\x02") + flat[i * w : (i + 1) * w] for i in range(n)]
    folded = _folded(residual)
    zeros = folded >> shift[:, None]
    value = (1 << shift[:, None]) | (folded & ((1 << shift[:, None]) - 1))
    width = (shift + 1)[:, None]
    stop = np.cumsum(zeros + width, axis=1) + 10
    total = (stop[:, -1] + 7) // 8
    room = int(total.max()) + 4
    flat = np.zeros(n * room, np.uint32)
    base = np.arange(n) * room
    head = shift.astype(np.uint32) << np.uint32(6)  # 2 bits method 0, 4 bits partition order 0, 4 bits parameter
    flat[base], flat[base + 1] = head >> np.uint32(8), head & np.uint32(255)
    begin = stop - width
    place, up = base[:, None] + (begin >> 3), (24 - (begin & 7) - width).astype(np.uint32)
    word = value.astype(np.uint32) << up
    for i in range(folded.shape[1]):
        p, w = place[:, i], word[:, i]
        flat[p] |= w >> np.uint32(16)
        flat[p + 1] |= (w >> np.uint32(8)) & np.uint32(255)
        flat[p + 2] |= w & np.uint32(255)
    packed = flat.astype(np.uint8).tobytes()
    warm = x[:, :kind].astype(np.int8).tobytes()
    first = bytes([(8 | kind) << 1])
    return [first + warm[i * kind : (i + 1) * kind] + packed[i * room : i * room + t] for i, t in enumerate(total.tolist())]


def _crc16_rows(rows: np.ndarray, lens: np.ndarray) -> np.ndarray:
    c = np.zeros(len(rows), np.uint32)
    order = np.argsort(-lens, kind="stable")
    lens, rows, sorted_c = lens[order], np.ascontiguousarray(rows[order].T), c
    live = np.searchsorted(-lens, -np.arange(len(rows)), side="left")  # rows longer than a column's number
    for i, m in enumerate(live.tolist()):
        part = sorted_c[:m]
        sorted_c[:m] = ((part << np.uint32(8)) & np.uint32(0xFFFF)) ^ CRC16[(part >> np.uint32(8)) ^ rows[i, :m]]
    out = np.empty_like(sorted_c)
    out[order] = sorted_c
    return out


def assemble(payload: bytes, frames: list[bytes]) -> bytes:
    """The stream of a payload (bytes are samples plus 128) from its frames."""
    n = len(payload)
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    at = np.concatenate(([0], np.cumsum([len(f) for f in frames])))
    seek = b"".join(struct.pack(">QQH", i * BLOCK, int(at[i]), BLOCK) for i in range(0, len(frames), SEEK_EVERY))
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | n).to_bytes(8, "big") + hashlib.md5(signed).digest()
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """Streams of payloads whose lengths are positive multiples of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int16)) - 128
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.zeros(0, np.int64)
    frames: list[bytes] = []
    for a in range(0, len(samples), STEP):
        frames += encode_frames(samples[a : a + STEP], numbers[a : a + STEP])
    out, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        out.append(assemble(p, frames[at : at + c]))
        at += c
    return out


# --- decoding ---------------------------------------------------------------------------------------------


class Damaged(ValueError):
    """A stream that is not whole: bad marker, checksum, number or length."""


def metadata(stream: bytes) -> dict:
    """block sizes, rate, channels, bits, samples, md5, seek points and the place of the first frame."""
    if stream[:4] != b"fLaC":
        raise Damaged("no stream marker")
    at, out, last = 4, {"seek": []}, False
    while not last:
        if at + 4 > len(stream):
            raise Damaged("metadata is cut")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[0:2], "big"), "most": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = [struct.unpack_from(">QQH", body, i) for i in range(0, len(body) - 17, 18)]
        at += 4 + size
    if "block" not in out:
        raise Damaged("no STREAMINFO")
    return out | {"first": at}


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, self.at + n + 7 >> 3
        if b > len(self.data):
            raise Damaged("frame is cut")
        v = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n)
        self.at += n
        return v & (1 << n) - 1

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def zeros(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


def decode_frame(stream: bytes, at: int, info: dict) -> tuple[list[int], int, int]:
    """(samples, number, place after) of the mono frame at a place: any subframe, Rice partition and escape."""
    b = _Bits(stream, at)
    if b.take(15) != 0x7FFC:
        raise Damaged("no sync code")
    b.take(1)
    size, rate, channel, depth = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    more = next(i for i in range(8) if not lead >> (7 - i) & 1) if lead != 0xFF else 8
    number = lead if more == 0 else lead & (1 << max(0, 7 - more)) - 1
    for _ in range(max(0, more - 1)):
        number = number << 6 | b.take(8) & 0x3F
    n = 192 if size == 1 else 576 << size - 2 if size <= 5 else b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else 256 << size - 8
    if rate == 12:
        b.take(8)
    elif rate in (13, 14):
        b.take(16)
    head = stream[at : b.at >> 3]
    if crc8(head) != b.take(8):
        raise Damaged("frame header checksum")
    if channel:
        raise Damaged("more than one channel")
    bits = {0: info["bits"], 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    b.take(1)
    kind = b.take(6)
    wasted = b.zeros() + 1 if b.take(1) else 0
    bits -= wasted
    if kind == 0:
        s = [b.signed(bits)] * n
    elif kind == 1:
        s = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        s = [b.signed(bits) for _ in range(order)]
        if kind < 32:
            weights, down = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        else:
            precision = b.take(4) + 1
            down = b.signed(5)
            weights = [b.signed(precision) for _ in range(order)]
        wide = 5 if b.take(2) else 4
        parts = b.take(4)
        for p in range(1 << parts):
            m = (n >> parts) - (order if p == 0 else 0)
            k = b.take(wide)
            raw = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range(m):
                if raw is None:
                    f = b.zeros() << k
                    f |= b.take(k)
                    r = -(f + 1 >> 1) if f & 1 else f >> 1
                else:
                    r = b.signed(raw)
                s.append(r + (sum(w * s[-1 - j] for j, w in enumerate(weights)) >> down))
    else:
        raise Damaged("reserved subframe")
    end = b.at + 7 >> 3
    if crc16(stream[at:end]) != int.from_bytes(stream[end : end + 2], "big") or end + 2 > len(stream):
        raise Damaged("frame checksum")
    return [v << wasted for v in s], number, end + 2


def frame_places(stream: bytes, info: dict) -> list[int] | None:
    """Places of all frames, by headers of the encoder's form with the right running numbers; None if they don't add up."""
    places, at, n = [], info["first"], -(-info["samples"] // BLOCK)
    for i in range(n):
        h = _header(i) if i >= len(_headers) else _headers[i]
        found = at if stream.startswith(h, at) else stream.find(h, at)
        if found < 0 or (i == 0 and found != info["first"]):
            return None
        places.append(found)
        at = found + len(h)
    return places


_headers = [_header(i) for i in range(1024)]


def decode_many(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams, every frame checksum, seek point and MD5 verified."""
    infos = [metadata(s) for s in streams]
    out: list[bytes | None] = [None] * len(streams)
    jobs, owners = [], []
    base = 0
    for i, (s, info) in enumerate(zip(streams, infos, strict=True)):
        if info["channels"] != 1 or info["bits"] != 8:
            raise Damaged("only mono streams of 8 bits are payloads")
        places = frame_places(s, info) if info["block"] == info["most"] == BLOCK and info["samples"] % BLOCK == 0 else None
        if places is not None and all(int(p[1]) == places[p[0] // BLOCK] - info["first"] for p in info["seek"]):
            ends = [*places[1:], len(s)]
            jobs.append((base + np.array(places), base + np.array(ends), np.fromiter((len(_headers[j]) if j < 1024 else len(_header(j)) for j in range(len(places))), np.int64, len(places))))
            owners.append((i, len(places)))
        else:
            out[i] = _decode_plainly(s, info)
        base += len(s)
    if jobs:
        data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
        begin, end, head = (np.concatenate(x) for x in zip(*jobs, strict=True))
        samples = np.empty((len(begin), BLOCK), np.int16)
        odd: list[int] = []
        for a in range(0, len(begin), STEP):
            samples[a : a + STEP], hard = _decode_frames(data, begin[a : a + STEP], end[a : a + STEP], head[a : a + STEP])
            odd += (a + hard).tolist()
        for f in odd:
            values, _, _ = decode_frame(data[begin[f] : end[f]].tobytes(), 0, {"bits": 8})
            if len(values) != BLOCK:
                raise Damaged("frame of another size")
            samples[f] = values
        at = 0
        for i, n in owners:
            out[i] = (samples[at : at + n] + 128).astype(np.uint8).tobytes()
            at += n
    for payload, info in zip(out, infos, strict=True):
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        if len(payload) != info["samples"] or hashlib.md5(signed).digest() != info["md5"]:
            raise Damaged("samples do not match STREAMINFO")
    return out


def read_tails(streams: list[bytes], count: int) -> list[bytes]:
    """The last samples of sound streams, count at most, as payload bytes: only the last frame of each is decoded, found from its last seek point."""
    out: list[bytes | None] = [None] * len(streams)
    begin, end, head, owners, base = [], [], [], [], 0
    for i, s in enumerate(streams):
        info = metadata(s)
        n = -(-info["samples"] // BLOCK) - 1
        point = max((p for p in info["seek"] if p[0] <= n * BLOCK), default=(0, 0, BLOCK))
        at = info["first"] + point[1]
        for k in range(point[0] // BLOCK, n + 1):
            h = _headers[k] if k < len(_headers) else _header(k)
            at = s.find(h, at) if at >= 0 else at
            if k < n and at >= 0:
                at += len(h)
        if info["samples"] % BLOCK or info["block"] != BLOCK or at < 0 or count > BLOCK:
            out[i] = _decode_plainly(s, info)[-count:]
        else:
            begin.append(base + at)
            end.append(base + len(s))
            head.append(len(h))
            owners.append(i)
        base += len(s)
    if begin:
        data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
        try:
            samples, hard = _decode_frames(data, np.array(begin), np.array(end), np.array(head))
        except Damaged:  # sample bytes that look like a header led astray
            return [_decode_plainly(s, metadata(s))[-count:] for s in streams]
        for f in hard.tolist():
            samples[f] = decode_frame(data[begin[f] : end[f]].tobytes(), 0, {"bits": 8})[0]
        tails = (samples[:, -count:] + 128).astype(np.uint8)
        for row, i in enumerate(owners):
            out[i] = tails[row].tobytes()
    return out


def _decode_plainly(stream: bytes, info: dict) -> bytes:
    at, all_samples = info["first"], []
    while len(all_samples) < info["samples"]:
        values, _, at = decode_frame(stream, at, info)
        all_samples += values
    return (np.array(all_samples, np.int16) + 128).astype(np.uint8).tobytes()


def _decode_frames(data: np.ndarray, begin: np.ndarray, end: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of many frames, and which of them need decode_frame."""
    lens = end - begin
    width = int(lens.max())
    rows = data[np.minimum(begin[:, None] + np.arange(width), len(data) - 1)]
    if _crc16_rows(rows, lens).any():  # a frame with its checksum leaves nothing
        raise Damaged("frame checksum")
    out = np.zeros((len(begin), BLOCK), np.int32)
    kind = data[begin + head]
    at = begin + head + 1
    same = np.flatnonzero(kind == 0)
    out[same] = data[at[same]].view(np.int8)[:, None]
    plain = np.flatnonzero(kind == 2)
    if len(plain):
        out[plain] = data[at[plain][:, None] + np.arange(BLOCK)].view(np.int8)
    done = (kind == 0) | (kind == 2)
    # Unaligned big-endian words: seven bytes from any place.
    for code in np.unique(kind[~done]).tolist():
        sub = np.flatnonzero(kind == code)
        t = code >> 1
        if code & 1 or not (8 <= t <= 12 or t >= 32):
            continue
        order = t - 8 if t < 32 else t - 31
        place = 8 * (at[sub] + order)
        weights = down = None
        if t >= 32:
            precision = (_word(data, place) >> np.uint64(60)).astype(np.int64) + 1
            down = (_word(data, place + 4) >> np.uint64(59)).astype(np.int64)
            down = np.where(down > 15, down - 32, down)
            place = place + 9
            weights = np.zeros((len(sub), order), np.int64)
            for j in range(order):
                w = (_word(data, place) >> (64 - precision).astype(np.uint64)).astype(np.int64)
                weights[:, j] = np.where(w >> precision - 1 & 1, w - (1 << precision), w)
                place = place + precision
        h = (_word(data, place) >> np.uint64(54)).astype(np.int64)
        shift = h & 15
        ok = (h >> 4 == 0) & (shift < 15) & (down is None or (down >= 0))
        sub, place, shift = sub[ok], place[ok] + 10, shift[ok]
        if not len(sub):
            continue
        folded, fine = _rice(data, place, shift, BLOCK - order, 8 * end[sub])
        sub, folded = sub[fine], folded[fine]
        r = np.where(folded & 1, -((folded + 1) >> 1), folded >> 1)
        warm = data[at[sub][:, None] + np.arange(order)].view(np.int8).astype(np.int32) if order else np.zeros((len(sub), 0), np.int32)
        out[sub] = _fixed(warm, r, order) if t < 32 else _linear(warm, r, weights[ok][fine], down[ok][fine])
        done[sub] = True
    return out.astype(np.int16), np.flatnonzero(~done)


def _word(data: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 57 or more bits from each bit place, at the top of a 64-bit word."""
    view = np.lib.stride_tricks.as_strided(data[:8].view(">u8"), (len(data) - 7,), (1,))
    return view[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)


def _rice(data: np.ndarray, place: np.ndarray, shift: np.ndarray, n: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n folded residuals of each frame, and which frames were within reach of a word and of their own bytes."""
    view = np.lib.stride_tricks.as_strided(data[:8].view(">u8"), (len(data) - 7,), (1,))
    out = np.empty((n, len(place)), np.int32)
    fine = np.ones(len(place), bool)
    up, keep = (63 - shift).astype(np.uint64), shift.astype(np.uint64)
    last = 8 * (len(data) - 8)
    for i in range(n):
        w = view[place >> 3].astype(np.uint64) << (place & 7).astype(np.uint64)
        top = (w >> np.uint64(32)).astype(np.float64)
        zeros = 31 - ((top.view(np.int64) >> 52) - 1023)
        hard = zeros > 31
        if hard.any():
            fine &= ~hard
            zeros[hard] = 0
        z = zeros.astype(np.uint64)
        # After the zeros stands a one and then the low bits; the one is shifted out at the top.
        low = (w << z << np.uint64(1)) >> np.uint64(1) >> up
        out[i] = ((z << keep) | low).astype(np.int32)
        place = np.minimum(place + zeros + 1 + shift, last)
    fine &= place <= limit
    return out.T, fine


def _fixed(warm: np.ndarray, r: np.ndarray, order: int) -> np.ndarray:
    out = np.zeros((len(r), r.shape[1] + order), np.int32)
    out[:, order:] = r
    steps = [warm]
    for _ in range(order - 1):
        steps.append(np.diff(steps[-1], axis=1))
    for t in range(order, 0, -1):
        first = steps[t - 1][:, :1]
        out[:, t:] = first + np.cumsum(out[:, t:], axis=1)
        out[:, t - 1] = first[:, 0]
    return out


def _linear(warm: np.ndarray, r: np.ndarray, weights: np.ndarray, down: np.ndarray) -> np.ndarray:
    order = warm.shape[1]
    s = np.zeros((r.shape[1] + order, len(r)), np.int64)
    s[:order] = warm.T
    for i in range(order, len(s)):
        total = np.zeros(len(r), np.int64)
        for j in range(order):
            total += weights[:, j] * s[i - 1 - j]
        s[i] = r[:, i - order] + (total >> down)
    return s.T
