"""FLAC media columns: lossless 8-bit PCM, encoded and decoded many frames at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import text_bytes

#: Samples of a frame; the rate written into streams; bytes of payload that one numpy step takes.
BLOCK, RATE, STEP_BYTES = 4096, 8000, 1 << 19
#: A text's payload is filled up with zero bytes to a positive multiple of this.
PAD = 64
#: Order of the linear predictors that the encoder tries, and bits of their quantised coefficients.
TAPS, PRECISION = 4, 10


def _crc_table(width: int, poly: int) -> np.ndarray:
    """Checksum of each single byte."""
    out = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ poly, out << 1) & ((1 << width) - 1)
    return out


_CRC16 = _crc_table(16, 0x8005)
_CRC8 = _crc_table(8, 0x07)
_SHIFTED = [_CRC16.astype(np.uint16)]


def crc16(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[begin[i]:end[i]] for all i at once: a byte's share depends only on how many bytes follow it."""
    size = end - begin
    longest = int(size.max(initial=0))
    while len(_SHIFTED) < longest:
        last = _SHIFTED[-1].astype(np.int64)
        _SHIFTED.append((last << 8 & 0xFFFF ^ _CRC16[last >> 8]).astype(np.uint16))
    table = np.concatenate(_SHIFTED[: max(longest, 1)])
    total = np.cumsum(size)
    inner = np.arange(total[-1] if len(total) else 0) + np.repeat(size - total, size)
    share = table[(np.repeat(size, size) - 1 - inner) * 256 + data[np.repeat(begin, size) + inner]]
    return np.bitwise_xor.reduceat(share, total - size) if len(share) else np.zeros(len(size), np.uint16)


def crc8(data: bytes) -> int:
    out = 0
    for b in data:
        out = int(_CRC8[out ^ b])
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in FLAC's extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    parts = []
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        parts.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([0xFF << (8 - size) & 0xFF | n, *reversed(parts)])


# -- encoding ----------------------------------------------------------------------------------------------------------


def _residuals(x: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Residuals of the fixed predictors of order 0 to 4; the first samples of a frame keep their lower orders' values."""
    out = [x]
    for order in range(1, 5):
        d = out[-1].copy()
        d[1:] -= out[-1][:-1]
        out.append(np.where(place >= order, d, x))
    return out


def _linear(x: np.ndarray, place: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, shift, residuals) of a linear predictor of TAPS taps for every frame, by its autocorrelation.

    Levinson's recursion runs over all frames at once; coefficients are rounded to PRECISION bits and the residuals are
    those of the rounded ones. The first TAPS samples of a frame keep their values.
    """
    y = x.astype(float)
    lags = []
    for lag in range(TAPS + 1):
        product = y * y if not lag else np.concatenate([np.zeros(min(lag, len(y))), y[lag:] * y[:-lag]]) * (place >= lag)
        lags.append(np.add.reduceat(product, begin))
    error, a = lags[0] * (1 + 1e-9) + 1e-9, np.zeros((TAPS, len(begin)))
    for i in range(TAPS):
        k = (lags[i + 1] - sum((a[j] * lags[i - j] for j in range(i)), np.zeros(len(begin)))) / error
        old = a[:i].copy()
        a[i] = k
        for j in range(i):
            a[j] = old[j] - k * old[i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(np.maximum(np.abs(a).max(0), 1e-3))).astype(np.int64), 0, 15)
    top = (1 << (PRECISION - 1)) - 1
    taps = np.clip(np.rint(a * 2.0**shift), -top - 1, top).astype(np.int32)
    guess = np.zeros(len(x), np.int32)
    for j in range(TAPS):
        guess[j + 1 :] += np.repeat(taps[j], length)[j + 1 :] * x[: -j - 1]
    return taps, shift, np.where(place >= TAPS, x - (guess >> np.repeat(shift.astype(np.int32), length)), x)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write the lower ``width`` bits of each value, highest first, at bit ``at``."""
    width = np.broadcast_to(width, at.shape)
    for i in range(int(width.max(initial=0))):
        live = width > i
        if live.all():
            bits[at + i] = value >> (width - 1 - i) & 1
        else:
            bits[at[live] + i] = value[live] >> (width[live] - 1 - i) & 1


def encode_streams(payloads: list[bytes], block: int = BLOCK, rate: int = RATE) -> list[bytes]:
    """A FLAC stream for each payload, its bytes as unsigned samples moved to -128..127 (8 bits, one channel).

    Frames hold ``block`` samples (the last one the rest) and use the cheapest of a constant, the fixed predictors of
    order 0 to 4, a linear predictor of TAPS taps, each with one Rice parameter, and verbatim samples. STREAMINFO has the samples' MD5, and a SEEKTABLE has
    the sample number and byte offset of every frame.
    """
    if not payloads:
        return []
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    size = np.array([len(p) for p in payloads], np.int64)
    frames = np.maximum(1, -(-size // block))
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    length = np.minimum(block, size[owner] - number * block)
    begin = np.concatenate([[0], np.cumsum(length)])[:-1]
    place = (np.arange(len(raw)) - np.repeat(begin, length)).astype(np.int32)
    x = raw.astype(np.int32) - 128

    taps, tap_shift, linear = _linear(x, place, begin, length)
    residuals = [*_residuals(x, place), linear]
    cost = np.stack([np.add.reduceat(np.abs(r), begin, dtype=np.int64) for r in residuals]).astype(float)
    # bits, about: what Rice codes of the mean cost, and the predictor's own
    cost = length * np.log2(1 + cost / length) + 8.0 * np.array([0, 1, 2, 3, 4, TAPS])[:, None]
    cost[5] += 9 + TAPS * PRECISION
    cost[length[None, :] <= np.array([0, 1, 2, 3, 4, TAPS])[:, None]] = np.inf
    which = cost.argmin(0)
    lpc = which == 5
    order = np.where(lpc, TAPS, which)
    folded = np.choose(np.repeat(which.astype(np.int8), length), residuals)
    folded = (folded << 1) ^ (folded >> 31)
    coded = place >= np.repeat(order.astype(np.int32), length)
    folded[~coded] = 0
    mean = np.add.reduceat(folded, begin, dtype=np.int64) / length
    near = np.clip(np.log2(np.maximum(mean, 1)).astype(np.int64), 0, 7)
    rice = [np.add.reduceat(folded >> np.repeat(c.astype(np.int8), length), begin, dtype=np.int64) + (length - order) * (1 + c) for c in (near, near + 1, np.maximum(near - 1, 0))]
    k = np.choose(np.argmin(rice, axis=0), (near, near + 1, np.maximum(near - 1, 0)))
    rice_bits = np.min(rice, axis=0) + 8 * order + 10 + lpc * (9 + TAPS * PRECISION)
    kind = np.where(rice_bits < 8 * length, 2, 1)
    first = x[begin]
    kind = np.where(np.maximum.reduceat(np.where(x == np.repeat(first, length), 0, 1), begin) == 0, 0, kind)

    heads = []
    for n, samples in zip(number.tolist(), length.tolist()):
        head = bytes([0xFF, 0xF8, 0x70 if samples != 4096 else 0xC0, 0x02]) + _utf8_number(n) + (b"" if samples == 4096 else (samples - 1).to_bytes(2, "big"))
        heads.append(head + bytes([crc8(head)]))
    head_size = np.array([len(h) for h in heads], np.int64)
    body_bits = 8 + np.where(kind == 0, 8, np.where(kind == 1, 8 * length, rice_bits))
    body = -(-body_bits // 8)
    frame_size = head_size + body + 2
    frame_at = np.concatenate([[0], np.cumsum(frame_size)])
    bits = np.zeros(int(frame_at[-1]) * 8, np.uint8)
    start = (frame_at[:-1] + head_size) * 8
    _put(bits, start, np.where(kind == 0, 0, np.where(kind == 1, 2, np.where(lpc, 2 * (31 + TAPS), 2 * (8 + order)))), 8)
    _put(bits, start[kind == 0] + 8, first[kind == 0] & 255, 8)
    of = np.repeat(np.arange(len(kind)), length)
    plain = (kind[of] == 1) | ((kind[of] == 2) & ~coded)
    _put(bits, start[of[plain]] + 8 + 8 * place[plain], x[plain] & 255, 8)
    riced = kind == 2
    at = start + 8 + 8 * order
    own = riced & lpc
    _put(bits, at[own], np.full(int(own.sum()), PRECISION - 1), 4)
    _put(bits, at[own] + 4, tap_shift[own], 5)
    for j in range(TAPS):
        _put(bits, at[own] + 9 + j * PRECISION, taps[j][own] & ((1 << PRECISION) - 1), PRECISION)
    at = at + lpc * (9 + TAPS * PRECISION)
    _put(bits, at[riced], k[riced], 10)  # method 0, partition order 0, four bits of parameter
    for kk in np.unique(k[riced]).tolist():
        chosen = riced & (k == kk)
        take = np.flatnonzero(np.repeat(chosen, length) & coded)
        value, owner_of = folded[take], of[take]
        width = (value >> kk) + (1 + kk)
        total = np.cumsum(width, dtype=np.int64)
        new = np.flatnonzero(np.concatenate([[True], owner_of[1:] != owner_of[:-1]]))
        shift = at[owner_of[new]] + 10 - (total[new] - width[new])
        one = total - (1 + kk) + np.repeat(shift, np.diff(np.append(new, len(width))))
        bits[one] = 1
        for i in range(kk):
            bits[one + (1 + i)] = value >> (kk - 1 - i) & 1
    data = np.packbits(bits)
    for at_, h in zip(frame_at[:-1].tolist(), heads):
        data[at_ : at_ + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16(data, frame_at[:-1], frame_at[1:] - 2)
    data[frame_at[1:] - 2], data[frame_at[1:] - 1] = sums >> 8, sums & 255

    out, flat, last = [], data.tobytes(), np.cumsum(frames)
    for i, payload in enumerate(payloads):
        a, b = int(last[i] - frames[i]), int(last[i])
        sizes = frame_size[a:b]
        info = block.to_bytes(2, "big") * 2 + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += (rate << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big")
        info += hashlib.md5((raw[begin[a] : begin[a] + size[i]] ^ 128).tobytes()).digest()
        offsets = frame_at[a:b] - frame_at[a]
        seek = np.zeros(b - a, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
        seek["sample"], seek["offset"], seek["n"] = number[a:b] * block, offsets, length[a:b]
        table = seek.tobytes()
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + flat[frame_at[a] : frame_at[b]])
    return out


# -- decoding ----------------------------------------------------------------------------------------------------------


def _numbers(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Unsigned numbers of ``width`` bits at each bit position."""
    out = np.zeros(len(at), np.int64)
    for i in range(width):
        out = out << 1 | bits[at + i]
    return out


def _signed(value: np.ndarray, width: int) -> np.ndarray:
    return value - (value >> (width - 1) << width)


class Frame:
    """Where one frame's parts are: header fields and the first bit of its subframe."""

    __slots__ = ("stream", "number", "samples", "byte", "bit", "end")


def _parse_header(raw: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, samples, bytes of the header) of the frame at ``at``; its CRC-8 is verified."""
    if raw[at : at + 2] not in (b"\xff\xf8",):
        raise ValueError("no frame of fixed block size where one should be")
    if raw[at + 3] != 0x02:
        raise ValueError("only one channel of 8 bits is decoded")
    lead = raw[at + 4]
    more = 0 if lead < 0x80 else (lead ^ 0xFF).bit_length() ^ 7
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead & (0x7F >> (more + 1 if more else 0))
    for b in raw[at + 5 : at + 5 + more]:
        number = number << 6 | b & 0x3F
    end = at + 5 + more
    code = raw[at + 2] >> 4
    if code == 7:
        samples, end = int.from_bytes(raw[end : end + 2], "big") + 1, end + 2
    elif code == 6:
        samples, end = raw[end] + 1, end + 1
    elif 8 <= code:
        samples = 256 << (code - 8)
    else:
        samples = 192 if code == 1 else 576 << (code - 2)
    rate = raw[at + 2] & 15
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if crc8(raw[at:end]) != raw[end]:
        raise ValueError("a frame header's CRC-8 is wrong")
    return number, samples, end + 1 - at


def parse_stream(raw: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """(samples, md5, seek points (sample, byte offset from the first frame, samples), first frame's byte) of a stream."""
    if raw[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, size = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            table = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            points = [(int(a), int(b), int(c)) for a, b, c in table.tolist() if a != (1 << 64) - 1]
        at += 4 + size
    if sum(p[2] for p in points) != total and at < len(raw):
        points = scan_frames(raw, at)
    return total, md5, points, at


def _unpredict(residual: np.ndarray, warm: np.ndarray, order: int) -> np.ndarray:
    """Samples from the fixed predictor's residuals (after the warm-up samples): repeated sums."""
    x = residual
    for o in range(order, 0, -1):
        head = warm.copy()
        for _ in range(o - 1):
            head = np.diff(head)
        x = np.cumsum(np.concatenate([head[:1], x])) if o == order else np.cumsum(np.concatenate([head[:1], x]))
        # the sums start from the (o - 1)-th difference of the first o warm-up samples
        warm = warm[:o] if o < order else warm
    return x


def _unpredict_linear(frames: list[tuple], residual: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Samples of frames (number, warm-up samples, (taps, shift)) from their residuals; frames of one order go sample by sample together."""
    out = {}
    for order in {len(warm) for _, warm, _ in frames}:
        some = sorted((f for f in frames if len(f[1]) == order), key=lambda f: -len(residual[f[0]]))
        count = np.array([len(residual[f[0]]) for f in some], np.int64)
        x = np.zeros((order + int(count[0]), len(some)), np.int64)
        for j, (i, warm, _) in enumerate(some):
            x[:order, j] = warm
            x[order : order + count[j], j] = residual[i]
        taps = np.array([f[2][0] for f in some], np.int64).T
        shift = np.array([f[2][1] for f in some], np.int64)
        left, right = np.maximum(-shift, 0), np.maximum(shift, 0)
        live = np.searchsorted(-count, -np.arange(int(count[0])), "left").tolist()
        for t, m in enumerate(live):
            guess = taps[0, :m] * x[order + t - 1, :m]
            for j in range(1, order):
                guess += taps[j, :m] * x[order + t - 1 - j, :m]
            x[order + t, :m] += (guess << left[:m]) >> right[:m]
        for j, (i, *_) in enumerate(some):
            out[i] = x[: order + count[j], j].copy()
    return out


def scan_frames(raw: bytes, first: int) -> list[tuple[int, int, int]]:
    """Seek points of a stream without a whole seek table: frames that follow one another with right numbers and checksums."""
    data, points, sample, begin = np.frombuffer(raw, np.uint8), [], 0, first
    starts = first + np.flatnonzero((data[first:-1] == 0xFF) & (data[first + 1 :] == 0xF8))
    for at in [*starts.tolist(), len(raw)]:
        if at == begin and at < len(raw):
            _, n, _ = _parse_header(raw, at)
            continue
        if at <= begin:
            continue
        if at < len(raw):
            try:
                number, following, _ = _parse_header(raw, at)
            except (ValueError, IndexError):
                continue
            if number != len(points) + 1:
                continue
        total = int(crc16(data, np.array([begin]), np.array([at - 2]))[0])
        if total != int.from_bytes(raw[at - 2 : at], "big"):
            continue
        points.append((sample, begin - first, n))
        sample, begin = sample + n, at
        if at < len(raw):
            n = following
    if begin != len(raw):
        raise ValueError("frames do not follow one another to the stream's end")
    return points


def decode_frames(raw: bytes, frames: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Samples of each frame (first byte, byte after the frame, samples); CRC-16 and CRC-8 of all are verified.

    Constant, verbatim, fixed and linear-predictor subframes are decoded, with wasted bits and Rice partitions of
    either method. All Rice codes are read together: for every bit the next set bit is known, so a step reads one code
    of every partition that has one left.
    """
    if not frames:
        return []
    data = np.frombuffer(raw, np.uint8)
    begin, end, samples = (np.array(c, np.int64) for c in zip(*frames))
    sums = crc16(data, begin, end - 2)
    if (sums != (data[end - 2].astype(np.uint16) << 8 | data[end - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    low = int(begin.min())
    bits = np.unpackbits(data[low : int(end.max())])
    ones = np.flatnonzero(bits)
    plans, parts = [], []
    for i, (b, e, n) in enumerate(frames):
        _, count, head = _parse_header(raw, b)
        if count != n:
            raise ValueError("a frame holds another number of samples than the seek table says")
        at = (b + head - low) * 8
        kind, wasted = raw[b + head] >> 1 & 63, raw[b + head] & 1
        if raw[b + head] >> 7 or 2 <= kind < 8 or 12 < kind < 32:
            raise ValueError("a subframe is of a reserved type")
        at += 8
        if wasted:
            wasted = int(ones[np.searchsorted(ones, at)]) - at + 1
            at += wasted
        width = 8 - wasted
        if kind == 0:
            plans.append((i, "constant", at, width, wasted, 0, None))
            continue
        if kind == 1:
            plans.append((i, "verbatim", at, width, wasted, 0, None))
            continue
        lpc = kind >= 32
        order = (kind & 31) + 1 if lpc else kind & 7
        warm_at, coefficients = at, None
        at += order * width
        if lpc:
            precision = int(_numbers(bits, np.array([at]), 4)[0]) + 1
            shift = int(_signed(_numbers(bits, np.array([at + 4]), 5), 5)[0])
            coefficients = _signed(_numbers(bits, at + 9 + np.arange(order) * precision, precision), precision), shift
            at += 9 + order * precision
        method, split = int(_numbers(bits, np.array([at]), 2)[0]), int(_numbers(bits, np.array([at + 2]), 4)[0])
        plans.append((i, "linear" if lpc else "fixed", warm_at, width, wasted, order, coefficients))
        parts.append([i, at + 6, 4 if method == 0 else 5, split, order])
    residual = _rice(bits, ones, parts, samples)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(frames)
    predicted = [(i, _signed(_numbers(bits, at + np.arange(order) * width, width), width), coefficients) for i, what, at, width, _, order, coefficients in plans if what == "linear"]
    linear = _unpredict_linear(predicted, residual)
    for i, what, at, width, wasted, order, coefficients in plans:
        n = int(samples[i])
        if what == "constant":
            x = np.repeat(_signed(_numbers(bits, np.array([at]), width), width), n)
        elif what == "verbatim":
            x = _signed(_numbers(bits, at + np.arange(n) * width, width), width)
        elif what == "linear":
            x = linear[i]
        else:
            x = _unpredict(residual[i], _signed(_numbers(bits, at + np.arange(order) * width, width), width), order)
        out[i] = x << wasted
    return out


def _rice(bits: np.ndarray, ones: np.ndarray, parts: list[list[int]], samples: np.ndarray) -> dict[int, np.ndarray]:
    """Residuals of each frame of ``parts`` [frame, first bit, bits of a parameter, partition order, predictor order]."""
    after = np.full(len(bits) + 1, len(bits), np.int32)
    if len(ones):
        after[: ones[-1] + 1] = np.repeat(ones.astype(np.int32), np.diff(ones, prepend=-1))
    out: dict[int, list[np.ndarray]] = {p[0]: [] for p in parts}
    todo = [(p[0], p[1], p[2], p[3], p[4], 0) for p in parts]
    while todo:
        jobs, following = [], []
        for frame, at, width, split, order, part in todo:
            n = (int(samples[frame]) >> split) - (order if part == 0 else 0)
            k = int(_numbers(bits, np.array([at]), width)[0])
            if k == (1 << width) - 1:
                size = int(_numbers(bits, np.array([at + width]), 5)[0])
                at += width + 5
                out[frame].append(_signed(_numbers(bits, at + np.arange(n) * size, size), size) if size else np.zeros(n, np.int64))
                if part + 1 < 1 << split:
                    following.append((frame, at + n * size, width, split, order, part + 1))
            else:
                jobs.append((n, at + width, k, frame, width, split, order, part))
        jobs.sort(key=lambda j: -j[0])
        if jobs:
            count = np.array([j[0] for j in jobs], np.int64)
            at = np.array([j[1] for j in jobs], np.int32)
            k = np.array([j[2] for j in jobs], np.int32)
            stop = np.zeros((int(count[0]), len(jobs)), np.int32)
            live = np.searchsorted(-count, -np.arange(int(count[0])), "left")
            pos, step = at.copy(), k + np.int32(1)
            for t, m in enumerate(live.tolist()):
                one = after[pos[:m]]
                stop[t, :m] = one
                np.add(one, step[:m], out=pos[:m])
            stop = np.ascontiguousarray(stop.T)
            for j, (n, _, kk, frame, width, split, order, part) in enumerate(jobs):
                one = stop[j, :n]
                value = np.diff(one, prepend=at[j] - (kk + 1)) - (kk + 1) << kk
                for i in range(kk):
                    value |= bits[one + (i + 1)].astype(np.int32) << (kk - 1 - i)
                out[frame].append((value >> 1) ^ -(value & 1))
                if part + 1 < 1 << split:
                    following.append((frame, int(pos[j]), width, split, order, part + 1))
        todo = following
    return {f: np.concatenate(x) if x else np.zeros(0, np.int64) for f, x in out.items()}


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Payload bytes of each stream; checksums, lengths and MD5 are verified. Streams without a seek point for every frame are scanned."""
    raw, frames, shape = b"".join(streams), [], []
    base = 0
    for s in streams:
        total, md5, points, first = parse_stream(s)
        ends = [p[1] for p in points[1:]] + [len(s) - first]
        frames += [(base + first + p[1], base + first + e, p[2]) for p, e in zip(points, ends)]
        shape.append((len(points), total, md5))
        base += len(s)
    blocks = decode_frames(raw, frames)
    out, at = [], 0
    for n, total, md5 in shape:
        x = np.concatenate(blocks[at : at + n]) if n else np.zeros(0, np.int64)
        at += n
        signed = x.astype(np.int8)
        if len(x) != total or hashlib.md5(signed.tobytes()).digest() != md5:
            raise ValueError("a stream's samples are not those that were stored")
        out.append((signed.view(np.uint8) ^ 128).tobytes())
    return out


# -- columns -----------------------------------------------------------------------------------------------------------


def payload(text: bytes) -> bytes:
    """The text's bytes, filled up with zeros to a positive multiple of PAD."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def _grouped(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > STEP_BYTES:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's payload as a FLAC stream. Null texts are empty ones. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            sizes = np.diff(offsets)
            for a, b in _grouped(sizes.tolist()):
                raw = data[offsets[a] : offsets[b]].tobytes()
                cut = (offsets[a : b + 1] - offsets[a]).tolist()
                media = encode_streams([payload(raw[i:j]) for i, j in zip(cut[:-1], cut[1:])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """``stored(doc_id, n_bytes, media)`` with the decoded ``payload`` and ``feature``: samples, sum, level and sign changes of the PCM.

    Ids are carried as they are, null or repeated; a null ``media`` fails, as a damaged one does. An empty table gives an empty result.
    """

    def feature(x: bytes) -> str:
        s = np.frombuffer(x, np.uint8).astype(np.int64) - 128
        turns = int((np.diff(np.signbit(s)) != 0).sum())
        return f"n={len(s)};sum={int(s.sum())};energy={int((s * s).sum())};peak={int(np.abs(s).max())};turns={turns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(2).to_pylist()
            for a, b in _grouped([len(m) for m in media]):
                found = decode_streams(media[a:b])
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns] + [pa.array(found, pa.binary()), pa.array([feature(x) for x in found])], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")


def read_samples(media: bytes, first: int, count: int) -> np.ndarray:
    """Samples first .. first + count of a stream, decoding only the frames that hold them."""
    total, _, points, base = parse_stream(media)
    stop = min(first + count, total)
    ends = [p[1] for p in points[1:]] + [len(media) - base]
    need = [(p, e) for p, e in zip(points, ends) if p[0] < stop and p[0] + p[2] > first]
    if not need or first >= stop:
        return np.zeros(0, np.int64)
    blocks = decode_frames(media, [(base + p[1], base + e, p[2]) for p, e in need])
    return np.concatenate(blocks)[first - need[0][0][0] : stop - need[0][0][0]]


def pcm_blocks(stored: DataFrame) -> DataFrame:
    """(doc_id, sample, pcm): the PCM of ``stored(doc_id, media)``, a block a frame, each with the number of its first sample to seek by.

    Checksums are verified. Null ids stay null, equal ids keep their streams' blocks apart only by order; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(batch.column(1).to_pylist()):
                total, _, points, base = parse_stream(media)
                ends = [p[1] for p in points[1:]] + [len(media) - base]
                for a in range(0, len(points), STEP_BYTES // BLOCK):
                    part = points[a : a + STEP_BYTES // BLOCK]
                    blocks = decode_frames(media, [(base + p[1], base + e, p[2]) for p, e in zip(part, ends[a:])])
                    pcm = [(x.astype(np.int8).view(np.uint8) ^ 128).tobytes() for x in blocks]
                    own = pa.array(np.full(len(part), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(own), pa.array([p[0] for p in part], pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "sample", "pcm"])

    return stored.select("doc_id", "media").mapInArrow(run, "doc_id long, sample long, pcm binary")
