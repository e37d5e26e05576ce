"""Media columns: FLAC streams, written and read frame by frame in bulk.

A payload of bytes is stored as 8-bit mono samples (byte - 128), in frames of
576 samples, with a seek table that gives every frame's sample offset and place in
the stream.  Frames are independent, so thousands are decoded side by side:
step i reads residual i of all of them (a run of zeros, a one, the low bits),
then the linear predictors rebuild the samples in the same way.  Every frame's
header CRC-8 and frame CRC-16 and the stream's MD5 are verified.

The reader takes mono 8-bit streams with constant, verbatim, fixed (0-4) and
linear-prediction subframes (orders 1-32), both Rice methods with any partition
order, escaped partitions and wasted bits.  A stream without a seek table
is walked frame by frame.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 576
RATE = 8000
#: Frames coded side by side, and bytes of payload gathered before coding.
FRAMES = 4096
GATHERED = FRAMES * BLOCK
PARTITION_ORDER = 2
LPC_ORDER, LPC_PRECISION = 4, 7
#: Kinds of subframes beside the orders of the fixed predictors.
LINEAR, CONSTANT, VERBATIM = 5, -1, -2
#: Coefficients of the fixed predictors, newest sample first.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that is cut off, fails a checksum or has what the reader does not take."""


def crc_table(poly: int, bits: int) -> np.ndarray:
    top, full = 1 << (bits - 1), (1 << bits) - 1
    table = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        table = np.where(table & top, table << 1 ^ poly, table << 1) & full
    return table


CRC8, CRC16 = crc_table(0x07, 8).astype(np.uint16), crc_table(0x8005, 16).astype(np.uint16)


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, wide: bool) -> np.ndarray:
    """CRC-16 or CRC-8 of each ``data[start:end]``; leading zeros leave a CRC of zero alone, so all end together."""
    most = int((end - start).max(initial=0))
    by = np.argsort(start - end, kind="stable")  # the longest first: step k takes those of k bytes and more
    last, sizes = end[by], (end - start)[by]
    live = np.searchsorted(-sizes, -np.arange(most, 0, -1), side="right")
    crc = np.zeros(len(start), np.uint16)
    for k, n in zip(range(most, 0, -1), live.tolist()):
        own, byte = crc[:n], data[last[:n] - k]
        crc[:n] = own << 8 ^ CRC16[own >> 8 ^ byte] if wide else CRC8[own ^ byte]
    out = np.empty(len(start), np.int64)
    out[by] = crc
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of frame headers."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    lead = (0xFF << (8 - size)) & 0xFF if size < 7 else 0xFE
    return bytes([lead | n >> 6 * (size - 1), *(0x80 | n >> 6 * k & 0x3F for k in range(size - 2, -1, -1))])


# ---------------------------------------------------------------- writing


def linear_predictors(x: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames, order) and shifts of each frame, by autocorrelation and Levinson's recursion."""
    v = x.astype(np.float32) * np.hanning(x.shape[1] + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", v[:, k:], v[:, : v.shape[1] - k]) for k in range(order + 1)], axis=1).astype(np.float64)
    a, err = np.zeros((len(x), order)), r[:, 0] + 1e-9
    for i in range(order):
        k = np.clip((r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err, -1, 1)
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    room = (1 << (precision - 1)) - 1
    shift = np.clip(np.floor(np.log2(room / np.maximum(np.abs(a).max(axis=1), 1e-6))), 0, 15).astype(np.int32)
    return np.clip(np.rint(a * (1 << shift)[:, None]), -room - 1, room).astype(np.int32), shift


def residuals(x: np.ndarray, coefs: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What the predictors leave of each sample from the order-th on; coefficients newest sample first."""
    order = coefs.shape[1]
    out = x[:, order:].astype(np.int32)
    if order:
        said = sum(coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j].astype(np.int32) for j in range(order))
        out -= said >> shift[:, None]
    return out


def bits_about(total: np.ndarray, n: int) -> np.ndarray:
    """Bits of n residuals whose magnitudes add up to ``total``, each coded with the parameter that their mean asks for."""
    k = np.maximum(np.floor(np.log2(np.maximum(total / n, 1))), 0)
    return n * (k + 1) + 2 * total / 2**k


def rice_parameters(res: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals padded to a whole block, the parameter of each partition, and bits of each frame.

    The parameter is the best of the two on either side of the partition's mean.
    """
    full = np.zeros((len(res), BLOCK), np.int32)
    full[:, order:] = res << 1 ^ res >> 31
    full = full.reshape(len(res), 1 << PARTITION_ORDER, -1)
    size = np.full(1 << PARTITION_ORDER, full.shape[2])
    size[0] -= order
    first = np.clip(np.floor(np.log2(np.maximum(full.sum(axis=2) / size, 1))), 0, 13).astype(np.int32)
    low, high = ((full >> k[:, :, None]).sum(axis=2) + size * (k + 1) for k in (np.maximum(first - 1, 0), first))
    return full, np.where(low < high, np.maximum(first - 1, 0), first), np.minimum(low, high).sum(axis=1) + order * 8


class Writer:
    """Bit fields of many frames in one buffer of 64-bit words."""

    def __init__(self, nbytes: int) -> None:
        self.words = np.zeros(nbytes // 8 + 2, np.uint64)

    def put(self, at: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """Set fields of at most 32 bits at rising bit places; fields don't overlap, so at most one crosses into a word."""
        word, room = at >> 6, 64 - (at & 63) - bits
        value = value.astype(np.uint64)
        over = np.flatnonzero(room < 0)
        own = value << np.maximum(room, 0).astype(np.uint64)
        own[over] = value[over] >> (-room[over]).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        self.words[word[first]] |= np.bitwise_or.reduceat(own, first)
        self.words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)

    def bytes(self) -> np.ndarray:
        return self.words.astype(">u8").view(np.uint8)


def write_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of ``samples`` (frames, BLOCK) with their numbers.

    The predictor, fixed or linear, is the one that promises fewest bits by the
    sum of its residuals' magnitudes.
    """
    n, x = len(samples), samples.astype(np.int16)
    promised, left = [], x
    for order in range(len(FIXED)):
        left = np.diff(left, axis=1) if order else left
        promised.append(bits_about(np.abs(left).sum(axis=1, dtype=np.int64), BLOCK - order) + 8 * order)
    fixed = np.stack(promised)
    choice, least = fixed.argmin(axis=0), fixed.min(axis=0)
    coefs, shift = linear_predictors(x, LPC_ORDER, LPC_PRECISION)
    tried = bits_about(np.abs(residuals(x, coefs, shift)).sum(axis=1), BLOCK - LPC_ORDER) + 8 * LPC_ORDER + 9 + LPC_PRECISION * LPC_ORDER
    choice[tried < least] = LINEAR
    choice[(x == x[:, :1]).all(axis=1)] = CONSTANT
    out: list[bytes] = [b""] * n
    for pick in np.unique(choice).tolist():
        rows = np.flatnonzero(choice == pick)
        own = (coefs[rows], shift[rows]) if pick == LINEAR else None
        for row, frame in zip(rows.tolist(), write_kind(x[rows], numbers[rows], pick, own)):
            out[row] = frame
    return out


def write_kind(x: np.ndarray, numbers: np.ndarray, pick: int, predictors: tuple[np.ndarray, np.ndarray] | None) -> list[bytes]:
    """Frames that share a kind of subframe; those that coding would not shorten are stored verbatim."""
    n = len(x)
    if pick >= 0:
        order = LPC_ORDER if pick == LINEAR else pick
        coefs, shift = predictors or (np.tile(np.array(FIXED[order], np.int32), (n, 1)).reshape(n, order), np.zeros(n, np.int32))
        full, best, cost = rice_parameters(residuals(x, coefs, shift), order)
        plain = np.flatnonzero(cost + 22 >= BLOCK * 8)
        if len(plain) and n > len(plain):
            coded = np.flatnonzero(cost + 22 < BLOCK * 8)
            parts = write_kind(x[coded], numbers[coded], pick, predictors and (coefs[coded], shift[coded])), write_kind(x[plain], numbers[plain], VERBATIM, None)
            back = np.argsort(np.concatenate([coded, plain]), kind="stable").tolist()
            frames = parts[0] + parts[1]
            return [frames[k] for k in back]
        if len(plain):
            pick = VERBATIM
    # sync and fixed block size; 576 samples; 8 kHz; mono; 8 bits
    heads = [bytes([0xFF, 0xF8, 0x24, 0x02]) + coded_number(int(k)) for k in numbers]
    head = np.array([len(h) + 1 for h in heads])
    fields: list[tuple[np.ndarray, int]] = []  # values by frame, bits
    lengths = head * 8 + 8
    if pick == CONSTANT:
        kind, lengths = 0, lengths + 8
    elif pick == VERBATIM:
        kind, lengths = 1, lengths + 8 * BLOCK
    else:
        kind = 31 + order if pick == LINEAR else 8 + order
        fields = [(x[:, k] & 255, 8) for k in range(order)]
        if pick == LINEAR:
            fields += [(np.full(n, LPC_PRECISION - 1), 4), (shift, 5)]
            fields += [(coefs[:, k] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION) for k in range(order)]
        fields += [(np.full(n, PARTITION_ORDER), 6)]
        fixed = sum(b for _, b in fields)
        per = full.shape[2]
        k = np.repeat(best, per, axis=1)
        values = full.reshape(n, -1)
        quotient = values >> k
        sizes = quotient + 1 + k
        sizes[:, :order] = 0
        sizes[:, ::per] += 4  # each partition's parameter stands before its first code
        ends = np.cumsum(sizes, axis=1, dtype=np.int64)
        lengths = lengths + fixed + ends[:, -1]
    nbytes = (lengths + 7) // 8 + 2
    base = np.concatenate([[0], np.cumsum(nbytes)[:-1]])
    writer = Writer(int(nbytes.sum()))
    at = (base + head + 1) * 8
    if pick >= 0:
        for value, bits in fields:
            writer.put(at, value, np.full(n, bits))
            at = at + bits
        starts = at[:, None] + ends - sizes
        lead = starts[:, ::per]
        writer.put(lead.ravel(), best.ravel(), np.full(best.size, 4))
        starts[:, ::per] += 4
        code = 1 << k | values & ((1 << k) - 1)
        places, widths = starts + quotient, k + 1
        if order:
            live = np.ones(values.shape, bool)
            live[:, :order] = False
            places, code, widths = places[live], code[live], widths[live]
        writer.put(places.ravel(), code.ravel(), widths.ravel())
    data = writer.bytes()
    for b, h in zip(base.tolist(), heads):
        data[b : b + len(h)] = np.frombuffer(h, np.uint8)
    data[base + head - 1] = crcs(data, base, base + head - 1, False)
    data[base + head] = kind << 1
    if pick == CONSTANT:
        data[base + head + 1] = x[:, 0] & 255
    elif pick == VERBATIM:
        data[((base + head + 1)[:, None] + np.arange(BLOCK)).ravel()] = (x & 255).ravel()
    tail = base + nbytes - 2
    check = crcs(data, base, tail, True)
    data[tail], data[tail + 1] = check >> 8, check & 255
    raw = data.tobytes()
    return [raw[b : b + m] for b, m in zip(base.tolist(), nbytes.tolist())]


def streams(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of BLOCK."""
    counts = [len(p) // BLOCK for p in payloads]
    frames: list[bytes] = []
    joined = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    numbers = np.concatenate([np.arange(c) for c in counts])
    for at in range(0, len(joined), FRAMES):
        frames += write_frames(joined[at : at + FRAMES].astype(np.int16) - 128, numbers[at : at + FRAMES])
    out, first = [], 0
    for payload, count in zip(payloads, counts):
        own = frames[first : first + count]
        first += count
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
        info = BLOCK.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3)
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8) + hashlib.md5(signed).digest()
        seek = np.zeros(count, np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")]))
        seek["sample"] = np.arange(count) * BLOCK
        seek["byte"] = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        seek["n"] = BLOCK
        points = seek.tobytes()
        tables = [points[k : k + MOST_POINTS * 18] for k in range(0, len(points), MOST_POINTS * 18)]
        blocks = [(0, info), *((3, t) for t in tables)]
        meta = b"".join(bytes([kind | 128 * (k == len(blocks) - 1)]) + len(b).to_bytes(3) + b for k, (kind, b) in enumerate(blocks))
        out.append(b"fLaC" + meta + b"".join(own))
    return out


#: A metadata block holds under 2**24 bytes; longer seek tables go on in the next one.
MOST_POINTS = 900_000


# ---------------------------------------------------------------- reading


class Head(NamedTuple):
    block: int
    samples: int
    md5: bytes
    audio: int
    seek: np.ndarray | None


def read_head(stream: bytes) -> Head:
    """Stream information and seek points (sample, byte, n); raises FlacError."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, info, points = 4, False, b"", []
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata is cut off")
        last, kind, size = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            info = body
        elif kind == 3:
            points.append(body)
    if len(info) < 34:
        raise FlacError("no stream information")
    packed = int.from_bytes(info[10:18])
    if packed >> 41 & 7 or packed >> 36 & 31 != 7 or info[:2] != info[2:4]:
        raise FlacError("only mono streams of 8-bit samples and one block size are read")
    seek = np.frombuffer(b"".join(points), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])) if points else None
    return Head(int.from_bytes(info[:2]), packed & (1 << 36) - 1, info[18:34], at, seek)


class Bits:
    """A bit cursor for each of many frames in one buffer."""

    def __init__(self, data: bytes, at: np.ndarray) -> None:
        self.words = np.ndarray(shape=(max(1, len(data)),), dtype=">u8", buffer=data + b"\0" * 16, strides=(1,))
        self.at = at.astype(np.int64) * 8

    def window(self, rows: np.ndarray | slice) -> np.ndarray:
        """At least 57 bits from each cursor on, at the top of 64."""
        at = self.at[rows]
        byte = np.minimum(at >> 3, len(self.words) - 1)
        return self.words[byte].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, rows: np.ndarray | slice, bits: int | np.ndarray) -> np.ndarray:
        """Unsigned numbers of ``bits`` (0..56) bits."""
        width = np.asarray(bits, np.int64)
        got = (self.window(rows) >> np.uint64(1) >> (63 - width).astype(np.uint64)).astype(np.int64)
        self.at[rows] += width
        return got

    def signed(self, rows: np.ndarray | slice, bits: int | np.ndarray) -> np.ndarray:
        got, half = self.take(rows, bits), np.int64(1) << np.maximum(np.asarray(bits, np.int64) - 1, 0)
        return np.where(np.asarray(bits) > 0, (got ^ half) - half, 0)

    def zeros(self, rows: np.ndarray) -> np.ndarray:
        """Length of the run of zeros before the next one, which is passed as well."""
        run = np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            n = leading_zeros(self.window(rows[left]))
            run[left] += n
            self.at[rows[left]] += n + (n < 53)
            if (self.at[rows[left]] >> 3 > len(self.words)).any():
                raise FlacError("a residual is cut off")
            left = left[n == 53]
        return run

    def rice(self, rows: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rice codes with parameters ``k`` at bit places ``at``, and where they end; ``rows`` own the places.

        A code lies in one window of 57 bits almost always; longer ones are read piece by piece.
        """
        byte = at >> 3
        if byte.size and byte.max() >= len(self.words):
            raise FlacError("a residual is cut off")
        window = self.words[byte].astype(np.uint64) << (at & 7).astype(np.uint64)
        run = leading_zeros(window)
        value = run << k | (window << (run + 1).astype(np.uint64) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        end = at + run + 1 + k
        long = np.flatnonzero(run + 1 + k > 53)
        if len(long):
            self.at[rows[long]] = at[long]
            value[long] = self.zeros(rows[long]) << k[long] | self.take(rows[long], k[long])
            end[long] = self.at[rows[long]]
        return value, end


def leading_zeros(window: np.ndarray) -> np.ndarray:
    """Zeros at the top of 64-bit words, 53 at most: read off the exponent of the upper 53 bits as a number."""
    return np.minimum(1075 - ((window >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52), 53)


def read_frames(data: bytes, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(samples (frames, block), frame numbers, ends) of frames that begin at byte ``starts``; checksums are verified."""
    n = len(starts)
    raw = np.frombuffer(data + b"\0" * 16, np.uint8)
    bits, every = Bits(data, starts), np.arange(n)
    if (bits.take(every, 16) != 0xFFF8).any():
        raise FlacError("a frame does not begin with its sync code")
    size_code, rate_code = bits.take(every, 4), bits.take(every, 4)
    if (bits.take(every, 4) != 0).any() or not np.isin(bits.take(every, 4) >> 1, (0, 1)).all():
        raise FlacError("a frame is not mono with 8 bits")
    lead = bits.take(every, 8)
    more = np.where(lead < 0x80, 0, np.where(lead < 0xE0, 1, np.where(lead < 0xF0, 2, np.where(lead < 0xF8, 3, np.where(lead < 0xFC, 4, np.where(lead < 0xFE, 5, 6))))))
    number = np.where(more > 0, lead & np.maximum((1 << np.maximum(6 - more, 0)) - 1, 0), lead)
    for k in range(int(more.max(initial=0))):
        rows = np.flatnonzero(more > k)
        number[rows] = number[rows] << 6 | bits.take(rows, 8) & 63
    length = np.full(n, block)
    for code, width in ((6, 8), (7, 16)):
        rows = np.flatnonzero(size_code == code)
        length[rows] = bits.take(rows, width) + 1
    named = np.flatnonzero((size_code != 6) & (size_code != 7))
    sizes = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, *(256 << k for k in range(8))])
    length[named] = sizes[size_code[named]]
    for code, width in ((12, 8), (13, 16), (14, 16)):
        bits.take(np.flatnonzero(rate_code == code), width)
    if (length > block).any() or (length < 1).any():
        raise FlacError("a frame's block size is not the stream's")
    ends = bits.at >> 3
    if (crcs(raw, starts, ends, False) != bits.take(every, 8)).any():
        raise FlacError("a frame header fails its CRC-8")
    kind = bits.take(every, 8)
    if (kind >> 7).any():
        raise FlacError("a subframe header is damaged")
    wasted = np.zeros(n, np.int64)
    rows = np.flatnonzero(kind & 1)
    if len(rows):
        wasted[rows] = bits.zeros(rows) + 1
    kind, depth = kind >> 1 & 63, 8 - wasted
    out = np.zeros((n, block), np.int64)
    for group in np.unique(kind * 65536 + length).tolist():
        rows, k, size = np.flatnonzero(kind * 65536 + length == group), group >> 16, group & 65535
        if k == 0:
            out[rows, :size] = bits.signed(rows, depth[rows])[:, None]
        elif k == 1:
            for i in range(size):
                out[rows, i] = bits.signed(rows, depth[rows])
        elif 8 <= k <= 12 or k >= 32:
            read_predicted(bits, rows, k - 8 if k < 32 else k - 31, k >= 32, size, depth[rows], out)
        else:
            raise FlacError("a subframe has a reserved kind")
    out <<= wasted[:, None]
    ends = (bits.at + 7) // 8
    bits.at = ends * 8
    if (ends + 2 > len(data)).any() or (crcs(raw, starts, ends, True) != bits.take(every, 16)).any():
        raise FlacError("a frame fails its CRC-16")
    return out, number, ends + 2


def read_predicted(bits: Bits, rows: np.ndarray, order: int, linear: bool, size: int, depth: np.ndarray, out: np.ndarray) -> None:
    """Warm-up samples, Rice residuals and the predictors' sums of frames with one order."""
    n = len(rows)
    x = np.zeros((size, n), np.int64)  # a row for each step
    for i in range(min(order, size)):
        x[i] = bits.signed(rows, depth)
    if linear:
        precision = bits.take(rows, 4) + 1
        shift = bits.signed(rows, 5)
        if (shift < 0).any():
            raise FlacError("a predictor's shift is negative")
        coefs = [bits.signed(rows, precision) for _ in range(order)]
    else:
        shift, coefs = np.zeros(n, np.int64), [np.full(n, c) for c in FIXED[order]]
    method, parts = bits.take(rows, 2), bits.take(rows, 4)
    if (method > 1).any():
        raise FlacError("a residual has a reserved method")
    for p in np.unique(parts).tolist():
        here = np.flatnonzero(parts == p)
        own, per = rows[here], size >> p
        wide = np.where(method[here] == 1, 5, 4)
        if per << p != size or per < order:
            raise FlacError("a partition order does not fit")
        for part in range(1 << p):
            k = bits.take(own, wide)
            escaped = k == (1 << wide) - 1
            plain, odd = np.flatnonzero(~escaped), np.flatnonzero(escaped)
            rows_plain, k_plain = own[plain], k[plain]
            all_plain = not len(odd)
            if not all_plain:
                width = bits.take(own[odd], 5)
            at = bits.at[rows_plain]
            for i in range(part * per + (order if part == 0 else 0), (part + 1) * per):
                folded, at = bits.rice(rows_plain, at, k_plain)
                x[i, here if all_plain else here[plain]] = folded >> 1 ^ -(folded & 1)
                if not all_plain:
                    x[i, here[odd]] = bits.signed(own[odd], width)
            bits.at[rows_plain] = at
    if order:
        for i in range(order, size):
            said = coefs[0] * x[i - 1]
            for j in range(1, order):
                said += coefs[j] * x[i - 1 - j]
            x[i] += said >> shift
    out[rows, :size] = x.T


def read_many(found: list[bytes]) -> list[bytes]:
    """Payloads of streams; frames of all of them are decoded side by side.  Raises FlacError."""
    heads = [read_head(s) for s in found]
    indexed = [h.seek is not None and h.block == BLOCK and len(h.seek) * BLOCK == h.samples for h in heads]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])])
    plain = [k for k, yes in enumerate(indexed) if yes]
    none = np.zeros(0, np.int64)
    starts = np.concatenate([none, *(offsets[k] + heads[k].audio + heads[k].seek["byte"].astype(np.int64) for k in plain)])
    told = np.concatenate([none, *(np.arange(len(heads[k].seek)) for k in plain)])
    data, samples = b"".join(found), [np.zeros(0, np.uint8)]
    for at in range(0, len(starts), FRAMES):
        part, numbers, _ = read_frames(data, starts[at : at + FRAMES], BLOCK)
        if (numbers != told[at : at + FRAMES]).any():
            raise FlacError("a seek point leads to another frame")
        samples.append((part + 128).astype(np.uint8).reshape(-1))
    flat, first, out = np.concatenate(samples), 0, []
    for stream, head, yes in zip(found, heads, indexed):
        payload = flat[first : first + head.samples] if yes else walk(stream, head)
        first += head.samples if yes else 0
        if any(head.md5) and hashlib.md5((payload ^ 128).tobytes()).digest() != head.md5:
            raise FlacError("the stream fails its MD5")
        out.append(payload.tobytes())
    return out


def walk(stream: bytes, head: Head) -> np.ndarray:
    """Samples as bytes of a stream without a full seek table, one frame after the other."""
    at, left, parts = head.audio, head.samples, []
    while left > 0:
        part, _, ends = read_frames(stream, np.array([at]), head.block)
        size = min(head.block, left)
        parts.append((part[0, :size] + 128).astype(np.uint8))
        at, left = int(ends[0]), left - size
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


# ---------------------------------------------------------------- columns


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text (null: none) with bytes 255 up to a positive multiple of BLOCK, and its own length."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % BLOCK if raw else BLOCK), len(raw)


def feature(payload: bytes) -> str:
    """Peak, sum of magnitudes, energy and zero crossings of the samples read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    size = np.abs(x)
    return f"peak={size.max(initial=0)};sum={size.sum(dtype=np.int64)};energy={np.square(x.astype(np.int32)).sum(dtype=np.int64)};crossings={np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))}"


def lots(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of about GATHERED bytes; a longer row is one by itself."""
    first = end = held = 0
    for size in sizes:
        end, held = end + 1, held + size
        if held >= GATHERED:
            yield first, end
            first, held = end, 0
    if end > first:
        yield first, end


def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) as rows (id, n_bytes, media)."""
    for b in batches:
        texts, at = b.column(1), 0
        for first, end in lots(4 * len(t.as_py() or "") for t in texts):  # a code point has 4 bytes at most
            part = [padded(t.as_py()) for t in texts.slice(first, end - first)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array([n for _, n in part], pa.int64()), pa.array(streams([p for p, _ in part]), pa.binary())], [b.schema.names[0], "n_bytes", "media"])
            at += len(part)


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, n_bytes, media) as rows (id, n_bytes, media_bytes, media_sha256, blocks)."""
    for b in batches:
        sizes = (len(v.as_py() or b"") for v in b.column(2))
        for first, end in lots(sizes):
            part = b.slice(first, end - first)
            found = part.column(2).to_pylist()
            have = [s for s in found if s is not None]
            heads, payloads = [read_head(s) for s in have], read_many(have)
            starts = [np.arange(0, h.samples, h.block) for h in heads]
            ends = [np.minimum(s + h.block, h.samples) for s, h in zip(starts, heads)]
            seek = [h.audio + h.seek["byte"].astype(np.int64) if h.seek is not None and len(h.seek) == len(s) else np.full(len(s), -1) for h, s in zip(heads, starts)]
            joined = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
            cuts = np.concatenate([[0], np.cumsum(joined([e - s for s, e in zip(starts, ends)]))]).astype(np.int32)
            pcm = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(b"".join(payloads))])
            blocks = pa.StructArray.from_arrays([pa.array(joined(starts), pa.int64()), pa.array(joined(seek), pa.int64()), pcm], ["sample_offset", "byte_offset", "pcm"])
            counts, each = np.zeros(len(found), np.int64), iter(starts)
            counts[:] = [0 if s is None else len(next(each)) for s in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(s is None for s in found), False]))
            digests = pa.array([None if s is None else hashlib.sha256(s).hexdigest() for s in found], pa.string())
            lengths = pa.array([None if s is None else len(s) for s in found], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lengths, digests, pa.ListArray.from_arrays(offsets, blocks)], [b.schema.names[0], "n_bytes", *PCM])


BLOCKS = T.ArrayType(T.StructType().add("sample_offset", "long").add("byte_offset", "long").add("pcm", "binary"))
PCM = {"media_bytes": "long", "media_sha256": "string", "blocks": BLOCKS}


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_bytes`` and ``media``, the FLAC stream of the padded text.

    Null and empty texts are one block of padding.  Rows may repeat, ids may be
    null, other columns are not read; equal texts give equal streams.
    """
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(encode_batches, docs.select(id_col).schema.add("n_bytes", "long").add("media", "binary"))


def pcm_schema(rows: DataFrame, id_col: str) -> T.StructType:
    schema = rows.select(id_col).schema.add("n_bytes", "long")
    for name, kind in PCM.items():
        schema = schema.add(name, kind)
    return schema


def pcm(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``media``: ``id_col``, ``n_bytes``, ``media_bytes``, ``media_sha256`` and ``blocks``.

    ``blocks`` are the stream's frames, decoded and verified, in order: sample
    offset, byte offset in the stream (its seek point, -1 without one) and PCM
    bytes, so any sample can be sought in either form.  A null stream gives
    nulls; rows may repeat, ids may be null; a damaged stream fails the task.
    """
    return stored.select(id_col, "n_bytes", "media").mapInArrow(decode_batches, pcm_schema(stored, id_col))


def recorded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pcm(media(docs))`` in one pass of the workers, so no stream crosses to the JVM and back."""
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(lambda batches: decode_batches(encode_batches(batches)), pcm_schema(docs, id_col))


def pcm_blocks(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The frames of ``media`` as rows: ``id_col``, ``sample_offset``, ``byte_offset`` (seek point) and ``pcm``; none for a null stream."""
    return pcm(stored, id_col).select(id_col, F.inline("blocks"))


def read_back(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of what is read back from rows of :func:`pcm`.

    Columns: ``id_col``, ``n_bytes``, ``payload_bytes``, ``payload_sha256``,
    ``tail_crc32`` (of the last 32 bytes), ``media_bytes``, ``media_sha256``,
    ``feature``.  Null blocks give null digests.  Rows may repeat and ids be
    null; blocks whose sample offsets leave a gap fail the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            at, _, samples = lists.values.flatten()
            cuts, data = np.frombuffer(samples.buffers()[1], np.int32)[samples.offset : samples.offset + len(samples) + 1] if len(samples) else np.zeros(1, np.int32), samples.buffers()[2]
            places, rows, found = at.to_numpy(), lists.offsets.to_numpy(), []
            for k, given in enumerate(lists.is_valid().to_pylist()):
                own = cuts[rows[k] : rows[k + 1] + 1]
                if given and (places[rows[k] : rows[k + 1]] != own[:-1] - own[0]).any():
                    raise FlacError("the blocks leave a gap")
                payload = data[int(own[0]) : int(own[-1])].to_pybytes() if given and data is not None else b""
                found.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(payload)) if given else (None,) * 4)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            size, digest, crc, said = (pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, digest, crc, b.column(2), b.column(3), said], schema.names)

    schema = blocks.select(id_col).schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    return blocks.select(id_col, "n_bytes", "media_bytes", "media_sha256", "blocks").mapInArrow(run, schema)
