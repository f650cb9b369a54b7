"""FLAC (RFC 9639) in numpy: many frames advance together, one sample or byte a step.

encode writes mono 8-bit streams of fixed-predictor, constant and verbatim frames with a seek point for every frame.
decode reads any stream of 4 to 32 bits: constant, verbatim, fixed and linear predictors, Rice codes of both sizes with
escapes, wasted bits and stereo decorrelation; header CRC-8 and frame CRC-16 are verified for every frame, and the MD5 of the
samples where the stream states one. Frames are found by the seek table or, failing that, by sync codes and checksums.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import batch_of

BLOCK = 576
RATE = 8000
#: Frames that are coded together; bounds the memory of a task.
TOGETHER = 4096


class FlacError(ValueError):
    """The bytes are no FLAC stream, or a checksum fails."""


def crc_table(bits: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, table << 1 ^ poly, table << 1) & ((1 << bits) - 1)
    return table.astype(np.uint16)


CRC8, CRC16 = crc_table(8, 0x07), crc_table(16, 0x8005)


def crc_of_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each range of bytes. The register starts at 0, so shorter ranges are led by zeros and all advance together."""
    table, out = (CRC8, CRC16)[bits == 16], np.zeros(len(starts), np.uint16)
    longest = int((ends - starts).max(initial=0))
    for at in range(-longest, 0):
        where = ends + at
        byte = np.where(where >= starts, data[np.maximum(where, 0)], 0)
        out = table[out ^ byte] if bits == 8 else (out << np.uint16(8)) ^ table[(out >> np.uint16(8)) ^ byte]
    return out


def utf8_number(n: int) -> bytes:
    """FLAC's coded number: UTF-8 stretched to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 6
    while n >= 1 << room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room = 6 - len(tail)
    return bytes([(0xFF00 >> len(tail) + 1) & 0xFF | n, *reversed(tail)])


# ---------------------------------------------------------------- encoding


def scatter(total_bits: int, starts: np.ndarray, values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Bytes with each value (of widths bits, 16 at most) written at its bit position; values don't overlap."""
    at, shifted = starts >> 3, values.astype(np.int64) << (24 - (starts & 7) - widths)
    size = (total_bits >> 3) + 4
    out = np.zeros(size, np.float64)
    for i in range(3):
        out += np.bincount(at + i, weights=(shifted >> (16 - 8 * i)) & 0xFF, minlength=size)[:size]
    return out.astype(np.uint8)


def rice_plan(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each frame (row) the best fixed order of 0 to 2 and Rice parameter, and its bits; order -1 is constant, -2 verbatim."""
    n = samples.shape[1]
    best, order, rice = np.full(len(samples), 8 * n + 8, np.int64), np.full(len(samples), -2), np.zeros(len(samples), np.int64)
    residual = samples
    for o in range(3):
        if o:
            residual = np.diff(residual, axis=1)
        folded = np.where(residual < 0, -2 * residual - 1, 2 * residual)
        for k in range(8):
            bits = 8 + 8 * o + 10 + (folded >> k).sum(1, dtype=np.int64) + (n - o) * (k + 1)
            better = bits < best
            best[better], order[better], rice[better] = bits[better], o, k
    constant = (samples == samples[:, :1]).all(1)
    order[constant], best[constant] = -1, 16
    return order, rice, best


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of signed 8-bit samples (a row each) as bytes, and where each begins (and the last end)."""
    count, n = samples.shape
    order, rice, bits = rice_plan(samples)
    heads = [b"\xff\xf8\x20\x02" + utf8_number(int(i)) for i in numbers]
    sizes = np.array([len(h) for h in heads]) + 1
    ends = np.cumsum(sizes + (bits + 7 >> 3) + 2)
    begins = np.concatenate([[0], ends])
    starts: list[np.ndarray] = []
    values: list[np.ndarray] = []
    widths: list[np.ndarray] = []

    def put(at: np.ndarray, value: np.ndarray | int, width: np.ndarray | int) -> None:
        starts.append(at.ravel())
        values.append(np.broadcast_to(value, at.shape).ravel())
        widths.append(np.broadcast_to(width, at.shape).ravel())

    body = 8 * (begins[:-1] + sizes)
    kinds = np.where(order >= 0, 0b001000 | np.maximum(order, 0), np.where(order == -1, 0, 1))
    put(body, kinds << 1, 8)
    for o in (-2, -1, 0, 1, 2):
        rows = np.flatnonzero(order == o)
        if not len(rows):
            continue
        x, at, plain = samples[rows], body[rows] + 8, {-2: n, -1: 1}.get(o, o)
        put(at[:, None] + 8 * np.arange(plain), x[:, :plain] & 0xFF, 8)
        if o < 0:
            continue
        residual = np.diff(x, n=o, axis=1)
        folded, k = np.where(residual < 0, -2 * residual - 1, 2 * residual), rice[rows][:, None]
        at = at + 8 * o
        put(at + 6, rice[rows], 4)  # before it, six zeros: the four-bit method, one partition
        stop = (at + 10)[:, None] + np.cumsum((folded >> k) + k + 1, axis=1)
        put(stop - k - 1, 1 << k | folded & (1 << k) - 1, np.broadcast_to(k + 1, folded.shape))
    data = scatter(8 * int(ends[-1]), np.concatenate(starts), np.concatenate(values), np.concatenate(widths))[: ends[-1]]
    flat = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.repeat(begins[:-1] - np.concatenate([[0], np.cumsum(sizes - 1)])[:-1], sizes - 1) + np.arange(len(flat))
    data[head_at] = flat
    data[begins[:-1] + sizes - 1] = crc_of_ranges(data, begins[:-1], begins[:-1] + sizes - 1, 8)
    check = crc_of_ranges(data, begins[:-1], ends - 2, 16)
    data[ends - 2], data[ends - 1] = check >> 8, check & 0xFF
    return data, begins


def stream_head(samples: bytes, frame_sizes: np.ndarray) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE of a mono 8-bit stream whose samples are signed bytes."""
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(samples)
    info = BLOCK.to_bytes(2, "big") * 2 + int(frame_sizes.min()).to_bytes(3, "big") + int(frame_sizes.max()).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(samples).digest()
    step = -(-len(frame_sizes) // 900_000)  # a metadata block holds under 16 MiB
    points = np.zeros(len(range(0, len(frame_sizes), step)), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
    points["sample"], points["offset"], points["samples"] = np.arange(0, len(frame_sizes), step) * BLOCK, np.concatenate([[0], np.cumsum(frame_sizes)])[:-1:step], BLOCK
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def encode(payloads: list[bytes]) -> list[bytes]:
    """One stream for each payload, whose length is a positive multiple of BLOCK; byte b is the sample b - 128."""
    signed = [p.translate(FLIP) for p in payloads]
    numbers = np.concatenate([np.arange(len(p) // BLOCK) for p in payloads])
    samples = np.frombuffer(b"".join(signed), np.int8).reshape(-1, BLOCK)
    parts, sizes = [], []
    for at in range(0, len(samples), TOGETHER):
        data, begins = encode_frames(samples[at : at + TOGETHER].astype(np.int32), numbers[at : at + TOGETHER])
        parts.append(data.tobytes())
        sizes.append(np.diff(begins))
    frames, size, out, done, first = b"".join(parts), np.concatenate(sizes), [], 0, 0
    for p in signed:
        own = size[first : first + len(p) // BLOCK]
        first, end = first + len(own), done + int(own.sum())
        out.append(stream_head(p, own) + frames[done:end])
        done = end
    return out


FLIP = bytes(b ^ 0x80 for b in range(256))


# ---------------------------------------------------------------- decoding


@dataclass(frozen=True)
class Stream:
    """What the metadata of a stream says, and where its frames begin."""

    channels: int
    bits: int
    rate: int
    samples: int
    block: int
    md5: bytes
    seek: np.ndarray
    first: int


def read_head(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info, seek = 4, None, np.zeros((0, 3), np.int64)
    while True:
        if at + 4 > len(data):
            raise FlacError("the metadata end early")
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            info = block
        elif kind == 3:
            points = np.frombuffer(block[: size // 18 * 18], np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")]))
            points = points[points["sample"] != 2**64 - 1]
            seek = np.stack([points[k].astype(np.int64) for k in ("sample", "offset", "samples")], 1)
        if last:
            break
    if info is None or len(info) < 34:
        raise FlacError("no STREAMINFO")
    packed = int.from_bytes(info[10:18], "big")
    return Stream((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed >> 44, packed & (1 << 36) - 1, int.from_bytes(info[2:4], "big"), bytes(info[18:34]), seek, at)


# Block sizes and bits a sample by their codes in a frame header; 0: stated elsewhere.
BLOCK_SIZES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])
SAMPLE_BITS = np.array([0, 8, 12, 0, 16, 20, 24, 32])


@dataclass
class Heads:
    """Headers of frames, an entry each."""

    length: np.ndarray
    block: np.ndarray
    assignment: np.ndarray
    bits: np.ndarray
    number: np.ndarray
    by_sample: np.ndarray
    valid: np.ndarray


def read_frame_heads(data: np.ndarray, starts: np.ndarray) -> Heads:
    """data has 32 zero bytes at its end."""
    at = lambda i: data[np.minimum(starts + i, len(data) - 1)].astype(np.int64)
    a, b, c, d, lead = (at(i) for i in range(5))
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, -1, 1, 2, 3, 4, 5], 6)
    number = np.where(more == 0, lead, lead & (0x3F >> np.maximum(more, 0)))
    for i in range(6):
        number = np.where(i < more, number << 6 | at(5 + i) & 0x3F, number)
    size_code, rate_code, length = c >> 4, c & 15, 5 + np.maximum(more, 0)
    extra = np.select([size_code == 6, size_code == 7], [1, 2], 0)
    high, low = (data[np.minimum(starts + length + i, len(data) - 1)].astype(np.int64) for i in (0, 1))
    block = np.where(extra == 1, high + 1, np.where(extra == 2, (high << 8 | low) + 1, BLOCK_SIZES[size_code]))
    length = length + extra + np.select([rate_code == 12, rate_code == 13, rate_code == 14], [1, 2, 2], 0)
    valid = (a == 0xFF) & (b & 0xFE == 0xF8) & (more >= 0) & (block > 0) & (rate_code < 15) & (d >> 4 < 11) & (d & 1 == 0) & (starts + length < len(data) - 32)
    stated = data[np.minimum(starts + length, len(data) - 1)]
    valid[valid] = crc_of_ranges(data, starts[valid], (starts + length)[valid], 8) == stated[valid]
    return Heads(length + 1, block, d >> 4, SAMPLE_BITS[d >> 1 & 7], number, b & 1 == 1, valid)


def frame_starts(data: np.ndarray, stream: Stream, end: int) -> np.ndarray:
    """Where the frames begin, with the end last; by the seek table if it has them all, else by sync codes whose checksums hold."""
    if len(stream.seek) and stream.seek[:, 2].sum() == stream.samples and stream.seek[0, 1] == 0:
        return np.append(stream.first + stream.seek[:, 1], end)
    sync = stream.first + np.flatnonzero((data[stream.first : end - 1] == 0xFF) & (data[stream.first + 1 : end] & 0xFE == 0xF8))
    sync = sync[read_frame_heads(data, sync).valid] if len(sync) else sync
    if not len(sync) or sync[0] != stream.first:
        raise FlacError("no frame follows the metadata")
    while True:  # a sync code within a frame makes two ranges whose checksums fail
        ends = np.append(sync[1:], end)
        wrong = crc_of_ranges(data, sync, ends, 16) != 0
        if not wrong.any():
            return np.append(sync, end)
        i = int(np.argmax(wrong))
        if i + 1 == len(sync):
            raise FlacError(f"the checksum of the frame at byte {sync[i]} fails")
        sync = np.delete(sync, i + 1)


class Bits:
    """A reader at a bit position for each frame; all read together."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        grown = np.lib.stride_tricks.sliding_window_view(data, 8)
        self.words = np.ascontiguousarray(grown).view(">u8").ravel().astype(np.uint64)
        self.at = at.astype(np.int64)

    def window(self, rows: np.ndarray | slice) -> np.ndarray:
        """The next 57 bits at least of each, leftmost."""
        at = self.at[rows]
        if len(at) and at.max(initial=0) >> 3 >= len(self.words):
            raise FlacError("the stream ends within a frame")
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, n: np.ndarray | int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Unsigned numbers of n bits, 0 to 57."""
        n = np.broadcast_to(n, self.at[rows].shape).astype(np.int64)
        out = self.window(rows) >> np.maximum(64 - n, 1).astype(np.uint64) >> (n == 0).astype(np.uint64)
        self.at[rows] += n
        return np.where(n == 0, 0, out).astype(np.int64)

    def signed(self, n: np.ndarray | int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        out = self.take(n, rows)
        return out - (out >> np.maximum(np.asarray(n) - 1, 0) & 1) * (np.int64(1) << np.asarray(n))

    def unary(self, rows: np.ndarray) -> np.ndarray:
        """Zeros before the next one, which is passed."""
        total, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(live):
            own = rows[live]
            top = (self.window(own) >> np.uint64(32)).astype(np.float64)
            zeros = np.where(top > 0, 32 - np.frexp(top)[1], 32)
            total[live] += zeros
            self.at[own] += zeros + (top > 0)
            live = live[top == 0]
        return total


def read_residuals(bits: Bits, rows: np.ndarray, block: int, order: np.ndarray, out: np.ndarray) -> None:
    """Rice-coded residuals of the given frames into out[rows, order:block]."""
    method = bits.take(2, rows)
    if (method > 1).any():
        raise FlacError("an unknown residual code")
    partitions = np.int64(1) << bits.take(4, rows)
    if ((block % partitions != 0) | (block // partitions < order)).any():
        raise FlacError("a bad partition order")
    width, span = 4 + method, block // partitions
    rice, raw = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
    begin = order.copy()  # where each frame's next partition begins
    at, words, every = bits.at[rows], bits.words, np.arange(len(rows))
    last_word = len(words) - 1
    for i in range(int(order.min()), block):
        fresh = every[begin == i]
        if len(fresh):
            bits.at[rows] = at
            own = rows[fresh]
            rice[fresh] = bits.take(width[fresh], own)
            escaped = rice[fresh] == (1 << width[fresh]) - 1
            raw[fresh] = -1
            raw[fresh[escaped]] = bits.take(5, own[escaped])
            begin[fresh] = (i // span[fresh] + 1) * span[fresh]
            at = bits.at[rows]
            k = rice.astype(np.uint64)
            down = (np.uint64(63) - k)
            plain_only = not (raw >= 0).any() and not (order > i).any()
        elif i and not plain_only:
            plain_only = not (raw >= 0).any() and not (order > i).any()
        if (at >> 3).max() > last_word:
            raise FlacError("the stream ends within a frame")
        window = words[at >> 3] << (at & 7).astype(np.uint64)
        top = (window >> np.uint64(32)).astype(np.float64)
        zeros = 32 - np.frexp(top)[1].astype(np.int64)
        if plain_only and top.min() > 0 and int((zeros + rice).max()) < 56:
            folded = zeros << rice | ((window << (zeros + 1).astype(np.uint64)) >> np.uint64(1) >> down).astype(np.int64)
            at = at + zeros + 1 + rice
            out[rows, i] = folded >> 1 ^ -(folded & 1)
            continue
        bits.at[rows] = at
        coded, plain = every[(order <= i) & (raw < 0)], every[(order <= i) & (raw >= 0)]
        if len(coded):
            folded = bits.unary(rows[coded]) << rice[coded] | bits.take(rice[coded], rows[coded])
            out[rows[coded], i] = folded >> 1 ^ -(folded & 1)
        if len(plain):
            out[rows[plain], i] = bits.signed(raw[plain], rows[plain])
        at = bits.at[rows]
    bits.at[rows] = at


def read_subframes(bits: Bits, block: int, depth: np.ndarray) -> np.ndarray:
    """One channel of all frames, a row each; depth is its bits a sample by frame."""
    count = len(depth)
    head = bits.take(8)
    if (head >> 7).any():
        raise FlacError("a bad subframe header")
    kind, wasted = head >> 1 & 63, head & 1
    odd = np.flatnonzero(wasted)
    wasted[odd] = 1 + bits.unary(odd)
    depth = depth - wasted
    out = np.zeros((count, block), np.int64)
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if (~(fixed | linear | (kind < 2))).any():
        raise FlacError("a reserved subframe kind")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    rows = np.flatnonzero(kind == 0)
    if len(rows):
        out[rows] = bits.signed(depth[rows], rows)[:, None]
    rows = np.flatnonzero(kind == 1)
    for i in range(block if len(rows) else 0):
        out[rows, i] = bits.signed(depth[rows], rows)
    rows = np.flatnonzero(fixed | linear)
    if not len(rows):
        return out << wasted[:, None]
    for i in range(int(order.max())):
        own = rows[order[rows] > i]
        out[own, i] = bits.signed(depth[own], own)
    own = np.flatnonzero(linear)
    weights, shift = np.zeros((count, 32), np.int64), np.zeros(count, np.int64)
    if len(own):
        precision = bits.take(4, own) + 1
        shift[own] = bits.signed(5, own)
        if (precision == 16).any() or (shift < 0).any():
            raise FlacError("bad predictor precision")
        for j in range(int(order[own].max())):
            has = order[own] > j
            weights[own[has], j] = bits.signed(precision[has], own[has])
    read_residuals(bits, rows, block, order[rows], out)
    for o in range(1, 5):
        own = np.flatnonzero(fixed & (order == o))
        if len(own):  # residuals are the o-th differences
            x = out[own]
            lead = [np.diff(x[:, :o], n=j, axis=1)[:, 0] for j in range(o)]
            x = x[:, o:]
            for j in reversed(range(o)):
                x = np.cumsum(np.concatenate([lead[j][:, None], x], axis=1), axis=1)
            # each sum restores the samples from the lead's first on
            out[own] = x if x.shape[1] == block else np.concatenate([out[own][:, : block - x.shape[1]], x], axis=1)
    own = np.flatnonzero(linear)
    if len(own):
        most = int(order[own].max())
        taps = weights[own, :most]
        for i in range(1, block):
            past = out[own, max(0, i - most) : i][:, ::-1]
            guess = (past * taps[:, : past.shape[1]]).sum(1) >> shift[own]
            out[own, i] += np.where(i >= order[own], guess, 0)
    return out << wasted[:, None]


def decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits_of_stream: np.ndarray | int = 8, channels: np.ndarray | int = 1) -> tuple[list[np.ndarray], Heads]:
    """Samples of each frame as an array (channels, block), and the headers. data has 32 zero bytes at its end."""
    heads = read_frame_heads(data, starts)
    if not heads.valid.all():
        raise FlacError(f"the header of the frame at byte {starts[np.argmin(heads.valid)]} fails its checksum")
    wrong = crc_of_ranges(data, starts, ends, 16) != 0
    if wrong.any():
        raise FlacError(f"the checksum of the frame at byte {starts[np.argmax(wrong)]} fails")
    count, depth = np.where(heads.assignment < 8, heads.assignment + 1, 2), np.where(heads.bits > 0, heads.bits, bits_of_stream)
    if (count != channels).any():
        raise FlacError("the number of channels changes")
    out: list[np.ndarray] = [np.zeros(0)] * len(starts)
    for block, many in sorted(set(zip(heads.block.tolist(), count.tolist(), strict=True))):
        rows = np.flatnonzero((heads.block == block) & (count == many))
        low, high = int(starts[rows].min()), int(ends[rows].max())
        reader = Bits(np.concatenate([data[low:high], np.zeros(16, np.uint8)]), 8 * (starts[rows] - low + heads.length[rows]))
        how = heads.assignment[rows]
        lanes = []
        for c in range(many):
            side = ((how == 8) | (how == 10)) & (c == 1) | (how == 9) & (c == 0)
            lanes.append(read_subframes(reader, block, depth[rows] + side))
        if ((reader.at + 7 >> 3) + 2 != ends[rows] - low).any():
            raise FlacError("a frame does not end where the next begins")
        if many == 2 and (how >= 8).any():
            a, b, h = lanes[0], lanes[1], how[:, None]
            mid = a << 1 | b & 1
            lanes = [np.select([h == 9, h == 10], [a + b, mid + b >> 1], a), np.select([h == 8, h == 10], [a - b, mid - b >> 1], b)]
        whole = np.stack(lanes, 1)
        for i, r in enumerate(rows.tolist()):
            out[r] = whole[i]
    return out, heads


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian signed samples, as many bytes each as the bits need: what the stream's MD5 is taken over."""
    width = bits + 7 >> 3
    return samples.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def decode(stream: bytes) -> tuple[np.ndarray, Stream]:
    """All samples (channels, samples) of one stream, with every checksum verified."""
    head = read_head(stream)
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(32, np.uint8)])
    starts = frame_starts(data, head, len(stream))
    parts: list[np.ndarray] = []
    for at in range(0, len(starts) - 1, TOGETHER):
        edge = starts[at : at + TOGETHER + 1]
        parts += decode_frames(data, edge[:-1], edge[1:], head.bits, head.channels)[0]
    samples = np.concatenate(parts, 1) if parts else np.zeros((head.channels, 0), np.int64)
    if head.samples and samples.shape[1] != head.samples:
        raise FlacError("the number of samples is not as stated")
    if head.md5 != bytes(16) and hashlib.md5(pcm_bytes(samples, head.bits)).digest() != head.md5:
        raise FlacError("the MD5 of the samples fails")
    return samples, head


def read_at(stream: bytes, first: int, count: int) -> np.ndarray:
    """Samples first to first + count, decoding only the frames that hold them."""
    head = read_head(stream)
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(32, np.uint8)])
    starts = frame_starts(data, head, len(stream))
    heads = read_frame_heads(data, starts[:-1])
    begins = np.concatenate([[0], np.cumsum(heads.block)])
    a, b = int(np.searchsorted(begins, first, "right")) - 1, int(np.searchsorted(begins, first + count, "left"))
    a, b = max(a, 0), min(b, len(starts) - 1)
    if a >= b:
        return np.zeros((head.channels, 0), np.int64)
    parts, _ = decode_frames(data, starts[a:b], starts[a + 1 : b + 1], head.bits, head.channels)
    return np.concatenate(parts, 1)[:, first - begins[a] : first - begins[a] + count]


def decode_many(streams: list[bytes]) -> list[bytes]:
    """Payloads of streams that encode wrote; frames of all of them advance together, checksums and MD5 are verified."""
    heads = [read_head(s) for s in streams]
    data = np.frombuffer(b"".join(streams) + bytes(32), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
    edges = [frame_starts(data[b : b + len(s) + 32], h, len(s)) + b for s, h, b in zip(streams, heads, base.tolist(), strict=False)]
    starts, ends = np.concatenate([e[:-1] for e in edges]), np.concatenate([e[1:] for e in edges])
    parts: list[bytes] = []
    for at in range(0, len(starts), TOGETHER):
        blocks, _ = decode_frames(data, starts[at : at + TOGETHER], ends[at : at + TOGETHER])
        parts.append(np.concatenate(blocks, 1)[0].astype(np.int8).tobytes())
    samples, out, done = b"".join(parts), [], 0
    for h in heads:
        own = samples[done : done + h.samples]
        done += h.samples
        if hashlib.md5(own).digest() != h.md5:
            raise FlacError("the MD5 of the samples fails")
        out.append(own.translate(FLIP))
    return out


# ---------------------------------------------------------------- over tables


def payload_of(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty) and bytes 255 up to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\xff")


def features(payload: bytes) -> str:
    """Mean and mean square of the samples, crossings of zero, largest step, and lag-1 products, as JSON of integers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    step = np.diff(x)
    return json.dumps({"sum": int(x.sum()), "squares": int((x * x).sum()), "crossings": int(np.count_nonzero(x[1:] * x[:-1] < 0)), "largest_step": int(np.abs(step).max()), "lag1": int((x[1:] * x[:-1]).sum())})


def chunks(texts: list[str | None], most: int = TOGETHER * BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive payloads of at most so many bytes together, one at least, with the position of the first."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        p = payload_of(t)
        if held and size + len(p) > most:
            yield first, held
            held, size, first = [], 0, i
        held.append(p)
        size += len(p)
    if held:
        yield first, held


ENCODED = "doc_id long, n_bytes long, flac binary"
PCM = "doc_id long, first_sample long, n_samples long, pcm binary"
MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def encode_texts(docs: DataFrame) -> DataFrame:
    """One FLAC stream for each row of docs: doc_id, n_bytes (of the text), flac."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for first, payloads in chunks(texts):
                rows = range(first, first + len(payloads))
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array([len((texts[i] or "").encode()) for i in rows], pa.int64()), pa.array(encode(payloads), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def pcm_blocks(media: DataFrame, frames: int = 64) -> DataFrame:
    """PCM of each stream of media(doc_id, flac) in blocks of so many frames, with the sample at which each begins.

    A null stream gives no rows; a damaged one raises FlacError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, stream in zip(batch["doc_id"].to_pylist(), batch["flac"].to_pylist(), strict=True):
                if stream is None:
                    continue
                head = read_head(stream)
                data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(32, np.uint8)])
                starts, first = frame_starts(data, head, len(stream)), 0
                for at in range(0, len(starts) - 1, frames):
                    edge = starts[at : at + frames + 1]
                    samples = np.concatenate(decode_frames(data, edge[:-1], edge[1:], head.bits, head.channels)[0], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([first], pa.int64()), pa.array([samples.shape[1]], pa.int64()), pa.array([pcm_bytes(samples, head.bits)], pa.binary())], names=["doc_id", "first_sample", "n_samples", "pcm"])
                    first += samples.shape[1]

    return media.select(F.col("doc_id").cast("long"), "flac").mapInArrow(run, PCM)


def store_and_read(docs: DataFrame) -> DataFrame:
    """Each text as a FLAC stream, decoded again from its bytes, with digests of both and features of what was read.

    A null text counts as empty and is stored as one block of bytes 255; doc_id is carried as it is; other columns are
    ignored; an empty table gives no rows. Rows are handled by themselves, in parts of bounded size; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            for first, payloads in chunks(texts):
                streams = encode(payloads)
                rows = []
                for i, (stream, back) in enumerate(zip(streams, decode_many(streams), strict=True), first):
                    rows.append((ids[i], len((texts[i] or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), features(back)))
                yield batch_of(rows, MEDIA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA)
