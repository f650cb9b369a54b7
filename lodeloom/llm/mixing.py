"""An adaptive context-mixing range coder for token ids, over many independent blocks at once.

Every block begins with the same model and knows nothing of the others, so any of them can be decoded alone. Blocks stand
side by side in numpy arrays, one lane each, and take their n-th step together; encoder and decoder share the model.

For each id the model has three predictions. Order 2 and order 1 name the id that last followed the two ids and the one id
before, with a confidence that grows with each success. Order 0 is the block's own frequencies. Whether the id is the one
that order 2 names, and if not, the one that order 1 names, is predicted by mixing what all three orders say of that id in
the logistic domain, with weights that each block learns. Any other id is coded by order 0, high byte and then low byte.
All arithmetic is on integers, so that files written on one machine can be read on any other.
"""

from __future__ import annotations

import functools
from decimal import Decimal, localcontext

import numpy as np

#: Ids of a block at most, and lanes that run together.
BLOCK, LANES = 2048, 2048
#: Slots of the tables of order 1 and 2, as powers of two.
BITS_1, BITS_2 = 10, 11
#: Low bytes have tables of their own for so many high bytes; all higher ones share the last.
GROUPS = 16
#: Scale of probabilities, and what a frequency of order 0 grows by; a block's total stays below 1 << 16.
ONE, GROWTH = 1 << 16, 12
#: Share of ONE that an id named by order 1 has at least.
LEAST = 16
#: How far weights move at an error, and the shift that probabilities follow outcomes by.
STEP, FOLLOW = 14, 4


@functools.cache
def logistic() -> tuple[np.ndarray, np.ndarray]:
    """stretch: ln(p / (1 - p)) in 256ths for p in 4096ths; squash: its inverse from -2047..2047, to 65536ths."""
    with localcontext() as c:
        c.prec = 30
        odds = [(Decimal(2 * p + 1) / Decimal(8191 - 2 * p)).ln() * 256 for p in range(4096)]
        stretch = np.array([max(-2047, min(2047, int(x.to_integral_value()))) for x in odds], np.int32)
        squash = np.array([int((ONE / (1 + (Decimal(-x) / 256).exp())).to_integral_value()) for x in range(-2047, 2048)], np.int32)
    return stretch, np.clip(squash, 32, ONE - 1024)


def opening() -> np.ndarray:
    """Probabilities at the start of a block, by (decision, order 2, 1 and 0, context).

    A prediction of confidence c holds with (c + 1) / (c + 3); what the other order and the counts say is less sure.
    """
    first = np.empty((2, 3, 16), np.int32)
    c = np.arange(16)
    first[:, 0] = ONE * (c + 1) // (c + 3)
    first[0, 1] = np.where(c < 8, ONE * (c + 2) // (c + 4), ONE // 3)
    first[1, 1] = ONE // 3
    first[:, 2] = ONE * (c + 1) // (c + 24)
    return first


#: BEFORE adds up what comes before each of 16 places when a row is multiplied by it.
BEFORE = np.triu(np.ones((16, 16), np.float32), 1)


class Model:
    """What each lane's block has taught so far. Row 0 of pairs is order 2, row 1 is order 1."""

    def __init__(self, lanes: int):
        self.lanes, self.at = lanes, np.arange(lanes)
        self.stretch, self.squash = logistic()
        self.follow = np.zeros((lanes << BITS_2) + (lanes << BITS_1), np.int64)  # id * 16 + confidence
        self.bases = np.stack([self.at << BITS_2, (lanes << BITS_2) + (self.at << BITS_1)])
        self.known = np.repeat(opening().reshape(-1, 1), lanes, 1).reshape(-1)
        self.known_base = (np.arange(6).reshape(2, 3, 1) * 16 * lanes) + self.at
        self.weights = np.full((2, 3, lanes), ONE * 2 // 5, np.int32)
        # order 0: for the high byte and for each group of low bytes, 16 sums and 256 frequencies; low ids are commoner
        prior = 1 + 1024 // (np.arange(256) + 1)
        self.tables = GROUPS + 1
        top = self.at * self.tables
        counts, sums = np.ones((lanes * self.tables, 256), np.float32), np.full((lanes * self.tables, 16), 16, np.float32)
        self.totals = np.full(lanes * self.tables, 256, np.int64)
        counts[top], sums[top], self.totals[top] = prior, prior.reshape(16, 16).sum(1), prior.sum()
        self.counts, self.rows, self.sums, self.sum_rows = counts.reshape(-1), counts.reshape(-1, 16), sums.reshape(-1), sums
        self.low_base = (self.at * self.tables + 1) << 8
        self.last1, self.last2, self.steps = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), 0

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """For each lane, frequencies of 65536 for the id that order 2 names and the one that order 1 names."""
        lanes, last = self.lanes, self.last1 * 40503
        slots = np.empty((2, lanes), np.int64)
        slots[0], slots[1] = (last + self.last2 * 60493 >> 5) & ((1 << BITS_2) - 1), (last >> 4) & ((1 << BITS_1) - 1)
        slots += self.bases
        held = self.follow.take(slots)
        self.slots, self.sure, self.named = slots, held & 15, held >> 4
        sure2, sure1 = self.sure
        names_any = self.sure > 0
        same = (self.named[0] == self.named[1]) & names_any[1]
        context = np.empty((2, 3, lanes), np.int64)
        context[:, 0], context[1, 1] = self.sure, sure2
        context[0, 1] = np.where(same, np.minimum(sure1, 7), 8 + (sure1 >> 1))
        leaf = (np.minimum(self.named >> 8, GROUPS - 1) << 8) + (self.named & 255) + self.low_base
        context[:, 2] = np.minimum(self.counts.take(leaf) * np.float32(1 / GROWTH), 15)
        context *= lanes
        context += self.known_base
        self.where = context
        self.said = self.known.take(context)
        self.stretched = self.stretch.take(self.said >> 4)
        mixed = (self.weights * self.stretched) >> 16
        mixed = mixed[:, 0] + mixed[:, 1] + mixed[:, 2]
        self.mixed = self.squash.take(np.minimum(np.maximum(mixed, -2047), 2047) + 2047)
        self.asks = names_any
        self.asks[1] &= ~(same & names_any[0])
        f2 = self.mixed[0] * self.asks[0]
        # never nothing, however sure order 2 is and unlikely order 1: its id may come all the same
        f1 = np.maximum((ONE - f2).astype(np.int64) * self.mixed[1] >> 16, LEAST) * self.asks[1]
        return f2.astype(np.int64), f1

    def learn(self, ids: np.ndarray, which: np.ndarray) -> None:
        """Take the ids in; which is 0 where order 2 named it, 1 where order 1 did, 2 elsewhere."""
        hit = np.stack([which == 0, which == 1])
        asked = self.asks
        asked[1] &= ~hit[0]
        goal = hit.astype(np.int32) << 16
        error = (goal - self.mixed) * asked * STEP >> 4
        self.weights += (self.stretched * error[:, None]) >> 16
        self.steps += 1
        if self.steps % 16 == 0:
            np.clip(self.weights, -4 * ONE, 4 * ONE, out=self.weights)
        self.known[self.where] = self.said + ((goal[:, None] - self.said) * asked[:, None] >> FOLLOW)
        sure = self.sure
        right = (self.named == ids) & (sure > 0)
        keep = right | (sure > 1)
        after = np.where(right, np.minimum(sure + 1, 15), np.where(keep, sure >> 1, 1))
        self.follow[self.slots] = (np.where(keep, self.named, ids) << 4) + after
        self.last2, self.last1 = self.last1, ids

    def low_table(self, lanes: np.ndarray, high: np.ndarray) -> np.ndarray:
        return lanes * self.tables + 1 + np.minimum(high, GROUPS - 1)

    def span(self, table: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each byte's share of its table's total begins, and its length; then the byte is counted."""
        coarse = byte >> 4
        place = (table << 4) + coarse
        begin = np.einsum("ij,ij->i", self.sum_rows.take(table, 0), BEFORE.T.take(coarse, 0))
        begin += np.einsum("ij,ij->i", self.rows.take(place, 0), BEFORE.T.take(byte & 15, 0))
        leaf = (table << 8) + byte
        own = self.counts.take(leaf)
        self.count(table, place, leaf, own)
        return begin.astype(np.int64), own.astype(np.int64)

    def find(self, table: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The byte whose share of the total holds each value, where it begins, and its length; then the byte is counted."""
        value, at = value.astype(np.float32), np.arange(len(table)) << 4
        sums = self.sum_rows.take(table, 0) @ BEFORE
        coarse = held_by(sums, value)
        begin = sums.reshape(-1).take(at + coarse)
        place = (table << 4) + coarse
        fine = self.rows.take(place, 0) @ BEFORE
        low = held_by(fine, value - begin)
        begin += fine.reshape(-1).take(at + low)
        leaf = (place << 4) + low
        own = self.counts.take(leaf)
        self.count(table, place, leaf, own)
        return (coarse << 4) + low, begin.astype(np.int64), own.astype(np.int64)

    def count(self, table: np.ndarray, place: np.ndarray, leaf: np.ndarray, own: np.ndarray) -> None:
        self.counts[leaf] = own + GROWTH
        self.sums[place] += GROWTH
        self.totals[table] += GROWTH


def held_by(begins: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The last of 16 places in each row that begins at or before the value. Whole numbers below 1 << 24, exact as floats."""
    reached = np.bitwise_count((begins <= value[:, None]).view(np.uint64))
    return (reached[:, 0] + reached[:, 1]).astype(np.int64) - 1


def _share(range_: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A little less than range_ / total; both are far below 2**53, so the quotient is off by less than one."""
    return (range_ / total).astype(np.int64) - 1


def _encode(ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """ids: (lane, step), padded; lengths fall from lane to lane."""
    lanes = len(lengths)
    model = Model(lanes)
    width = int(lengths[0]) * 3 + 8
    out = np.zeros(lanes * width, np.uint32)
    low, size, put = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64), np.arange(lanes) * width + 1

    def narrow(at: np.ndarray | slice, low_: np.ndarray, size_: np.ndarray) -> None:
        """Take the interval over, add a carry to the word before, and write 16 bits where 32 or fewer are left."""
        place = put[at]
        out[place - 1] += (low_ >> 48).astype(np.uint32)
        low_ &= (1 << 48) - 1
        out[place] = low_ >> 32
        shift = (size_ < 1 << 32) * 16
        put[at] = place + (shift >> 4)
        low[at], size[at] = (low_ << shift) & ((1 << 48) - 1), size_ << shift

    ended = lanes - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) + 1), "right")  # lanes with a step n
    steps = np.ascontiguousarray(ids.T).astype(np.int64)
    for n, step in enumerate(steps):
        live = int(ended[n])
        f2, f1 = model.predict()
        right = (model.named == step) & model.asks
        which = np.where(right[0], 0, np.where(right[1], 1, 2))
        r = size >> 16
        begin, length = np.where(which == 0, 0, np.where(which == 1, f2, f2 + f1)), np.where(which == 0, f2, np.where(which == 1, f1, ONE - f2 - f1))
        narrow(slice(0, live), (low + r * begin)[:live], (r * length)[:live])
        model.learn(step, which)
        rest = np.flatnonzero(which[:live] == 2)
        if len(rest):
            high = step[rest] >> 8
            for table, byte in ((rest * model.tables, high), (model.low_table(rest, high), step[rest] & 255)):
                r = _share(size[rest], model.totals.take(table))
                begin, length = model.span(table, byte)
                narrow(rest, low[rest] + r * begin, r * length)
    for _ in range(3):  # the rest of low
        out[put - 1] += (low >> 48).astype(np.uint32)
        low &= (1 << 48) - 1
        out[put] = low >> 32
        put += 1
        low = (low << 16) & ((1 << 48) - 1)
    out = out.reshape(lanes, width)
    for at in range(width - 1, 0, -1):  # carries that had to wait
        out[:, at - 1] += out[:, at] >> 16
    out &= 0xFFFF
    ends = put - np.arange(lanes) * width
    return [out[i, 1:e].astype("<u2").tobytes() for i, e in enumerate(ends.tolist())]


def _decode(words: list[bytes], lengths: np.ndarray) -> np.ndarray:
    lanes = len(lengths)
    model = Model(lanes)
    width = max(map(len, words)) // 2 + 4
    data = np.zeros((lanes, width), np.int64)
    for i, w in enumerate(words):
        data[i, : len(w) // 2] = np.frombuffer(w, "<u2")
    data, got = data.reshape(-1), np.zeros((int(lengths[0]), lanes), np.int64)
    at0 = np.arange(lanes) * width
    code, size, take, end = (data[at0] << 32) | (data[at0 + 1] << 16) | data[at0 + 2], np.full(lanes, 1 << 48, np.int64), at0 + 3, at0 + width - 1

    def narrow(at: np.ndarray | slice, code_: np.ndarray, size_: np.ndarray) -> None:
        short = size_ < 1 << 32
        shift, place = short * 16, take[at]
        code[at], size[at] = (code_ << shift) | (data[place] * short), size_ << shift
        take[at] = np.minimum(place + short, end[at])

    ended = lanes - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) + 1), "right")
    for n in range(int(lengths[0])):
        live = int(ended[n])
        f2, f1 = model.predict()
        r = size >> 16
        bound2 = r * f2
        bound1 = bound2 + r * f1
        which = (code >= bound2).astype(np.int64) + (code >= bound1)
        begin, length = np.where(which == 0, 0, np.where(which == 1, bound2, bound1)), np.where(which == 0, bound2, np.where(which == 1, r * f1, r * (ONE - f2 - f1)))
        narrow(slice(0, live), (code - begin)[:live], length[:live])
        ids = np.where(which == 0, model.named[0], model.named[1])
        rest = np.flatnonzero(which[:live] == 2)
        if len(rest):
            high, table = None, rest * model.tables
            for _ in range(2):
                total = model.totals.take(table)
                r = _share(size[rest], total)
                byte, begin, length = model.find(table, np.minimum(code[rest] // r, total - 1))
                narrow(rest, code[rest] - r * begin, r * length)
                if high is None:
                    high, table = byte, model.low_table(rest, byte)
            ids[rest] = high * 256 + byte
        model.learn(ids, which)
        got[n] = ids
    return got.T


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """The ids, all below 65536, cut into blocks of so many, each coded by itself."""
    if block > BLOCK:
        raise ValueError(f"a block has at most {BLOCK} ids")
    if len(ids) and int(ids.max()) >= ONE:
        raise ValueError("ids must be below 65536")
    out: list[bytes] = []
    for start in range(0, len(ids), block * LANES):
        part = ids[start : start + block * LANES]
        lengths = np.full(-(-len(part) // block), block)
        lengths[-1] = len(part) - block * (len(lengths) - 1)
        padded = np.zeros((len(lengths), int(lengths[0])), np.int64)
        padded.reshape(-1)[: len(part)] = part
        out += _encode(padded, lengths)
    return out


def decode_blocks(blocks: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of each block, of which lengths says how many there are; any blocks, in any order."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    order = np.argsort(-np.asarray(lengths), kind="stable")
    for start in range(0, len(order), LANES):
        some = order[start : start + LANES]
        got = _decode([blocks[i] for i in some], np.asarray(lengths)[some])
        for i, row in zip(some.tolist(), got, strict=True):
            out[i] = row[: lengths[i]].astype(np.uint32)
    return out
