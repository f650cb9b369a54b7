"""Document quality from line labels: a linear-chain conditional random field over the lines of each text.

Every line is good or bad. Its features are its own statistics and those of the lines before and after it; transitions tie
neighbouring labels. Forward-backward gives each line's marginal, and their length-weighted mean, through a logistic
curve, the document's score. Both are fitted on a bounded sample of labelled documents of the training folds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.llm.common import batch_of, held, id_crc32

#: Labelled documents that the model is fitted on at most, taken in the order of a hash of their ids.
SAMPLE = 4000
#: Documents of more lines aren't fitted on, so that what reaches the driver is bounded.
SAMPLE_LINES = 20_000
FOLDS, HELD_OUT = 3, 1
UPPER, DIGITS, SYMBOLS, STOPS = (bytes(x) for x in (range(65, 91), range(48, 58), b"#*$%&|<>", b".,;:?"))
#: Statistics of one line: share of capitals, of digits, shouts, symbols and stops a word, word length, distinct words, words seen before, length.
WIDTH = 10
#: Words of a line among which distinct ones are counted.
WINDOW = 400


def distinct_share(words: list[bytes]) -> float:
    """Share of distinct words in windows of WINDOW words, weighted by their words, so that it doesn't fall with a line's length alone."""
    return sum(len(set(words[i : i + WINDOW])) for i in range(0, len(words), WINDOW)) / len(words)


def line_statistics(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """For each line with a word its statistics (a row each) and its length in characters; a null text has no lines."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        raw = line.encode()
        words = raw.split()
        n = len(words)
        if not n:
            continue
        size = len(raw)
        grams = set(zip(words, words[1:], words[2:], strict=False))
        old = len(grams & seen)
        seen |= grams
        share = lambda drop: size - len(raw.translate(None, drop))  # noqa: B023, E731
        rows.append((
            1.0,
            (share(UPPER) / size) ** 0.5,
            (share(DIGITS) / size) ** 0.5,
            min(2.0, raw.count(b"!") / n),
            min(2.0, share(SYMBOLS) / n),
            min(1.0, share(STOPS) / n),
            min(2.0, size / n / 10),
            distinct_share(words),
            old / len(grams) if grams else 0.0,
            min(1.0, n / 100),
        ))
        lengths.append(len(line))
    return np.array(rows, np.float32).reshape(-1, WIDTH), np.array(lengths, np.float64)


def with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Own statistics, then those of the line before and after; zeros beyond the ends of a document of sizes[i] lines."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.cumsum(sizes[sizes > 0])
    before[np.concatenate([[0], ends[:-1]]) if len(ends) else []] = 0
    after[ends - 1] = 0
    return np.concatenate([x, before, after], axis=1)


class Chains:
    """Documents' lines laid out by position, so that one step of the recursion serves all documents that are long enough."""

    def __init__(self, sizes: np.ndarray):
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        alive = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # documents with more than t lines
        self.steps = [starts[order[:n]] + t for t, n in enumerate(alive.tolist())]

    def messages(self, odds: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that each line gets from those before and from those after it; stay: transition scores [from, to]."""
        ahead, behind = np.zeros_like(odds), np.zeros_like(odds)
        for now, then in zip(self.steps, self.steps[1:], strict=False):
            x = odds[now[: len(then)]] + ahead[now[: len(then)]]
            ahead[then] = np.logaddexp(x + stay[1, 1], stay[0, 1]) - np.logaddexp(x + stay[1, 0], stay[0, 0])
        for now, then in zip(reversed(self.steps[:-1]), reversed(self.steps[1:]), strict=False):
            x = odds[then] + behind[then]
            behind[now[: len(then)]] = np.logaddexp(x + stay[1, 1], stay[1, 0]) - np.logaddexp(x + stay[0, 1], stay[0, 0])
        return ahead, behind


@dataclass(frozen=True)
class Model:
    """Weights of the log-odds of a bad line, transition scores, and the logistic curve over the share of bad text."""

    weights: np.ndarray
    stay: np.ndarray
    base: float
    slope: float

    def bad_lines(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Marginal probability that each line is bad."""
        odds = x @ self.weights
        ahead, behind = Chains(sizes).messages(odds, self.stay)
        return 1 / (1 + np.exp(-np.clip(odds + ahead + behind, -50, 50)))

    def scores(self, bad: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base - self.slope * bad, -50, 50)))


def bad_share(bad: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals by document; a document without lines counts as all bad."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    weight = np.bincount(which, lengths, len(sizes))
    return np.where(weight > 0, np.bincount(which, lengths * bad, len(sizes)) / np.maximum(weight, 1e-9), 1.0)


def adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit(statistics: list[np.ndarray], lengths: list[np.ndarray], quality: np.ndarray, penalty: float = 1e-4) -> Model:
    """Fit on documents with quality 1 or 0. Lines first take their document's label; lines of bad documents that then look good to a
    model without neighbours are relabelled, and the chain is trained on the result. With one class only, scores are constant."""
    sizes = np.array([len(s) for s in statistics], np.int64)
    if not len(quality) or quality.min() == quality.max() or not sizes.sum():
        share = float(quality.mean()) if len(quality) else 0.5
        return Model(np.zeros(3 * WIDTH), np.zeros((2, 2)), float(np.log((share + 1e-3) / (1 - share + 1e-3))), 0.0)
    x = with_neighbours(np.concatenate(statistics), sizes).astype(np.float64)
    weight = np.concatenate(lengths)
    n, which = len(x), np.repeat(np.arange(len(sizes)), sizes)
    label = 1.0 - quality[which]
    own = x[:, :WIDTH]
    first = adam(lambda w: own.T @ (1 / (1 + np.exp(-np.clip(own @ w, -50, 50))) - label) / n + penalty * w, np.zeros(WIDTH), 300, 0.1)
    good = (1 / (1 + np.exp(-np.clip(own @ first, -50, 50)))) < 0.1
    worst = np.bincount(which, (label > 0) & ~good, len(sizes))[which] > 0
    label = np.where(worst & good, 0.0, label)

    chains, inner = Chains(sizes), np.ones(n, bool)
    inner[np.cumsum(sizes[sizes > 0]) - 1] = False
    left = np.flatnonzero(inner)  # lines with a next one
    seen = np.array([[(1 - label[left]) @ (1 - label[left + 1]), (1 - label[left]) @ label[left + 1]], [label[left] @ (1 - label[left + 1]), label[left] @ label[left + 1]]])

    def gradient(v: np.ndarray) -> np.ndarray:
        w, stay = v[:-4], v[-4:].reshape(2, 2)
        odds = x @ w
        ahead, behind = chains.messages(odds, stay)
        bad = 1 / (1 + np.exp(-np.clip(odds + ahead + behind, -50, 50)))
        before, after = odds[left] + ahead[left], odds[left + 1] + behind[left + 1]
        joint = np.stack([np.full(len(left), stay[0, 0]), after + stay[0, 1], before + stay[1, 0], before + after + stay[1, 1]])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        return np.concatenate([x.T @ (bad - label), (joint.sum(1) - seen.ravel())]) / n + penalty * v

    v = adam(gradient, np.zeros(3 * WIDTH + 4), 250, 0.08)
    model = Model(v[:-4], v[-4:].reshape(2, 2), 0.0, 0.0)
    share = bad_share(model.bad_lines(x, sizes), weight, sizes)
    curve = adam(lambda c: np.array([(g := 1 / (1 + np.exp(-np.clip(c[0] - c[1] * share, -50, 50))) - quality).mean(), (-share * g).mean()]) + 1e-4 * c, np.array([2.0, 4.0]), 600, 0.1)
    return Model(model.weights, model.stay, float(curve[0]), float(curve[1]))


SAMPLED = "doc_id long, quality int, n_lines int, statistics binary, lengths binary"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """Fit on at most sample labelled documents of the training folds, of at most sample_lines lines each.

    Rows of labels without id or quality are ignored, and an id with two qualities counts as bad. Of several texts under
    one id the one of least MD5 is taken. Only the sample's line statistics reach the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_crc32(F.col("doc_id")) % FOLDS != HELD_OUT))
    chosen = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # chosen has at most sample rows
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(held(chosen, "crf-sample")), "doc_id")
    one = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text"))["text"].alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, quality in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "quality")), strict=True):
                s, n = line_statistics(text)
                rows.append((doc_id, quality, len(n), s.tobytes(), n.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=[f.split()[0] for f in SAMPLED.split(", ")])

    rows = sorted((r.doc_id, bytes(r.lengths), bytes(r.statistics), r.quality) for r in one.mapInArrow(measure, SAMPLED).where(F.col("n_lines") <= sample_lines).collect())
    statistics = [np.frombuffer(s, np.float32).reshape(-1, WIDTH) for _, _, s, _ in rows]
    return fit(statistics, [np.frombuffer(n, np.float64) for _, n, _, _ in rows], np.array([q for *_, q in rows], np.float64))


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_share double"


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score every row of docs from its text alone: score, predicted, lines, and the share of text in bad lines.

    A null or empty text has no lines and counts as all bad; a null doc_id is in the fold of the empty text; repeated rows
    are scored each; other columns are ignored; with no usable labels all scores are 0.5; an empty table gives no rows.
    """
    model = train(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                measured = [line_statistics(t) for t in part["text"].to_pylist()]
                sizes = np.array([len(n) for _, n in measured], np.int64)
                lengths = np.concatenate([n for _, n in measured])
                x = with_neighbours(np.concatenate([s for s, _ in measured]), sizes)
                share = bad_share(model.bad_lines(x.astype(np.float64), sizes), lengths, sizes)
                scores = model.scores(share)
                yield batch_of(list(zip(part["doc_id"].to_pylist(), part["held_out"].to_pylist(), scores.tolist(), (scores >= 0.5).astype(int).tolist(), sizes.tolist(), share.tolist(), strict=True)), SCORED)

    held_out = (id_crc32(F.col("doc_id")) % FOLDS == HELD_OUT).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out).mapInArrow(score, SCORED)
