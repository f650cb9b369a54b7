"""Language-model scoring: a smoothed unigram base and a log-bilinear neural model trained by noise-contrastive estimation.

Words are counted over all training documents. The neural model predicts units: the commonest words, the end of a text, and
classes of all other words by their ending; a word within a class gets its smoothed share of the class. The context of two
units is mapped to a vector by bilinear maps, and scores against all units are one matrix product, normalised exactly.
Training passes run in Spark tasks over all training documents and average their parameters.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeloom.llm.common import held, id_crc32
from lodeloom.llm.packing import slices

FOLDS, HELD_OUT = 5, 1
#: Commonest words whose counts each task holds; all others are looked up by a join.
HEAD = 131_072
#: Commonest words that are units of their own, the end of a text among them, and classes of all other words.
OWN_UNITS, CLASSES = 448, 64
UNITS = OWN_UNITS + CLASSES
WIDTH, CONTEXT = 32, 2
#: Noise words a minibatch, tokens a minibatch, passes over the training documents, and the step of Adagrad.
NOISE, BATCH, ROUNDS, RATE = 64, 2048, 1, 0.08
#: Noise units that each target is told from; the shared draw is weighted to as many.
AGAINST = 25.0
END = ""


def class_of(word: bytes) -> int:
    """Class of a word that is no unit, by its last two bytes."""
    return zlib.crc32(word[-2:]) % CLASSES


def tokens_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased words of all texts in a row, and for each its text; words are parted by ASCII white space, a null text has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, offsets = split.flatten(), split.offsets.to_numpy()
    which = np.repeat(np.arange(len(texts)), np.diff(offsets))
    real = pc.not_equal(words, "")
    return words.filter(real).dictionary_encode(), which[real.to_numpy(zero_copy_only=False)]


def count_words(docs: DataFrame) -> DataFrame:
    """word, count over all texts of docs; the word END stands for the end of a text. Counts are merged per task, before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 16_000_000):
                words, _ = tokens_of(part["text"])
                times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words.dictionary, pa.array([END])]), pa.array(np.append(times, part.num_rows))], names=["word", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task knows: totals, counts of the HEAD commonest words, units, and mass and number of words by class."""

    tokens: int
    words: int
    head: dict[str, int]
    units: list[str]
    unit_counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray

    def class_log10(self, classes: np.ndarray) -> np.ndarray:
        """log10 of what a smoothed count is divided by within its class."""
        return np.log10(self.class_tokens[classes] + 0.5 * (self.class_words[classes] + 1))


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Gather the head, at most so many words, and totals. counts must be cheap to reread.

    The head is cut where a histogram over the logarithm of counts says that it holds no more than head words.
    """
    level, so_far, least = F.floor(16 * F.log2("n")).cast("int"), 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):  # 16 rows a doubling
        if (so_far := so_far + r["count"]) > head:
            break
        least = r.level
    top = sorted(counts.where(level >= least).collect(), key=lambda r: (-r.n, r.word)) if least is not None else []
    units = [END, *(r.word for r in top if r.word != END)][:OWN_UNITS]
    ending = F.crc32(F.expr("substring(cast(word as binary), greatest(octet_length(word) - 1, 1), 2)")) % CLASSES
    by_class = counts.groupBy(F.when(~F.col("word").isin(units), ending).cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()  # CLASSES + 1 rows
    mass, number = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        if r.c is not None:
            mass[r.c], number[r.c] = r.n, r.words
    known = {r.word: r.n for r in top}
    own = np.array([known.get(u, 0) for u in units] + [0] * (OWN_UNITS - len(units)), np.float64)
    return Vocabulary(sum(r.n for r in by_class), sum(r.words for r in by_class), known, units, np.concatenate([own, mass]), mass, number)


class Units:
    """Maps a batch's distinct words to unit numbers and known counts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.number = vocabulary, {w: i for i, w in enumerate(vocabulary.units)}

    def of(self, words: list[str]) -> np.ndarray:
        number = self.number
        return np.fromiter((u if (u := number.get(w)) is not None else OWN_UNITS + zlib.crc32(w.encode()[-2:]) % CLASSES for w in words), np.int64, len(words))

    def counts(self, words: list[str]) -> np.ndarray:
        head = self.v.head
        return np.fromiter((head.get(w, 0) for w in words), np.int64, len(words))


def sequences(units: np.ndarray, which: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets with the end of each text, their contexts (the unit before and the one before that, ends standing for a start), and texts."""
    sizes = np.bincount(which, minlength=texts)
    ends = np.cumsum(sizes)
    target, text = np.insert(units, ends, 0), np.insert(which, ends, np.arange(texts))
    one, two = np.zeros_like(target), np.zeros_like(target)
    one[1:], two[2:] = target[:-1], target[:-2]
    two[1:][one[1:] == 0] = 0
    return target, np.stack([one, two]), text


@dataclass
class LogBilinear:
    """Context vectors of units (one table for each place before the target), target vectors and biases, float32."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, unit_counts: np.ndarray, seed: int = 7) -> LogBilinear:
        draw = np.random.default_rng(seed)
        share = (unit_counts + 0.5) / (unit_counts + 0.5).sum()
        return cls(draw.normal(0, 0.1, (CONTEXT, UNITS, WIDTH)).astype(np.float32), draw.normal(0, 0.1, (UNITS, WIDTH)).astype(np.float32), np.log(share).astype(np.float32))

    def pack(self) -> bytes:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.bias]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> LogBilinear:
        flat = np.frombuffer(raw, np.float32).copy()
        a, b = CONTEXT * UNITS * WIDTH, UNITS * WIDTH
        return cls(flat[:a].reshape(CONTEXT, UNITS, WIDTH), flat[a : a + b].reshape(UNITS, WIDTH), flat[a + b :])

    def vectors(self, context: np.ndarray) -> np.ndarray:
        return self.context[0][context[0]] + self.context[1][context[1]]

    def log_norms(self, context: np.ndarray) -> np.ndarray:
        """Log of the sum over all units, by batched matrix products."""
        out = np.empty(context.shape[1], np.float32)
        for at in range(0, len(out), 8192):
            scores = self.vectors(context[:, at : at + 8192]) @ self.target.T + self.bias
            top = scores.max(1)
            out[at : at + 8192] = top + np.log(np.exp(scores - top[:, None]).sum(1))
        return out


class Trainer:
    """Noise-contrastive estimation with Adagrad: each minibatch tells its targets from one shared draw of noise units."""

    def __init__(self, model: LogBilinear, unit_counts: np.ndarray, seed: int):
        self.m, self.draw = model, np.random.default_rng(seed)
        share = (unit_counts + 0.5) / (unit_counts + 0.5).sum()
        self.cumulative, self.log_noise = np.cumsum(share), np.log(AGAINST * share).astype(np.float32)
        self.squares = [np.full_like(a, 0.1) for a in (model.context, model.target, model.bias)]
        self.seen = 0

    def learn(self, target: np.ndarray, context: np.ndarray) -> None:
        order = self.draw.permutation(len(target))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.step(target[pick], context[:, pick])
        self.seen += len(target)

    def step(self, target: np.ndarray, context: np.ndarray) -> None:
        m, n = self.m, len(target)
        noise = np.searchsorted(self.cumulative, self.draw.random(NOISE)).clip(0, UNITS - 1)
        h = m.vectors(context)
        up = np.einsum("ij,ij->i", h, m.target[target]) + m.bias[target] - self.log_noise[target]
        down = h @ m.target[noise].T + (m.bias[noise] - self.log_noise[noise])
        true = SCALE / (1 + np.exp(np.clip(up, -30, 30)))  # gradients of the log-probabilities of being no noise, and of being noise
        false = (-SCALE * AGAINST / NOISE) / (1 + np.exp(-np.clip(down, -30, 30)))
        grad_target, grad_bias = np.zeros_like(m.target), np.zeros_like(m.bias)
        add_rows(grad_target, target, h * true[:, None])
        np.add.at(grad_target, noise, false.T @ h)
        grad_bias += np.bincount(target, true, UNITS).astype(np.float32)
        np.add.at(grad_bias, noise, false.sum(0))
        grad_h = m.target[target] * true[:, None] + false @ m.target[noise]
        grad_context = np.zeros_like(m.context)
        for place in range(CONTEXT):
            add_rows(grad_context[place], context[place], grad_h)
        for weights, square, grad in zip((m.context, m.target, m.bias), self.squares, (grad_context, grad_target, grad_bias), strict=True):
            grad *= np.float32(1 / n)
            square += grad * grad
            weights += np.float32(RATE) * grad / np.sqrt(square)


#: Gradients are scaled up so that Adagrad's first steps are neither lost nor wild.
SCALE = np.float32(64)


def add_rows(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """into[rows[i]] += values[i], by runs of equal rows."""
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    into[sorted_rows[starts]] += np.add.reduceat(values[order], starts, axis=0)


@functools.lru_cache(maxsize=1)
def known_norms(raw: bytes) -> tuple[LogBilinear, np.ndarray]:
    """The model and, for each context, the log of its norm, filled in as contexts occur; one a Python worker."""
    return LogBilinear.unpack(raw), np.full(UNITS * UNITS, np.nan, np.float32)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> LogBilinear:
    """Passes over all texts of docs: every task trains from the common start on its own part, and parameters are averaged by tokens.

    So the model depends on how rows are dealt to tasks, as minibatches do on their order; perplexity hardly does, as a task's
    part is long against the model. The same rows dealt alike give the same model.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((vocabulary.units, vocabulary.unit_counts))
    model = LogBilinear.start(vocabulary.unit_counts)
    texts = docs.select(F.col("text").cast("string"))
    for turn in range(rounds):
        start = sc.broadcast(model.pack())

        def learn(batches: Iterator[pa.RecordBatch], start=start, turn=turn) -> Iterator[pa.RecordBatch]:
            units, unit_counts = shared.value
            names, own = Units(Vocabulary(0, 0, {}, units, unit_counts, unit_counts, unit_counts)), LogBilinear.unpack(start.value)
            trainer = Trainer(own, unit_counts, 1000 * turn + 1)
            for batch in batches:
                for part in slices(batch, "text"):
                    words, which = tokens_of(part["text"])
                    target, context, _ = sequences(names.of(words.dictionary.to_pylist())[words.indices.to_numpy()], which, part.num_rows)
                    trainer.learn(target, context)
            if trainer.seen:
                flat = np.frombuffer(own.pack(), np.float32).astype(np.float64) * trainer.seen
                cuts = [flat[i : i + 512] for i in range(0, len(flat), 512)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([trainer.seen] * len(cuts), pa.int64()), pa.array([c.tolist() for c in cuts], pa.list_(pa.float64()))], names=["part", "n", "x"])

        sums = texts.mapInArrow(learn, "part int, n long, x array<double>")
        each = sums.select("part", "n", F.posexplode("x").alias("i", "x")).groupBy("part", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        rows = each.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x")).collect()  # as many numbers as the model has
        if rows:
            model = LogBilinear.unpack(np.concatenate([np.array(r.x, np.float32) for r in sorted(rows, key=lambda r: r.part)]).tobytes())
        start.unpersist()
    return model


TOKENS = "rid long, word string, tf long, class_log10 double, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score_texts(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Base and model log10 probability of every whole text of docs, by counts and a model from the training folds.

    Null texts count as empty and have the end only; a null doc_id is in the fold of the empty text; repeated rows are
    scored each; other columns are ignored; an empty table gives no rows, and with no training document all words are unknown.

    Words of the head are looked up in the task. Of the others one row for each text and word joins the counts; none of
    them is frequent, so that no key of that join is hot.
    """
    fold = id_crc32(F.col("doc_id")) % FOLDS == HELD_OUT
    known = held(count_words(docs.where(~fold)), "word-counts")
    v = vocabulary(known, head)
    model = train(docs.where(~fold), v)
    shared = docs.sparkSession.sparkContext.broadcast((v, model.pack()))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, raw = shared.value
        (model, norms), names = known_norms(raw), Units(v)
        total = np.log10(v.tokens + 0.5 * (v.words + 1))
        rid = TaskContext.get().partitionId() << 40
        end_count = v.head.get(END, 0)
        for batch in batches:
            for part in slices(batch, "text"):
                n, (words, which) = part.num_rows, tokens_of(part["text"])
                distinct, index = words.dictionary.to_pylist(), words.indices.to_numpy()
                unit, count = names.of(distinct), names.counts(distinct)
                target, context, text = sequences(unit[index], which, n)
                place = context[0] * UNITS + context[1]
                new = np.flatnonzero(np.bincount(place, minlength=UNITS * UNITS) * np.isnan(norms))
                norms[new] = model.log_norms(np.stack([new // UNITS, new % UNITS]))
                neural = np.empty(len(target))
                for at in range(0, len(target), 65_536):
                    cut = slice(at, at + 65_536)
                    t = target[cut]
                    neural[cut] = (model.vectors(context[:, cut]) * model.target[t]).sum(1) + model.bias[t] - norms[place[cut]]
                neural_sum = np.bincount(text, neural, n) / np.log(10)
                # counts of head words are known here; of words in classes the share within the class goes in as well
                in_class, seen = unit >= OWN_UNITS, count > 0
                logs = np.log10(count + 0.5)
                within = np.where(in_class, logs - v.class_log10(np.maximum(unit - OWN_UNITS, 0)), 0.0)
                base = np.bincount(which, np.where(seen, logs - total, 0)[index], n) + np.log10(end_count + 0.5) - total
                share = np.bincount(which, np.where(seen, within, 0)[index], n)
                tail = ~seen[index]
                pairs, tf = np.unique(which[tail] * len(distinct) + index[tail], return_counts=True)
                row, word = pairs // max(len(distinct), 1), pairs % max(len(distinct), 1)
                rids = rid + np.arange(n)
                rid += n
                empty = lambda k, kind: pa.nulls(k, kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rids, rids[row]])),
                        # a word has no space in it, so the row of a text joins nothing and lies anywhere
                        pa.concat_arrays([pa.array([f" {i}" for i in rids.tolist()]), words.dictionary.take(pa.array(word))]),
                        pa.array(np.concatenate([np.zeros(n, np.int64), tf])),
                        pa.array(np.concatenate([np.zeros(n), np.where(in_class, v.class_log10(np.maximum(unit - OWN_UNITS, 0)), np.nan)[word]])),
                        pa.concat_arrays([part["doc_id"], empty(len(tf), pa.int64())]),
                        pa.concat_arrays([part["held_out"], empty(len(tf), pa.bool_())]),
                        pa.array(np.concatenate([np.bincount(which, minlength=n) + 1, np.zeros(len(tf), np.int64)])),
                        pa.array(np.concatenate([np.bincount(which, seen[index], n).astype(np.int64) + (end_count > 0), np.zeros(len(tf), np.int64)])),
                        pa.array(np.concatenate([base, np.zeros(len(tf))])),
                        pa.array(np.concatenate([neural_sum + share, np.zeros(len(tf))])),
                    ],
                    names=[f.split()[0] for f in TOKENS.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), fold.alias("held_out")).mapInArrow(score, TOKENS)
    found = rows.join(known.withColumnRenamed("n", "c"), "word", "left")
    smoothed = F.log10(F.coalesce(F.col("c"), F.lit(0)) + F.lit(0.5))
    total = float(np.log10(v.tokens + 0.5 * (v.words + 1)))
    each = found.select(
        "rid",
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("tf") * (smoothed - F.lit(total))).alias("base"),
        (F.col("score") + F.when(F.isnan("class_log10"), 0.0).otherwise(F.col("tf") * (smoothed - F.col("class_log10")))).alias("score"),
    )  # a text's own row has tf 0 and only brings what its task knew
    scored = each.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(v.tokens).cast(T.LongType()).alias("train_tokens"), "base_score", "score")


def perplexities(scored: DataFrame) -> pd.DataFrame:
    """Per-token perplexity of base and model on held-out and on training texts; two rows."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(per("base_score").alias("base"), per("score").alias("model")).toPandas()
