"""Hard negatives for every anchor, from a full sort of the anchor's integer scores.

Rows and anchors are dealt into blocks, and a task takes one block of each. There the scores of an anchor are a row of a
matrix product, which is sorted by score and id; where a positive's range begins and ends in it is found by binary search.
The best k of each block are merged, which is exact. No task ever holds more than two blocks, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.llm.common import held

#: Every vec_id divisible by it is an anchor; where it is divisible by the other, the label is moved on by one.
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Positives of an anchor, negatives of a positive, and the range of a negative's score as hundredths of the positive's.
POSITIVES, NEGATIVES, LOWEST, HIGHEST = 5, 10, 30, 90
SCALE = 256
#: Rows of a block: as many as give PARTS blocks, between these; anchors of a block at most.
LEAST_ROWS, MOST_ROWS, PARTS, MOST_ANCHORS = 4096, 65_536, 64, 32_768
#: Scores that a task holds at a time.
SCORES = 1 << 21

FOUND = "anchor long, positive_score long, row long, score long, copies int"


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """Distinct rows that take part: row (a number of its own), vec_id, label, parts (integers), copies. Held.

    A row with a null label, a null vector, or a null or non-finite component takes no part. Components of so great a size
    that a score might not fit a long count as the greatest that do (2**28.5 for 64 components).
    """
    x = F.col("embedding")
    whole = x.isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    taken = embeddings.select("vec_id", "label", "embedding").where(whole)
    width = taken.agg(F.max(F.size("embedding"))).first()[0] or 1
    most = min(2**31 - 1, isqrt((2**63 - 1) // max(1, width)))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    parts = F.transform(x, lambda v: F.floor(F.least(F.greatest(v.cast("double") * SCALE, F.lit(float(-most))), F.lit(float(most)))).cast("int"))
    rows = taken.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), parts.alias("parts"))
    distinct = rows.groupBy("vec_id", "label", "parts").agg(F.count("*").alias("copies"))
    return held(distinct.withColumn("row", F.monotonically_increasing_id()), "negative-rows")


def matrix(parts: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of integers; where some are shorter, zeros follow."""
    parts = parts.combine_chunks()
    lengths = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> Callable[[slice], np.ndarray]:
    """Scores of some of the anchors with all rows, exactly: as floats where no sum reaches 2**53."""
    width = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :width], rows[:, :width]
    if float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width < 2**53:
        left, right = anchors.astype(np.float64), np.ascontiguousarray(rows.T, np.float64)
        return lambda some: (left[some] @ right).astype(np.int64)
    right = np.ascontiguousarray(rows.T)
    return lambda some: anchors[some] @ right


def bounds(positive_score: int, lowest: int = LOWEST, highest: int = HIGHEST) -> tuple[int, int]:
    """The least and the greatest whole score s with lowest * p <= 100 * s <= highest * p."""
    return -(-lowest * positive_score // 100), highest * positive_score // 100


def batch(found: list[tuple]) -> pa.Table:
    columns = list(zip(*found, strict=True)) if found else [()] * 5
    kinds = [pa.int64()] * 4 + [pa.int32()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FOUND.split(", ")])


def in_id_order(rows: pa.Table) -> pa.Table:
    """By vec_id, nulls last, then by row: the order that ties of scores go by."""
    return rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])


def chunks(n_anchors: int, n_rows: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, n_rows))
    for at in range(0, n_anchors, step):
        yield slice(at, min(n_anchors, at + step))


def best_positives(anchors: pa.Table, rows: pa.Table, count: int = POSITIVES) -> pa.Table:
    """Of a block's rows, the first `count` of each anchor's label by score; an anchor is not its own positive."""
    rows = in_id_order(rows)
    labels, own_labels = rows["label"].to_numpy(), anchors["label"].to_numpy()
    row, copies, names = rows["row"].to_numpy(), rows["copies"].to_numpy(), anchors["row"].to_numpy()
    vectors, own = matrix(rows["parts"]), matrix(anchors["parts"])
    found: list[tuple] = []
    for label in np.intersect1d(labels, own_labels):
        some, who = np.flatnonzero(labels == label), np.flatnonzero(own_labels == label)
        score = products(own[who], vectors[some])
        for part in chunks(len(who), len(some)):
            for anchor, scores in zip(names[who[part]].tolist(), score(part), strict=True):
                # every copy counts, so that the first `count` rows and the anchor itself are among the first count + 1
                first = np.lexsort((np.arange(len(some)), -scores))[: count + 1]
                for r, s, n in zip(row[some[first]].tolist(), scores[first].tolist(), copies[some[first]].tolist(), strict=True):
                    if n - (r == anchor):
                        found.append((anchor, None, r, s, min(count, n - (r == anchor))))
    return batch(found)


def best_negatives(anchors: pa.Table, rows: pa.Table, count: int = NEGATIVES) -> pa.Table:
    """Of a block's rows, the first `count` of other labels in the range of each of the anchors' positive scores."""
    rows = in_id_order(rows)
    labels, row, copies = rows["label"].to_numpy(), rows["row"].to_numpy(), rows["copies"].to_numpy()
    score, found = products(matrix(anchors["parts"]), matrix(rows["parts"])), []
    names, own_labels, wanted = anchors["row"].to_pylist(), anchors["label"].to_pylist(), anchors["positive_scores"].to_pylist()
    for part in chunks(len(names), len(row)):
        for anchor, label, positives, scores in zip(names[part], own_labels[part], wanted[part], score(part), strict=True):
            order = np.lexsort((np.arange(len(scores)), -scores))
            falling = -scores[order]  # ascending, as binary search wants it
            others = np.flatnonzero(labels[order] != label)
            for positive in positives:
                low, high = bounds(positive)
                if low <= high:
                    begin, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                    at = others[np.searchsorted(others, begin) :][:count]
                    at = order[at[at < end]]
                    found += zip([anchor] * len(at), [positive] * len(at), row[at].tolist(), scores[at].tolist(), np.minimum(copies[at], count).tolist(), strict=True)
    return batch(found)


def by_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, search: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """search over every pair of a block of anchors and a block of rows; the pairs are dealt to tasks of their own."""
    row_blocks = max(-(-n_rows // MOST_ROWS), min(PARTS, -(-n_rows // LEAST_ROWS)), 1)
    anchor_blocks = max(-(-n_anchors // MOST_ANCHORS), 1)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
        # an explicit number: few bytes make much work, and by bytes all blocks would be put into one task
        return placed.repartition(2 * row_blocks * anchor_blocks, "row_block", "anchor_block")

    anchors = anchors.select(*(F.col(c).alias(c) for c in anchors.columns))  # columns of their own: both sides come from one table
    left = dealt(anchors, "anchor_block", anchor_blocks, "row_block", row_blocks).groupBy("row_block", "anchor_block")
    right = dealt(rows, "row_block", row_blocks, "anchor_block", anchor_blocks).groupBy("row_block", "anchor_block")
    return left.cogroup(right).applyInArrow(lambda a, r: search(a, r) if a.num_rows and r.num_rows else batch([]), FOUND)


def first_of_each(found: DataFrame, rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    """The first `count` of each key over all blocks, by score, vec_id and row, with vec_id and rank; copies count each."""
    ids = found.join(rows.select("row", "vec_id"), "row")
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), F.col("row")]
    few = ids.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= count)
    each = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "copy"))).where(F.col("rank") <= count)


def hard_negatives(embeddings: DataFrame, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor and positive.

    anchor says which rows are anchors: a condition on vec_id. Scores are exact integers. Ties of scores go by vec_id, nulls
    last, and then by the row's number. Rows that share a vec_id are rows each: another copy of an anchor may be its
    positive, and an anchor that stands n times has its rows n times. Vectors of different lengths meet as if zeros followed
    the shorter. A positive score of zero or less leaves no range but zero itself, and none below. Other columns are
    ignored; an empty table, or one where no row may take part, gives none.
    """
    rows = usable_rows(embeddings)
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0 if anchor is None else anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    positives = by_blocks(anchors, rows, n_anchors, n_rows, best_positives)
    positives = held(first_of_each(positives, rows, ["anchor"], POSITIVES).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = positives.groupBy("anchor").agg(F.collect_set("positive_score").alias("positive_scores"))  # POSITIVES at most
    asking = anchors.join(scores.withColumnRenamed("anchor", "row"), "row")
    negatives = first_of_each(by_blocks(asking, rows, n_anchors, n_rows, best_negatives), rows, ["anchor", "positive_score"], NEGATIVES)
    negatives = negatives.select("anchor", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "copies")
    found = positives.join(negatives, ["anchor", "positive_score"]).join(names, "anchor")
    many = found.where(F.col("copies") > 1).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    every = found.where(F.col("copies") == 1).withColumn("copy", F.lit(1).cast("long")).unionByName(many)
    return every.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
