from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from lodeloom.llm import negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int, row long, copies int, parts string"


def brute(rows) -> Counter:
    """Rows of (vec_id, embedding, label), one anchor and one score at a time."""
    taking = []
    for vec_id, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            # as engines have it, a remainder takes the sign of what is divided
            moved = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
            taking.append((vec_id, moved, [math.floor(256 * float(np.float32(v))) for v in x]))
    out = Counter()
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for i, (vec_id, label, x) in enumerate(taking):
        if vec_id is None or vec_id % 100:
            continue
        scored = sorted(((sum(a * b for a, b in zip(x, y, strict=False)), other, l2) for j, (other, l2, y) in enumerate(taking) if j != i), key=order)
        for score, positive, _ in [s for s in scored if s[2] == label][:5]:
            found = [s for s in scored if s[2] != label and 30 * score <= 100 * s[0] <= 90 * score][:10]
            out.update((vec_id, positive, k, n[1], score, n[0]) for k, n in enumerate(found, 1))
    return out


def test_matches_brute_force_and_sql(spark, sf, duck):
    from lodeloom.llm import queries

    got = Counter(map(tuple, queries.op12_hard_negatives(spark, sf).collect()))
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == brute(rows) and len(got) > 20
    assert got == Counter(duck.execute(queries.oracle_sql()["op12_hard_negatives"]).fetchall())


def some_rows(n: int, seed: int, values: int = 3) -> list[tuple]:
    """Few distinct values, so that scores tie."""
    rng = np.random.default_rng(seed)
    return [(int(i * 50), [float(v) for v in rng.integers(-1, values, 6) / 4], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("least,most_anchors,scores", [(7, 3, 5), (50, 1000, 1 << 20)])
def test_blocks_and_ties(spark, monkeypatch, least, most_anchors, scores):
    monkeypatch.setattr(m, "LEAST_ROWS", least)
    monkeypatch.setattr(m, "MOST_ANCHORS", most_anchors)
    monkeypatch.setattr(m, "SCORES", scores)
    rows = some_rows(120, 5)
    got = m.hard_negatives(spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(rows) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = some_rows(30, 9) + [(0, None, 1), (100, [1.0, None], 1), (200, [nan] * 6, 1), (300, [inf] * 6, 1), (400, [0.5] * 6, None), (None, [0.75] * 6, 1), (500, [], 1), (600, [0.5], 2), (-700, [0.25] * 9, -5), (800, [1.0e4] * 6, 2)]
    rows += [(1000, [0.5] * 6, 1)] * 3 + [(41, [0.5] * 6, 1)] * 12 + [(43, [0.35] * 6, 2)] * 14 + [(1000, [0.25] * 6, 0)]
    got = m.hard_negatives(spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    assert m.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert m.hard_negatives(spark.createDataFrame([(0, None, 1, 1, 1, "x")], SCHEMA)).count() == 0


def test_scores_beyond_floats_and_great_components(spark):
    rows = [(100, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [2e5, 0.00390625], 2), (3, [2e5, 0.0078125], 2), (4, [2.5e5, 7.0], 3)]
    got = Counter(map(tuple, m.hard_negatives(spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA)).collect()))
    assert got == brute(rows) and max(r[5] for r in got) > 2**51
    huge = spark.createDataFrame([(0, [3e38], 1, 1, 1, "x"), (1, [3e38], 1, 1, 1, "x")], SCHEMA)
    assert m.hard_negatives(huge).count() == 0  # components are limited, so scores fit a long


def test_bounds():
    for p in [*range(-300, 300), 2**62, -(2**62)]:
        low, high = m.bounds(p)
        for s in {low - 1, low, high, high + 1, p * 3 // 10, p * 9 // 10}:
            assert (low <= s <= high) == (30 * p <= 100 * s <= 90 * p)
