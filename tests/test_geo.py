"""Joins by distance against all pairs, at all latitudes and across 180 degrees."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lodeloom.functions.geo import near_pairs


def metres(a, b):
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(d / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("reach", [100.0, 700.0, 40_000.0])
def test_near_pairs_against_all_pairs(spark, reach):
    rng, spots = random.Random(4), []
    for lat, lng in ((0, 0), (38.7, -9.1), (65, 25), (-80, 10), (89.99, 40), (-89.999, 0), (0, 180), (72, -180), (60, 179.999)):
        for _ in range(30):
            y = max(-90.0, min(90.0, lat + rng.uniform(-2, 2) * reach / 111195))
            x = lng + rng.uniform(-2, 2) * reach / 111195 / max(math.cos(math.radians(y)), 1e-3)
            spots.append((y, (x + 180) % 360 - 180))
    spots.append((None, 3.0))
    rows = list(enumerate(spots))
    points = spark.createDataFrame([(i, *s) for i, s in rows], "a long, lat double, lng double")
    met = near_pairs(points, points.withColumnRenamed("a", "b"), reach)
    got = [tuple(r) for r in met.where(F.col("metres") <= reach).select("a", "b").collect()]
    want = {(i, k) for i, s in rows for k, t in rows if s[0] is not None and t[0] is not None and round(metres(s, t), 3) <= reach}
    assert len(got) == len(set(got)) and set(got) == want
    assert met.count() <= 1.05 * len(want)


@pytest.mark.parametrize("swap", [False, True])
def test_a_dense_cell_is_dealt_to_many_tasks(spark, monkeypatch, swap):
    from lodeloom.functions import geo

    monkeypatch.setattr(geo, "CELL_PAIRS", 2_000)
    rng = random.Random(1)
    spot = lambda: (38.7 + rng.uniform(0, 1e-3), -9.1 + rng.uniform(0, 1e-3))
    points = [(i, *spot()) for i in range(600)] + [(1000 + i, 10 + i * 0.1, 20.0) for i in range(50)]
    places = [(i, *spot()) for i in range(60)] + [(1000 + i, 10 + i * 0.1, 20.0) for i in range(50)]
    if swap:
        points, places = places, points
    a, b = spark.createDataFrame(points, "a long, lat double, lng double"), spark.createDataFrame(places, "b long, lat double, lng double")
    met = near_pairs(a, b, 300.0)
    rows = met.where(F.col("metres") <= 300).withColumn("task", F.spark_partition_id()).collect()
    want = {(p[0], q[0]) for p in points for q in places if round(metres(p[1:], q[1:]), 3) <= 300}
    assert len(rows) == len(want) and {(r.a, r.b) for r in rows} == want
    sizes = [sum(r.task == t for r in rows) for t in {r.task for r in rows}]
    assert len(sizes) >= 8 and max(sizes) < len(rows) / 3


def test_dismissals_lapse_with_the_day(spark, tmp_path):
    from lodeloom.operators.joins import dismiss, not_dismissed
    from lodeloom.sinks.versions import Table

    table = Table(spark, f"file://{tmp_path}/dismissed")
    bundles = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "uid long, anchor long")
    dismiss(table, bundles.where("uid = 1 and anchor = 10"), "2024-01-15")
    dismiss(table, bundles.where("uid = 1 and anchor = 10"), "2024-01-15")
    shown = lambda day: sorted(map(tuple, not_dismissed(bundles, table.read(), day).collect()))
    assert shown("2024-01-15") == [(1, 11), (2, 10)] and shown("2024-01-16") == sorted(map(tuple, bundles.collect()))
    assert table.read().count() == 1
    dismiss(table, bundles.where("uid = 2"), "2024-01-16")
    assert [tuple(r)[::2] for r in table.read().collect()] == [(2, 10)]
