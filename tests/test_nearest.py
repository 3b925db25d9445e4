"""Nearest neighbours by brute force, ties and equal points among them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import nearest


def by_force(xy, k):
    d = np.round(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]), 6)
    return {(i, p, m + 1) for i in range(len(xy)) for m, p in enumerate([p for p in np.lexsort((np.arange(len(xy)), d[i])) if p != i][:k])}


def found(spark, xy, k, block):
    points = spark.createDataFrame([(i, float(a), float(b), "x") for i, (a, b) in enumerate(xy)], "key long, x double, y double, cell string").repartition(3)
    return {tuple(r) for r in nearest.nearest_peers(points, k, block).collect()}


def test_peers_by_force(spark):
    rng = np.random.default_rng(1)
    grid = np.array([(a, b) for a in range(12) for b in range(12)], float)  # many equal distances
    line = np.column_stack([np.full(80, 3.0), rng.integers(0, 30, 80)])  # one x, repeated places
    far = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(1e4, 5, (7, 2)), [[-1e6, 2e6]]])
    for xy, k, block in ((grid, 3, 9), (line, 4, 6), (far, 4, 20), (far[:3], 4, 2)):
        assert found(spark, xy, k, block) == by_force(xy, k)


def test_equal_points_meet_once(spark):
    """A third of all points in one place, all others in a second one: pairs stay linear in the points."""
    points = spark.range(30_000).select(F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, 1.0).otherwise(2.0).alias("x"), F.lit(5.0).alias("y"))
    got = nearest.nearest_peers(points, 2, 100)
    assert got.count() == 60_000
    assert {tuple(r) for r in got.where("key in (0, 3, 9)").collect()} == {(0, 3, 1), (0, 6, 2), (3, 0, 1), (3, 6, 2), (9, 0, 1), (9, 3, 2)}


def test_few_points(spark):
    none = spark.createDataFrame([], "key long, x double, y double")
    assert nearest.nearest_peers(none).count() == 0
    some = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (None, 1.0, 0.0)], "key long, x double, y double")
    assert nearest.nearest_peers(some).count() == 0
