"""Donors of gaps by brute force, and how few blocks are compared."""

from __future__ import annotations

import numpy as np

from riskloom.operators import helpers as h, neighbours


def table(spark, x):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "key long, " + ", ".join(f"{n} double" for n in names)).repartition(3), names


def by_force(x, names, k):
    d = h.nan_distances(x, x)
    np.fill_diagonal(d, np.inf)
    out = {}
    for i, j in zip(*np.nonzero(np.isnan(x)), strict=True):
        donors = [p for p in np.lexsort((np.arange(len(x)), d[i])) if not np.isnan(x[p, j]) and np.isfinite(d[i, p])][:k]
        if donors:
            out[i, names[j]] = donors
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["dist"], r["donor"])):
        out.setdefault((r["key"], r["f"]), []).append(r["donor"])
    return out


def test_donors_by_force(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 4, (150, 4)).astype(float), rng.normal(40, 1, (60, 4)), np.full((30, 4), 2.0)])
    x[rng.random(x.shape) < 0.25] = np.nan
    x[5] = np.nan
    wide, names = table(spark, x)
    for block in (10, 5000):
        assert found(neighbours.donors(wide, names, 3, block)) == by_force(x, names, 3)


def test_few_blocks_are_compared(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1000, (1, 1)) + np.repeat(rng.permutation(1500)[:, None] * 10.0, 3, axis=1) + rng.normal(size=(1500, 3))
    x[rng.random(x.shape) < 0.1] = np.nan
    wide, names = table(spark, x)
    met: list = []
    got = found(neighbours.donors(wide, names, 3, 40, met))
    assert got == by_force(x, names, 3)
    assert met[0] < met[1] / 3, met


def test_columns_without_values(spark):
    wide, names = table(spark, np.array([[1.0, np.nan], [2.0, np.nan], [np.nan, np.nan]]))
    got = {(r["key"], r["f"]): (r["v"], r["confidence"]) for r in neighbours.knn_fill(wide, names).collect()}
    assert got == {(0, "f1"): (None, 0.0), (1, "f1"): (None, 0.0), (2, "f1"): (None, 0.0), (2, "f0"): (1.5, 0.7)}
    assert neighbours.knn_fill(wide.where("false"), names).count() == 0
