"""Correlations over shared rows by brute force, folds by counts."""

from __future__ import annotations

import numpy as np
import pandas as pd

from riskloom.operators import gram


def test_correlations_with_gaps_by_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 7)) @ rng.normal(size=(7, 7)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 4] = np.where(np.isnan(x[:, 4]), np.nan, 5.0)
    x[:, 5] = np.nan
    want = pd.DataFrame(x).corr()
    rows = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x] + [(None,)], "x array<double>").repartition(3)
    for held in (256 << 20, 1, 5 * 8 * 7 * 3):
        got = {(r["a"], r["b"]): r for r in gram.correlations(rows, 7, held).collect()}
        assert set(got) == {(a, b) for a in range(7) for b in range(a + 1, 7)}
        for (a, b), r in got.items():
            assert r["n"] == int((~np.isnan(x[:, a]) & ~np.isnan(x[:, b])).sum())
            if np.isnan(want[a][b]):
                assert r["r"] is None
            else:
                assert abs(r["r"] - want[a][b]) < 1e-9, (a, b)


def test_no_rows(spark):
    assert gram.correlations(spark.createDataFrame([], "x array<double>"), 3).where("r is not null").count() == 0


def test_folds_take_turns_in_each_label(spark):
    from riskloom.plans.models import folded

    x = spark.range(1000).selectExpr("id as key", "cast(id % 7 = 0 as double) as label").repartition(4)
    got = folded(x, 5).groupBy("label", "fold").count().collect()
    assert len(got) == 10
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in got if r["label"] == label]
        assert max(sizes) - min(sizes) <= 1
    assert folded(x, 5).exceptAll(folded(x.repartition(2), 5)).isEmpty()
