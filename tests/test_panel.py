"""Hand-made cases for the panel jobs and column functions, and every SQL oracle on the smallest tables."""

from __future__ import annotations

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as c
from riskloom.operators import helpers as h, panel as p

SF = "/root/testdata/sf0.001"


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_periods(spark):
    d = dt.date
    asked = ["1980", "Q1 2020", "2020-Q4", "2020q2", "M01 2020", "1899", None, ""]
    assert column(spark, asked, "string", c.parse_period) == [d(1980, 12, 31), d(2020, 3, 1), d(2020, 12, 1), d(2020, 6, 1), d(2020, 1, 1), None, None, None]
    assert column(spark, ["M01 2020"], "string", lambda x: c.parse_period(x, monthly=False)) == [None]


def test_one_decimal_rounds_as_python_does(spark):
    rng = np.random.default_rng(3)
    asked = [0.0, 6.25, 6.75, 0.15, 0.25, 0.05, 0.35, -2.45, -0.04, 1e17, 9.95, 99.95, 2.675, *(float(x) for x in rng.integers(-4000, 4000, 400) / 20), *(float(x) for x in rng.normal(0, 1e4, 200)), *(float(x) for x in rng.normal(0, 0.05, 200))]
    assert column(spark, [*asked, None], "double", c.one_decimal) == [*(f"{x:.1f}" for x in asked), None]


def test_clean_numbers(spark):
    assert column(spark, [" 1.5 ", "", "NA", "nan", "x", None], "string", c.clean_number) == [1.5, None, None, None, None, None]


def test_rank_averages_ties(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 4.0), ("e", None)], "e string, v double").withColumn("i", F.lit("x"))
    assert {r["e"]: r["pct"] for r in p.percentile_rank(rows).collect()} == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0}


def series(spark, values, start=2000):
    rows = [("a", "x", dt.date(start + k, 12, 31), v) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "e string, i string, t date, v double")


def test_trend(spark):
    r = p.trends(series(spark, [1.0, 2.0, 3.0, 4.0])).first()
    assert (r["slope"], r["r2"], r["slope_pct"], r["trend"], r["momentum"]) == (1.0, 1.0, 40.0, "improving", None)
    assert round(r["cv_pct"], 2) == 44.72


def test_gap_fill(spark):
    r = p.fill_gaps(series(spark, [10.0, None, 14.0, None, None])).orderBy("t").collect()
    assert [round(x["v"], 9) for x in r] == [10, 12, 14, 16, 18]
    assert [round(x["confidence"], 9) for x in r] == [1, 0.8, 1, 0.8, 0.6]
    assert [x["v"] for x in p.fill_gaps(series(spark, [None, 3.0])).orderBy("t").collect()] == [3.0, 3.0]
    assert [x["confidence"] for x in p.fill_gaps(series(spark, [None, None])).collect()] == [0.0, 0.0]


def test_exponential_average(spark):
    assert [round(r["ema"], 9) for r in p.exponential_average(series(spark, [10.0, 20.0]), 4).orderBy("t").collect()] == [10, 14]


def test_latest_skips_nulls(spark):
    r = p.latest(series(spark, [1.0, 5.0, None])).first()
    assert (r["v"], r["year"]) == (5.0, 2001)


def test_scores(spark):
    one = spark.createDataFrame([(3.0, 0.5, 60.0, 40.0)], "s double, p double, a double, b double")
    assert one.select(c.hybrid(F.col("s"), F.col("p")), c.hybrid_pillars(F.col("a"), F.col("b"), F.col("p"))).first()[:] == (pytest.approx(3.25), pytest.approx(5.5))
    with pytest.raises(ValueError):
        c.hybrid_pillars(F.lit(1), F.lit(1), F.lit(1), (0.5, 0.5, 0.5))


def test_empty_panel(spark):
    none = spark.createDataFrame([], "e string, i string, t date, v double")
    for job in (p.latest, p.trends, p.anomalies, p.fill_gaps, p.crossovers, lambda x: p.exponential_average(x, 3)):
        assert job(none).count() == 0


def test_helpers():
    assert h.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    x = np.arange(9.0)
    assert np.allclose(h.smooth(x * x), x * x)
    assert np.allclose(h.spline(x, x**3 - x, np.array([0.5, 7.3, 10.0])), np.array([0.5, 7.3, 10.0]) ** 3 - np.array([0.5, 7.3, 10.0]))
    a = np.array([[1.0, np.nan], [1.0, 10.0], [np.nan, 3.0]])
    assert np.allclose(h.nan_distances(a, a)[:2, :2], 0) and np.isinf(h.nan_distances(a, a)[0, 2])


def test_nearest_fill_by_brute_force(spark):
    from riskloom.operators.neighbours import knn_fill

    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 3))
    a[rng.random(a.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(a)]
    got = {(r["key"], r["f"]): r["v"] for r in knn_fill(spark.createDataFrame(rows, "key long, a double, b double, c double"), ["a", "b", "c"], block=7).collect()}
    dist = h.nan_distances(a, a)
    for i, j in zip(*np.nonzero(np.isnan(a)), strict=True):
        donors = [k for k in range(30) if k != i and not np.isnan(a[k, j]) and np.isfinite(dist[i, k])]
        near = sorted(donors, key=lambda k: (dist[i, k], k))[:5]
        w = np.array([1 / dist[i, k] for k in near])
        assert got[i, "abc"[j]] == pytest.approx(float(w @ a[near, j] / w.sum()))


def _same(spark, con, name, query, sql):
    df = query(spark, SF)
    cols = sorted(df.columns)
    show = lambda rows: sorted(repr([repr(x) if isinstance(x, float) else str(x) for x in r]) for r in rows)
    rel = con.sql(sql)
    at = [list(rel.columns).index(x) for x in cols]
    assert show([r[x] for x in cols] for r in df.collect()) == show([r[i] for i in at] for r in rel.fetchall()), name


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    from riskloom import registry

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    for name in sorted(registry.ORACLE_SQL)[::3]:  # a third of them; the rest is compared outside the tests
        _same(spark, con, name, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_sequence_ratio_of_all_pairs(spark):
    import difflib
    import random

    from riskloom.operators import names as models

    rng = random.Random(12)
    base = ["".join(rng.choice("abcde é😀") for _ in range(rng.randint(1, 45))) for _ in range(25)]
    names = {*base, "total assets ratio", "totel assets ratio", "Total assets ratio", "the total assets ratio", "", "aaaa", "a" * 11, "a" * 9}
    for x in base:
        at = rng.randrange(len(x))
        names |= {x[:at] + "z" + x[at + 1 :], x[:at] + x[at + 1 :], "q" + x, x + " y"}
    want = {(a, b): r for a in names for b in names if a < b and (r := difflib.SequenceMatcher(None, a, b).ratio()) > 0.9}
    got = models.similar_by_ratio(spark.createDataFrame([(x,) for x in [*names, *base, None]], "n string")).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]): r["ratio"] for r in got} == want
    assert any(a.split(" ")[0] != b.split(" ")[0] for a, b in want)
    tried = models.ratio_candidates(spark.createDataFrame([(x,) for x in names], "n string"))
    assert len(want) <= tried.count() <= 6 * len(want)


def test_nearest_peers_in_blocks(spark):
    from riskloom.operators.nearest import nearest_peers

    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 1, (150, 2)), rng.normal(30, 0.1, (60, 2)), np.zeros((20, 2)), [[500.0, 500.0]]])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "key long, x double, y double")
    d = np.round(np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1]), 6)
    want = {(i, p, k + 1) for i in range(len(xy)) for k, p in enumerate([p for p in np.lexsort((np.arange(len(xy)), d[i])) if p != i][:4])}
    for block in (10, 10_000):
        assert {tuple(r) for r in nearest_peers(points, block=block).collect()} == want


def test_running_sums_do_not_depend_on_bins(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("v"), F.col("id").alias("c")).groupBy("g", "v").agg(F.sum("c").alias("c"))
    want, all_rows = {}, rows.collect()
    for r in all_rows:
        want[r["g"], r["v"]] = sum(x["c"] for x in all_rows if x["g"] == r["g"] and x["v"] < r["v"])
    for bins in (2, 7, 64):
        assert {(r["g"], r["v"]): r["before_c"] for r in p.running(rows, "v", ["c"], ["g"], bins).collect()} == want


def test_low_rank_fill_by_force(spark):
    from riskloom.plans.models import gram_fill

    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2)) @ rng.normal(size=(2, 5)) + rng.normal(size=(40, 5)) * 0.01
    x[rng.random(x.shape) < 0.15] = np.nan
    names = [f"f{k}" for k in range(5)]
    wide = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "key long, " + ", ".join(f"{n} double" for n in names))
    start = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    m = start.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(start - m, full_matrices=False)
    fit = (u[:, :2] * s[:2]) @ vt[:2] + m
    got = {(r["key"], r["f"]): r["v"] for r in gram_fill(wide, names, rank=2).collect()}
    assert set(got) == {(i, names[j]) for i, j in zip(*np.nonzero(np.isnan(x)), strict=True)}
    assert all(abs(v - fit[i, names.index(f)]) < 1e-8 for (i, f), v in got.items())


def test_hybrid_fill_keeps_real_cells_and_fills_by_steps(spark):
    from riskloom.plans.models import hybrid_fill

    rows = [(f"e{k}", i, dt.date(2000 + y, 12, 31), float(10 * k + y + j)) for k in range(4) for j, i in enumerate(("a", "b", "c")) for y in range(6) if not (k == 1 and i == "b") and not (k == 2 and y == 3)]
    got = {(r["e"], r["i"], r["t"].year): r for r in hybrid_fill(spark.createDataFrame(rows, "e string, i string, t date, v double"), ("a", "b", "c")).collect()}
    assert len(got) == 4 * 3 * 6
    for e, i, t, v in rows:
        assert (got[e, i, t.year]["v"], got[e, i, t.year]["how"], got[e, i, t.year]["confidence"]) == (v, "real", 1.0)
    assert (got["e2", "a", 2003]["v"], got["e2", "a", 2003]["how"], got["e2", "a", 2003]["confidence"]) == (23.0, "temporal", 0.8)
    assert {got["e1", "b", 2000 + y]["how"] for y in range(6)} == {"neighbours"} and got["e1", "b", 2000]["confidence"] == 0.7


def test_spline_confidence(spark):
    from riskloom.operators.panel import spline_fill

    got = spline_fill(series(spark, [1.0, 8.0, None, 64.0, 125.0, None])).orderBy("t").collect()
    assert [round(r["v"], 6) for r in got] == [1, 8, 27, 64, 125, 216]
    assert [round(r["confidence"], 6) for r in got] == [1, 1, 0.8, 1, 1, 0.8]
    assert [r["confidence"] for r in spline_fill(series(spark, [None, 3.0])).orderBy("t").collect()] == [0.1, 1.0]
    assert [(r["v"], r["confidence"]) for r in spline_fill(series(spark, [None, None])).collect()] == [(None, 0.0)] * 2


def test_folds_score_rows_they_were_not_trained_on(spark):
    from riskloom.plans import models as m

    rows = [(i, *[float(i % 7 + k) for k in range(5)], float(i % 4 == 0), 1.0) for i in range(40)]
    x = spark.createDataFrame(rows, "key long, " + ", ".join(f"{k} double" for k in m.KINDS) + ", label double, weight double")
    scored = m.cross_validated(x, rounds=2).collect()
    assert len(scored) == 40 and {r["fold"] for r in scored} == set(range(5))
    assert all(sum(r["label"] for r in scored if r["fold"] == f) == 2 for f in range(5))
    curve = m.mean_curve(spark.createDataFrame([(0, 1.0, 0.9), (0, 0.0, 0.1)], "fold int, label double, p double"))
    assert abs(m.area(curve).first()[0] - 1) < 1e-2
