"""Order and recurrences without one-task groups: exact quantiles, exponential averages, smoothing and splines of long series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import helpers as h, long_series as ls, quantiles as q

PANEL = "e string, i string, t date, v double"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_quantiles_by_levels_of_bins(spark):
    rng = np.random.default_rng(1)
    groups = {"a": rng.normal(size=4001), "b": rng.integers(0, 5, 3000).astype(float), "c": np.array([2.5]), "d": rng.lognormal(0, 9, 1500)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), (None, 1.0), ("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"lo": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "hi": 1.0}
    for most, cuts in ((100_000, 256), (40, 7)):
        got = {r["g"]: r for r in q.quantiles(df, "v", shares, ["g"], most, cuts).collect()}
        assert set(got) == set(groups)
        for g, values in groups.items():
            for name, share in shares.items():
                assert got[g][name] == pytest.approx(float(np.quantile(values, share)), rel=1e-12), (g, name)


def test_quantiles_without_groups_or_values(spark):
    none = spark.createDataFrame([], "v double")
    assert q.quantiles(none, "v", {"m": 0.5}).collect()[0]["m"] is None
    assert q.quantiles(none.withColumn("g", F.lit(1)), "v", {"m": 0.5}, ["g"]).count() == 0
    wide = spark.createDataFrame([(1.0, None), (4.0, None)], "a double, b double")
    assert q.column_medians(wide, ["a", "b"]).first()[:] == (2.5, None)
    assert "percentile(" not in plan(q.column_medians(wide, ["a", "b"]))


def test_running_sums_over_levels(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 37) % 701).cast("double").alias("v"), F.col("id").alias("c")).groupBy("g", "v").agg(F.sum("c").alias("c"))
    want = pd.DataFrame([r.asDict() for r in rows.collect()]).sort_values(["g", "v"])
    want["before"] = want.groupby("g")["c"].cumsum() - want["c"]
    for most, cuts in ((10, 4), (50, 10), (10_000, 4)):
        got = pd.DataFrame([r.asDict() for r in q.running(rows, "v", ["c"], ["g"], most, cuts).collect()]).sort_values(["g", "v"])
        assert list(got["before_c"]) == list(want["before"]) and set(got["all_c"]) == set(want.groupby("g")["c"].sum())


def panel(spark, series: dict[tuple[str, str], np.ndarray], gaps=None):
    frames = []
    for (e, i), v in series.items():
        t = pd.date_range("1700-01-01", periods=len(v), freq="MS" if gaps else "D").date
        frames.append(pd.DataFrame({"e": e, "i": i, "t": t, "v": v}))
    return spark.createDataFrame(pd.concat(frames).replace({np.nan: None}), PANEL).repartition(7)


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def series_of(rng, *lengths):
    return {("e", f"s{k:02d}"): rng.normal(size=n).cumsum() for k, n in enumerate(lengths)}


@pytest.mark.parametrize("adjusted", [False, True])
def test_exponential_average_over_partitions(spark, many_parts, adjusted):
    data = series_of(np.random.default_rng(2), 60_000, 1, 2, 500, 20_000)
    df = ls.exponential_average(panel(spark, data), 9, adjusted)
    assert "FlatMapGroups" not in plan(df)
    got = df.toPandas().sort_values(["i", "t"])
    for (_, i), v in data.items():
        assert np.allclose(got[got["i"] == i]["ema"], pd.Series(v).ewm(span=9, adjust=adjusted).mean(), atol=1e-9)


def test_exponential_average_spreads_a_long_series(spark, many_parts):
    data = series_of(np.random.default_rng(3), 50_000)
    assert ls.placed(panel(spark, data)).groupBy("part").count().count() >= 8


def test_smoothing_in_blocks(spark, many_parts):
    data = series_of(np.random.default_rng(4), *range(1, 12), 300)
    got = ls.smoothed(panel(spark, data), block=10).toPandas().sort_values(["i", "t"])
    for (_, i), v in data.items():
        assert np.allclose(got[got["i"] == i]["smooth"], h.smooth(v)), len(v)


def test_splines_in_blocks(spark, many_parts):
    rng = np.random.default_rng(5)
    data = series_of(rng, 1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 40, 150)
    for k, v in enumerate(data.values()):
        if len(v) > 5:
            v[rng.random(len(v)) < 0.3] = np.nan
            if k % 2:
                v[:2] = v[-3:] = np.nan
    data[("e", "none")] = np.full(5, np.nan)
    for block in (3, 4096):
        got = ls.spline_fill(panel(spark, data, gaps=True), block).toPandas().sort_values(["i", "t"])
        for (_, i), v in data.items():
            own = got[got["i"] == i]
            t = pd.date_range("1700-01-01", periods=len(v), freq="MS")
            u = (t.year + t.month / 12).to_numpy()
            have = ~np.isnan(v)
            if not have.any():
                assert own["v"].isna().all() and set(own["confidence"]) == {0.0}
                continue
            want = np.where(have, v, h.spline(u[have], v[have], u)) if have.sum() > 1 else np.full(len(v), v[have][0])
            near = np.abs(u[:, None] - u[have][None, :]).min(axis=1)
            sure = np.where(have, 1.0, np.maximum(0.1, 1 - near / 5) if have.sum() > 1 else 0.1)
            assert np.allclose(own["v"].astype(float), want, atol=1e-7), (i, block)
            assert np.allclose(own["confidence"], sure)


def test_nothing_in_nothing_out(spark):
    none = spark.createDataFrame([], PANEL)
    assert ls.smoothed(none).count() == ls.spline_fill(none).count() == ls.exponential_average(none, 3).count() == 0
    one = spark.createDataFrame([("a", "x", dt.date(2000, 1, 1), None), (None, "x", dt.date(2000, 1, 1), 1.0), ("a", "x", None, 1.0)], PANEL)
    assert ls.smoothed(one).count() == ls.exponential_average(one, 3).count() == 0 and ls.spline_fill(one).count() == 1
