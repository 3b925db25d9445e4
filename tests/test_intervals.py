"""Ranges against spans by brute force, and one entity with very many spans."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import checks, intervals


def test_overlaps_by_force(spark):
    rng = np.random.default_rng(1)
    spans = [(int(e), int(s), int(s + n)) for e, s, n in zip(rng.integers(0, 4, 300), rng.integers(0, 200, 300), rng.integers(0, 30, 300), strict=True)] + [(0, 10, 5), (None, 1, 2), (1, None, 3)]
    asked = [(int(e), int(a), int(a + n)) for e, a, n in zip(rng.integers(0, 6, 200), rng.integers(-10, 240, 200), rng.integers(0, 12, 200), strict=True)]
    asked += [asked[0], (None, 1, 5), (2, None, 5)]
    a = spark.createDataFrame([(*x, "kept") for x in asked], "e int, lo int, hi int, note string")
    s = spark.createDataFrame(spans, "e int, start int, end int")
    count = lambda e, lo, hi: sum(x[0] == e and None not in x and x[1] <= x[2] and x[1] <= hi and x[2] >= lo for x in spans) if None not in (e, lo, hi) else 0
    want = sorted(((*x, "kept", count(*x)) for x in asked), key=str)
    for most, cuts in ((100_000, 256), (20, 5)):
        assert sorted((tuple(r) for r in intervals.overlaps(a, s, most=most, cuts=cuts).collect()), key=str) == want


def test_one_entity_with_a_million_spans(spark):
    """Every point of the entity lies in ten thousand spans: pairs would be 2 * 10^9."""
    spans = spark.range(1_000_000).select(F.lit(1).alias("e"), F.col("id").alias("start"), (F.col("id") + 9_999).alias("end"))
    asked = spark.range(200_000).select(F.lit(1).alias("e"), (F.col("id") * 5 + 10_000).alias("lo"), (F.col("id") * 5 + 10_000).alias("hi"))
    got = intervals.overlaps(asked, spans).groupBy("n_spans").count().collect()
    assert {r["n_spans"]: r["count"] for r in got}[10_000] == sum(9_999 <= k * 5 + 10_000 < 1_000_000 for k in range(200_000))


def test_nothing_asked(spark):
    none = spark.createDataFrame([], "e int, lo int, hi int")
    assert intervals.overlaps(none, spark.createDataFrame([(1, 2, 3)], "e int, start int, end int")).count() == 0
    one = spark.createDataFrame([(1, 2, 3)], "e int, lo int, hi int")
    assert intervals.overlaps(one, spark.createDataFrame([], "e int, start int, end int")).first()["n_spans"] == 0


def test_comparison_with_few_buckets_and_sides(spark):
    cells = "key int, f string, v double"
    raw = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 4.0), (2, "b", 0.0), (3, "a", 1.0), (1, "r", 1.0), (5, "a", 2.0)], cells)
    stored = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 2.0), (2, "b", 0.0), (4, "a", 1.0), (1, "s", 1.0), (5, "b", 2.0)], cells)
    for buckets in (1, 3, 4096):
        got = {(r["key"], r["f"]): (r["pct"], r["status"]) for r in checks.compared(raw, stored, buckets).collect()}
        assert got == {(1, "a"): (0.0, "MATCH"), (1, "b"): (0.0, "BOTH_NULL"), (2, "a"): (100.0, "DIVERGE"), (2, "b"): (0.0, "MATCH"), (5, "a"): (None, "PARQUET_NULL"), (5, "b"): (None, "RAW_NULL")}
    assert {tuple(r) for r in checks.one_sided(raw, stored, "f").collect()} == {("r", "raw"), ("s", "stored")}
    assert {tuple(r) for r in checks.one_sided(raw, stored, "key").collect()} == {(3, "raw"), (4, "stored")}


def test_checks_of_little(spark):
    cells = spark.createDataFrame([(1, "a", None), (2, "a", 3.0)], "key int, f string, v double")
    assert checks.imputed_variance(cells, cells).count() == 0
    none = cells.where("false")
    assert checks.sample_size(none, none).first()["band"] == "adequate" and checks.sample_size(none, cells).first()["band"] == "critical"
    assert {r["name"]: (r["present"], r["share"]) for r in checks.required_features(cells, ["a", "z"]).collect()} == {"a": (True, 50.0), "z": (False, 50.0)}
