"""Latest features by name when dates are equal."""

from __future__ import annotations

import datetime as dt

import pytest

from riskloom.operators import panel as p


def test_equal_dates_go_to_the_first_row(spark):
    day, other = dt.date(2020, 5, 1), dt.date(2019, 5, 1)
    rows = [("a", "Roe x", day, 1.0, 2), ("a", "roe", day, 3.0, 3), ("a", "ROE", day, 2.0, 1), ("a", "roe", other, 9.0, 0), ("b", "roe", day, 4.0, 7), ("b", "roe", day, 5.0, 7), ("b", "roe", None, 6.0, 0), ("a", "npl", other, 7.0, 4)]
    panel = spark.createDataFrame(rows, "e string, n string, t date, v double, row long")
    for first, a in ((("row",), 2.0), ((), 3.0)):
        got = {(r["e"], r["f"]): (r["v"], r["year"]) for r in p.features_by_name(panel, {"roe": "roe", "any": "npl|roe"}, first).collect()}
        assert got == {("a", "roe"): (a, 2020), ("a", "any"): (a, 2020), ("b", "roe"): (5.0, 2020), ("b", "any"): (5.0, 2020)}


def test_features_by_name_as_in_sql(spark, tmp_path):
    """Dates repeat every 21,840 keys; rows of equal dates in key order, against it, and mixed."""
    duckdb = pytest.importorskip("duckdb")
    from riskloom import registry

    query, sql = registry.QUERIES["l3_features_by_name"], registry.ORACLE_SQL["l3_features_by_name"]
    for name, order in (("up", "p_partkey"), ("down", "p_partkey DESC"), ("mixed", "hash(p_partkey)")):
        d, con = tmp_path / name, duckdb.connect()
        d.mkdir()
        keys = "SELECT k + 21840 * j AS p_partkey FROM range(20800, 21840) a(k), range(3) b(j)"
        con.execute(f"COPY (SELECT p_partkey, 'Brand#' || p_partkey // 26 % 2 AS p_brand, 'SMALL' AS p_type, (p_partkey * 7919 % 1000)::DOUBLE AS p_retailprice FROM ({keys}) ORDER BY {order}) TO '{d}/part.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{d}/part.parquet'")
        got = query(spark, str(d))
        want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want), name
