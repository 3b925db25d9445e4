"""Information of binned features about clusters, against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from riskloom.plans import models as m


def information(v, cluster):
    """Of values in bins at the k-th of nine cuts, the smallest value that at least k tenths of all values don't exceed."""
    n, order = len(v), sorted(v)
    cuts = [order[-(-k * n // 10) - 1] for k in range(1, 10)]
    bins = [sum(c < x for c in cuts) for x in v]
    joint, b, c = Counter(zip(bins, cluster, strict=True)), Counter(bins), Counter(cluster)
    return sum(k / n * math.log(k * n / (b[i] * c[j])) for (i, j), k in joint.items())


def same_as_brute_force(spark, columns, cluster):
    rows = [(k, int(cluster[k]), [float(c[k]) for c in columns]) for k in range(len(cluster))]
    got = {r["f"]: r["importance"] for r in m.importance(spark.createDataFrame(rows, "key long, cluster int, x array<double>")).collect()}
    want = [information([float(x) for x in c], [int(x) for x in cluster]) for c in columns]
    assert got == {f: pytest.approx(w / max(want), abs=1e-9) for f, w in enumerate(want)}


def test_bins_have_exact_cuts(spark):
    """Approximate percentiles are a few ranks off here, which moves equal values to another bin."""
    rng, key = np.random.default_rng(11), np.arange(24_000)
    same_as_brute_force(spark, [rng.permutation(key // 6), rng.permutation(key) % 4000 * 0.37 - 5, np.where(key % 7 == 0, 0, rng.permutation(key // 6) / 7)], key % 3)


def test_bins_of_few_and_equal_values(spark):
    for n in (2, 11, 23):
        same_as_brute_force(spark, [np.arange(n) % 4, np.arange(n) * -1.5, np.full(n, 7)], np.arange(n) % 2)


def test_scores_of_labels_as_in_sql(spark, tmp_path):
    """Balances that their scaled values can't tell apart, and 6,000 suppliers in one more case."""
    duckdb = pytest.importorskip("duckdb")
    from riskloom import registry

    for name, n, balance in (("large", 60, "(s_suppkey * 7 % 60 + 1e10)"), ("many", 6000, "(s_suppkey * 37 % 1009 - 300)")):
        d, con = tmp_path / name, duckdb.connect()
        d.mkdir()
        con.execute(f"copy (select *, {balance}::double as s_acctbal from (select range as s_suppkey, (range % 25)::int as s_nationkey from range({n}))) to '{d}/supplier.parquet' (format parquet)")
        con.execute(f"copy (select (range % {n})::bigint as l_suppkey, (range * 31 % 997)::double as l_extendedprice, (range * 17 % 50)::double as l_quantity, range % 11 / 100 as l_discount, range * 13 % 9 / 100 as l_tax, if(range * 29 % 31 < 9, 'R', 'N') as l_returnflag from range({5 * n})) to '{d}/lineitem.parquet' (format parquet)")
        for t in ("supplier", "lineitem"):
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
        for query in ("m8_information_of_labels", "m9_scores_of_labels"):
            got = registry.QUERIES[query](spark, str(d))
            want = con.sql(f"select {', '.join(got.columns)} from ({registry.ORACLE_SQL[query]})").fetchall()
            assert sorted(map(tuple, got.collect())) == sorted(want), (name, query)
