"""Pairwise-complete correlations of many columns with gaps, from masked sums of products."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bytes of sums that a task holds; wider tables are passed over once for each stripe of columns that fits.
HELD = 256 << 20


def as_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(x).cast("double") for x in columns])


def correlations(rows: DataFrame, width: int, held: int = HELD) -> DataFrame:
    """a, b (places of columns, a < b), n (rows that have both), r, of rows (x: array<double> of `width`, with nulls).

    A task adds up, for its stripe of columns against all others, counts, sums, squares and products over the rows that have both; Spark adds up the
    tasks' sums, a row for each pair. Values are taken from their column's mean first, so large means cost no digits. r is null where a
    column doesn't vary on the shared rows. Null arrays don't count.
    """
    rows = rows.where("x is not null").select("x")
    mean = np.zeros(width)
    for r in rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect():  # a row for each column
        mean[r["k"]] = 0.0 if r["m"] is None else r["m"]
    stripe = max(1, min(width, held // (5 * 8 * width)))
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def sums(lo: int):
        hi = min(width, lo + stripe)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((6, hi - lo, width))
            for frame in batches:
                if frame.empty:
                    continue
                raw = np.array([np.asarray(v, float) for v in frame["x"]]).reshape(-1, width) - mean
                have = ~np.isnan(raw)
                x, m = np.where(have, raw, 0.0), have.astype(float)
                xa, ma = x[:, lo:hi], m[:, lo:hi]
                for k, (left, right) in enumerate(((ma, m), (xa, m), (ma, x), (xa * xa, m), (ma, x * x), (xa, x))):
                    total[k] += left.T @ right
            a, b = np.nonzero(np.arange(lo, hi)[:, None] < np.arange(width)[None, :])
            yield pd.DataFrame({"a": a + lo, "b": b, **{name: total[k, a, b] for k, name in enumerate(names)}})

        return rows.mapInPandas(run, "a int, b int, " + ", ".join(f"{x} double" for x in names))

    out = sums(0)
    for lo in range(stripe, width, stripe):
        out = out.unionByName(sums(lo))
    t = out.groupBy("a", "b").agg(*[F.sum(x).alias(x) for x in names])
    n = F.nullif(F.col("n"), F.lit(0.0))
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    varies = (va > 1e-12 * F.col("saa")) & (vb > 1e-12 * F.col("sbb"))
    return t.select("a", "b", F.col("n").cast("long").alias("n"), F.when(varies, (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb)).alias("r"))


def named_correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, r with the columns' names, in the order of columns."""
    names = F.array(*[F.lit(x) for x in columns])
    found = correlations(wide.select(as_array(columns).alias("x")), len(columns))
    return found.select(F.get(names, "a").alias("a"), F.get(names, "b").alias("b"), "n", "r")
