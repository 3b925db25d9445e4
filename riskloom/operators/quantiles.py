"""Order in large groups without a task that sorts a whole group: running sums, ranks, exact quantiles.

A group's distinct values are counted first. As long as the largest group has more of them than one task should order, groups are cut into
bins at approximate quantiles, the bins are summed, and each bin becomes a group of its own; the last level is ordered by windows.
The number of levels follows from the counts: each divides a group by about CUTS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import settle

#: Distinct values of a group that one task orders.
MOST = 100_000
#: Bins of a group at each level.
CUTS = 256


def running(counts: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), most: int = MOST, cuts: int = CUTS, bound: int | None = None) -> DataFrame:
    """counts (one row for each value of a group, no nulls among them) with each sum over the group's smaller values (before_x) and over all (all_x).

    bound: what no group has more rows than, if that is known. Otherwise, or if it is beyond `most`, the counts are settled and groups measured.
    """
    counts = counts.select(*by, value, *sums)
    if bound is not None and bound <= most:
        return _ordered(counts, value, list(sums), list(by), bound, most, cuts)
    counts = settle(counts, "counts")
    largest = counts.rows_at_most
    if largest > most:
        largest = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return _ordered(counts, value, list(sums), list(by), largest, most, cuts)


def _ordered(counts: DataFrame, value: str, sums: list[str], by: list[str], largest: int, most: int, cuts: int) -> DataFrame:
    if largest <= most:
        group = W.partitionBy(*by)
        ahead = group.orderBy(value).rowsBetween(W.unboundedPreceding, -1)
        return counts.select("*", *[F.coalesce(F.sum(x).over(ahead), F.lit(0)).alias(f"before_{x}") for x in sums], *[F.sum(x).over(group).alias(f"all_{x}") for x in sums])
    level = sum(x.startswith("_bin") for x in by)
    bin_, edges = f"_bin{level}", f"_edges{level}"
    at = counts.groupBy(*by).agg(F.percentile_approx(value, [k / cuts for k in range(1, cuts)], 10 * cuts).alias(edges))  # cuts - 1 values of each group
    placed = counts.join(at, by) if by else counts.crossJoin(F.broadcast(at))
    placed = placed.withColumn(bin_, F.size(F.filter(edges, lambda x: x < F.col(value)))).drop(edges)
    inner = _ordered(placed, value, sums, [*by, bin_], int(1.3 * largest / cuts) + 2, most, cuts)
    whole = placed.groupBy(*by, bin_).agg(*[F.sum(x).alias(f"_sum_{x}") for x in sums])
    group = W.partitionBy(*by)  # `cuts` rows
    ahead = group.orderBy(bin_).rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select(*by, bin_, *[F.coalesce(F.sum(f"_sum_{x}").over(ahead), F.lit(0)).alias(f"_first_{x}") for x in sums], *[F.sum(f"_sum_{x}").over(group).alias(f"_all_{x}") for x in sums])
    out = inner.join(whole, [*by, bin_])
    return out.select(*counts.columns, *[(F.col(f"_first_{x}") + F.col(f"before_{x}")).alias(f"before_{x}") for x in sums], *[F.col(f"_all_{x}").alias(f"all_{x}") for x in sums])


def percentile_rank(rows: DataFrame, value: str = "v", by: Sequence[str] = ("i",), name: str = "pct") -> DataFrame:
    """rows with a non-null value (and group) and their mean rank over the count, ties averaged; equal values are counted before they are ordered.

    rows are read twice: settle them where they are dear.
    """
    good = rows
    for x in (value, *by):
        good = good.where(F.col(x).isNotNull())
    counts = running(good.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), value, ["_c"], by, bound=getattr(rows, "rows_at_most", None))
    pct = (F.col("before__c") + (F.col("_c") + 1) / 2) / F.col("all__c")
    return good.join(counts.select(*by, value, pct.alias(name)), [*by, value])


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), most: int = MOST, cuts: int = CUTS, bound: int | None = None) -> DataFrame:
    """by and a column for each name in shares: the exact quantile of the non-null values, linear between its two neighbours.

    Rows with a null in `by` don't count, nor do NaN values. A group without values has no row; without `by` there is always one row.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    for x in by:
        good = good.where(F.col(x).isNotNull())
    counts = running(good.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")), value, ["_c"], by, most, cuts, getattr(rows, "rows_at_most", None) if bound is None else bound)
    at = lambda k: F.max(F.when((F.col("before__c") <= k) & (k < F.col("before__c") + F.col("_c")), F.col(value).cast("double")))

    def exact(share: float) -> Column:
        place = (F.col("all__c") - 1) * F.lit(float(share))
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return low + (high - low) * part

    return counts.groupBy(*by).agg(*[exact(share).alias(name) for name, share in shares.items()])


def column_medians(wide: DataFrame, columns: Sequence[str], suffix: str = "_m") -> DataFrame:
    """One row with the exact median of each column, named with the suffix; null for a column without values."""
    long = wide.select(*columns).unpivot([], list(columns), "_f", "_v")
    found = quantiles(long, "_v", {"_q": 0.5}, ["_f"], bound=getattr(wide, "rows_at_most", None))
    return found.agg(*[F.max(F.when(F.col("_f") == x, F.col("_q"))).alias(x + suffix) for x in columns])
