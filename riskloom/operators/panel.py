"""Jobs on a long panel (e, i, t, v): latest values, coverage, ranks, trends, gaps. DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .long_series import exponential_average, smoothed, spline_fill
from .quantiles import column_medians, percentile_rank, quantiles, running
from .tables import settle

__all__ = ["column_medians", "exponential_average", "percentile_rank", "quantiles", "running", "smoothed", "spline_fill"]
SERIES = ("e", "i")


def latest(panel: DataFrame, as_of_year: int | None = None, keys: Sequence[str] = SERIES) -> DataFrame:
    """The last value and its year of each series; rows with a null period or value don't count, ties go to the larger value."""
    rows = panel.where("t is not null and v is not null")
    if as_of_year is not None:
        rows = rows.where(F.year("t") <= as_of_year)
    last = rows.groupBy(*keys).agg(F.max(F.struct("t", "v")).alias("x"))
    return last.select(*keys, F.col("x.v").alias("v"), F.year("x.t").alias("year"))


def widen(last: DataFrame, names: dict[str, str], years: bool = True) -> DataFrame:
    """One row for each entity, a column (and its year) for each named indicator."""
    out = [F.max(F.when(F.col("i") == code, F.col("v"))).alias(name) for code, name in names.items()]
    if years:
        out += [F.max(F.when(F.col("i") == code, F.col("year"))).alias(name + "_year") for code, name in names.items()]
    return last.where(F.col("i").isin(*names)).groupBy("e").agg(*out)


def latest_of(last: DataFrame, names: Sequence[str]) -> DataFrame:
    """The latest values and years of some indicators, one row for each entity that has any value at all."""
    pick = lambda i, c: F.max(F.when(F.col("i") == i, F.col(c)))
    return last.groupBy("e").agg(*[x for i in names for x in (pick(i, "v").alias(i), pick(i, "year").alias(i + "_year"))])


def covered(last: DataFrame, least: int) -> DataFrame:
    """The rows whose indicator has `least` entities at least."""
    enough = last.groupBy("i").agg(F.countDistinct("e").alias("n")).where(F.col("n") >= least).select("i")
    return last.join(enough, "i", "left_semi")


def covered_matrix(sets: Sequence[tuple[str, DataFrame, int]]) -> DataFrame:
    """One row for each entity of any dataset, a column `dataset_indicator` for each indicator that enough entities have.

    sets: (dataset, latest values, least entities). The columns are the indicators found, whose number the pivot reads first.
    """
    every = None
    for name, last, least in sets:
        part = covered(last, least).select("e", F.concat(F.lit(name + "_"), "i").alias("i"), "v")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("e").pivot("i").agg(F.max("v"))


def period_matrix(sets: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One row for each (entity, period) of any dataset, sorted, with the mean of each indicator found, prefixed by its dataset."""
    every = None
    for name, panel in sets:
        part = panel.select("e", "t", F.concat(F.lit(name + "_"), "i").alias("i"), "v")
        every = part if every is None else every.unionByName(part)
    return every.groupBy("e", "t").pivot("i").agg(F.avg("v")).sort("e", "t")


def coverage(panel: DataFrame, *keys: str, other: str) -> DataFrame:
    return panel.groupBy(*keys).agg(F.countDistinct(other).alias(f"n_{other}"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n_rows"))


def weighted_percentiles(last: DataFrame, *scores: tuple[str, dict[str, float]]) -> DataFrame:
    """e and, for each (name, weights), the mean over the entity's indicators of percentile x 100 x |weight|; a negative weight turns
    the percentile. An entity without any of a score's indicators has null there. All scores share one ranking."""
    ranked = percentile_rank(settle(last.where(F.col("i").isin(*{i for _, weights in scores for i in weights})), "latest"))

    def mean(weights: dict[str, float]) -> Column:
        w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("i")]
        return F.avg(F.when(w < 0, 1 - F.col("pct")).otherwise(F.col("pct")) * 100 * F.abs(w))

    return ranked.groupBy("e").agg(*[mean(weights).alias(name) for name, weights in scores])


def numbered(panel: DataFrame) -> DataFrame:
    """Non-null points with their place x in the series, from 0, and n, the series' length."""
    good = panel.where("t is not null and v is not null")
    series = W.partitionBy(*SERIES)
    return good.withColumn("x", (F.row_number().over(series.orderBy("t")) - 1).cast("double")).withColumn("n", F.count(F.lit(1)).over(series))


def trends(panel: DataFrame, least: int = 4) -> DataFrame:
    """Slope, fit, spread, momentum and class of each series of `least` points at least."""
    p = numbered(panel).where(F.col("n") >= least)
    back = F.col("n") - F.col("x")
    out = p.groupBy(*SERIES).agg(
        F.max("n").alias("n"), F.regr_slope("v", "x").alias("slope"), F.regr_r2("v", "x").alias("r2"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min_by("v", "x").alias("first_v"), F.max_by("v", "x").alias("last_v"), F.min("v").alias("min_v"), F.max("v").alias("max_v"),
        F.avg(F.when(back <= 3, F.col("v"))).alias("_a"), F.avg(F.when((back > 3) & (back <= 6), F.col("v"))).alias("_b"),
    )
    pct = F.when(F.col("mean") != 0, F.col("slope") / F.abs("mean") * 100)
    out = out.withColumn("slope_pct", pct).withColumn("cv_pct", F.when(F.col("mean") != 0, F.col("std") / F.abs("mean") * 100))
    out = out.withColumn("momentum", F.when((F.col("n") >= 6) & (F.col("_b") != 0), (F.col("_a") - F.col("_b")) / F.abs("_b") * 100))
    kind = F.when(F.abs("slope_pct") < 1, "stable").when(F.col("slope") > 0, "improving").otherwise("declining")
    return out.withColumn("trend", kind).drop("_a", "_b")


def anomalies(panel: DataFrame, limit: float = 2.5, least: int = 4) -> DataFrame:
    series = W.partitionBy(*SERIES)
    good = panel.where("t is not null and v is not null")
    p = good.withColumns({"n": F.count(F.lit(1)).over(series), "m": F.avg("v").over(series), "s": F.stddev_pop("v").over(series)})
    z = (F.col("v") - F.col("m")) / F.col("s")
    return p.where((F.col("n") >= least) & (F.col("s") != 0)).withColumn("z", z).where(F.abs("z") > limit).select("e", "i", "t", "v", "z", F.when(F.col("z") > 0, "high").otherwise("low").alias("kind"))


def deterioration(panel: DataFrame, lower_is_better: Sequence[str], points: int = 4) -> DataFrame:
    """Series whose last points move the wrong way by over a tenth of their spread."""
    back = F.row_number().over(W.partitionBy(*SERIES).orderBy(F.desc("t")))
    last = panel.where("t is not null and v is not null").withColumn("b", back).where(F.col("b") <= points)
    fit = last.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("v", -F.col("b").cast("double")).alias("slope"), F.stddev_pop("v").alias("std")).where(F.col("n") == points)
    wrong = F.when(F.col("i").isin(*lower_is_better), F.col("slope") > 0).otherwise(F.col("slope") < 0)
    bad = fit.where(wrong & (F.abs("slope") > 0.1 * F.col("std")))
    return bad.withColumn("severity", F.when(F.abs("slope") > F.col("std"), "High").otherwise("Medium"))


def moving_average(panel: DataFrame, k: int, name: str = "ma") -> DataFrame:
    return panel.withColumn(name, F.avg("v").over(W.partitionBy(*SERIES).orderBy("t").rowsBetween(-(k - 1), 0)))


def crossovers(panel: DataFrame, short: int = 3, long: int = 8) -> DataFrame:
    order = W.partitionBy(*SERIES).orderBy("t")
    p = moving_average(moving_average(panel.where("t is not null and v is not null"), short, "a"), long, "b")
    p = p.withColumn("d", F.col("a") - F.col("b")).withColumn("k", F.row_number().over(order) - 1).withColumn("was", F.lag("d").over(order))
    signal = F.when((F.col("was") <= 0) & (F.col("d") > 0), "bullish").when((F.col("was") >= 0) & (F.col("d") < 0), "bearish")
    return p.withColumn("signal", signal).where((F.col("k") > long) & F.col("signal").isNotNull()).select("e", "i", "t", "d", "signal")


def last_years(panel: DataFrame, years: int) -> DataFrame:
    """The last value of each year of a series, for the years before its own last date."""
    y = panel.where("t is not null and v is not null").groupBy(*SERIES, F.year("t").alias("year")).agg(F.max_by("v", "t").alias("v"), F.max("t").alias("t"))
    y = y.withColumn("_last", F.max("t").over(W.partitionBy(*SERIES)))
    return y.where(F.col("t") >= F.add_months("_last", -12 * years)).drop("_last")


def fill_gaps(panel: DataFrame) -> DataFrame:
    """e, i, t, v, confidence on the grid of observed (i, t) for every entity of the panel.

    Straight lines between real points and through the two edge points beyond them; time is year + month / 12.
    Confidence is 1 for real points, else max(0.1, 1 - distance to the nearest / 5); a series with one
    point is constant with 0.1, one without points stays null with 0.
    """
    have = settle(panel.where("t is not null").groupBy("e", "i", "t").agg(F.avg("v").alias("v")), "points")  # read three times
    grid = have.select("i", "t").distinct().crossJoin(have.select("e").distinct())  # the result has as many rows
    p = grid.join(have, ["e", "i", "t"], "left").withColumn("x", F.year("t") + F.month("t") / 12)
    order = W.partitionBy(*SERIES).orderBy("t")
    real = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
    p = p.withColumn("r", real)
    before, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(0, W.unboundedFollowing)
    # a real point also carries the real point before and after it, for lines beyond the edges
    ahead, behind = order.rowsBetween(1, W.unboundedFollowing), order.rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumns({"pr": F.last("r", True).over(behind), "nr": F.first("r", True).over(ahead), "k": F.count("v").over(W.partitionBy(*SERIES))})
    p = p.withColumns({"l": F.last(F.when(F.col("v").isNotNull(), F.struct("x", "v", F.col("pr").alias("o"))), True).over(before), "f": F.first(F.when(F.col("v").isNotNull(), F.struct("x", "v", F.col("nr").alias("o"))), True).over(after)})
    line = lambda x0, v0, x1, v1: v0 + (v1 - v0) * (F.col("x") - x0) / (x1 - x0)
    c = F.col
    filled = (
        F.when(c("v").isNotNull(), c("v")).when(c("k") == 1, F.coalesce(c("l.v"), c("f.v")))
        .when(c("l").isNotNull() & c("f").isNotNull(), line(c("l.x"), c("l.v"), c("f.x"), c("f.v")))
        .when(c("l").isNotNull(), line(c("l.o.x"), c("l.o.v"), c("l.x"), c("l.v"))).when(c("f").isNotNull(), line(c("f.x"), c("f.v"), c("f.o.x"), c("f.o.v")))
    )
    near = F.least(c("x") - c("l.x"), c("f.x") - c("x"))
    sure = F.when(c("v").isNotNull(), 1.0).when(c("k") == 0, 0.0).when(c("k") == 1, 0.1).otherwise(F.greatest(F.lit(0.1), 1 - near / 5))
    return p.select("e", "i", "t", filled.alias("v"), sure.alias("confidence"))


def merge_sets(sets: Sequence[DataFrame], features: Sequence[str]) -> DataFrame:
    """One row for each key of any set (key, f, v), a column for each feature."""
    every = sets[0].select("key", "f", "v")
    for x in sets[1:]:
        every = every.unionByName(x.select("key", "f", "v"))
    return every.groupBy("key").pivot("f", list(features)).agg(F.max("v"))


def features_by_name(panel: DataFrame, patterns: dict[str, str], first: Sequence[str] = ()) -> DataFrame:
    """e, f, v, year: the last value by t of the rows (e, n, t, v) whose name n fits the feature's pattern, in any case.

    Patterns are tried on distinct names; a name may serve several features. Of equal t the row counts that comes first by the columns `first`, then that of the larger value.
    """
    rows = panel.where("t is not null and v is not null")
    fits = F.array_compact(F.array(*[F.when(F.col("n").rlike("(?i)" + r), F.lit(f)) for f, r in patterns.items()]))
    names = rows.select("n").distinct().select("n", F.explode(fits).alias("f"))
    order = W.partitionBy("e", "f").orderBy(F.desc("t"), *first, F.desc("v"))  # each task keeps one row of a group before the shuffle
    last = rows.join(names, "n").withColumn("_k", F.row_number().over(order)).where("_k = 1")
    return last.select("e", "f", "v", F.year("t").alias("year"))


def credit_ratios(last: DataFrame, private: str, total: str, output: str, private_range: tuple[float, float] = (5.0, 500.0), total_range: tuple[float, float] = (5.0, 600.0)) -> DataFrame:
    """e, private, total, gap, year, gdp_year from latest values (e, i, v, year): credit / 1000 / output in percent.

    Rows whose private ratio is out of range go, a total out of range is null; the gap is the distance from the median row.
    """
    pick = lambda code, what: F.max(F.when(F.col("i") == code, F.col(what)))
    wide = last.where(F.col("i").isin(private, total, output)).groupBy("e").agg(pick(private, "v").alias("p"), pick(total, "v").alias("t"), pick(output, "v").alias("g"), pick(private, "year").alias("year"), pick(output, "year").alias("gdp_year"))
    ratio = lambda x: F.when(F.col("g") != 0, F.col(x) / 1000 / F.col("g") * 100)
    inside = lambda x, lim: (F.col(x) > lim[0]) & (F.col(x) < lim[1])
    wide = wide.withColumns({"private": ratio("p"), "total": ratio("t")}).where(inside("private", private_range))
    wide = settle(wide, "ratios")
    median = F.broadcast(quantiles(wide, "private", {"m": 0.5}))  # one row
    return wide.crossJoin(median).select("e", "private", F.when(inside("total", total_range), F.col("total")).alias("total"), (F.col("private") - F.col("m")).alias("gap"), "year", "gdp_year")


def claim_share(rows: DataFrame, codes: Sequence[str]) -> DataFrame:
    """e, share: the first code's claim in percent of all, missing ones counting as 0, where it is above 0."""
    value = lambda x: F.max(F.when(F.col("i") == x, F.col("v")))
    total = sum((F.coalesce(value(x), F.lit(0.0)) for x in codes[1:]), F.coalesce(value(codes[0]), F.lit(0.0)))
    wide = rows.where(F.col("i").isin(*codes)).groupBy("e").agg(value(codes[0]).alias("g"), total.alias("s"))
    return wide.where("g > 0").select("e", (F.col("g") / F.col("s") * 100).alias("share"))
