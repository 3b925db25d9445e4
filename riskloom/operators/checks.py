"""Comparisons of feature tables, and checks of scores and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets of cells whose checksums are compared first.
BUCKETS = 4096
#: Bounds of events for each feature, and what lies below each; then what lies above all.
SAMPLE_BANDS = ((1, "critical"), (5, "warning"), (10, "marginal"))


def _sums(cells: DataFrame, name: str) -> DataFrame:
    """Of each bucket the number of cells and two sums of hashes."""
    hashes = [F.sum(F.xxhash64("key", "f", "v", F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    return cells.groupBy("bucket").agg(F.struct(F.count(F.lit(1)), *hashes).alias(name))


def status(raw: Column, stored: Column, pct: Column) -> Column:
    return (
        F.when(raw.isNull() & stored.isNull(), "BOTH_NULL").when(raw.isNull(), "RAW_NULL").when(stored.isNull(), "PARQUET_NULL")
        .when(F.abs(pct) < 1, "MATCH").when(F.abs(pct) < 5, "CLOSE").otherwise("DIVERGE")
    )


def compared(raw: DataFrame, stored: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """key, f, raw, stored, diff, pct, status of each cell of two feature tables (key, f, v) whose key and whose feature both have.

    pct is the difference in percent of the stored value, 0 where that is 0. A missing cell is a null. Cells are put in buckets by
    hash; buckets of equal checksums (the count and two 64-bit hashes' sums) hold equal cells, which one side alone gives. Only the
    cells of other buckets meet each other.
    """
    a, b = (x.select("key", "f", "v").withColumn("bucket", F.pmod(F.xxhash64("key", "f"), F.lit(buckets))) for x in (raw, stored))
    both = _sums(a, "x").join(_sums(b, "y"), "bucket", "full")
    same = F.broadcast(both.where("x = y").select("bucket"))  # `buckets` rows at most
    equal = a.join(same, "bucket", "left_semi").select("key", "f", F.col("v").alias("raw"), F.col("v").alias("stored"))
    left, right = (x.join(same, "bucket", "left_anti").drop("bucket") for x in (a, b))
    met = left.withColumnRenamed("v", "raw").join(right.withColumnRenamed("v", "stored"), ["key", "f"], "full")
    for column in ("key", "f"):  # a cell that one side lacks counts only if its key and feature are on both
        met = met.join(raw.select(column).intersect(stored.select(column)), column, "left_semi")
    cells = equal.unionByName(met)
    diff = F.col("raw") - F.col("stored")
    pct = F.when(diff.isNull(), F.when(F.col("raw").isNull() & F.col("stored").isNull(), 0.0)).when(F.col("stored") == 0, 0.0).otherwise(diff / F.col("stored") * 100)
    cells = cells.withColumns({"diff": F.coalesce(diff, F.when(F.col("raw").isNull() & F.col("stored").isNull(), 0.0)), "pct": pct})
    return cells.select("key", "f", "raw", "stored", "diff", "pct", status(F.col("raw"), F.col("stored"), F.col("pct")).alias("status"))


def one_sided(raw: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """The values of a column that one table alone has, and its side."""
    only = lambda x, y, side: x.select(column).subtract(y.select(column)).withColumn("side", F.lit(side))
    return only(raw, stored, "raw").unionByName(only(stored, raw, "stored"))


def most_diverging(cells: DataFrame, top: int = 20) -> DataFrame:
    """The cells that diverge most, by |pct|."""
    return cells.where("status = 'DIVERGE'").orderBy(F.desc(F.abs("pct")), "key", "f").limit(top)


def imputed_variance(raw: DataFrame, filled: DataFrame, least: float = 0.01) -> DataFrame:
    """f, n, variance, warn: the population variance of the cells (key, f, v) of each feature that are null in raw and filled in filled; more than one of them."""
    gaps = raw.where("v is null").select("key", "f")
    cells = filled.where("v is not null").join(gaps, ["key", "f"], "left_semi")
    found = cells.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("variance")).where("n > 1")
    return found.withColumn("warn", F.col("variance") < least)


def required_features(found: DataFrame, required: Sequence[str]) -> DataFrame:
    """name, present of each required feature, and the share of them in percent that is among the features f of found."""
    asked = F.broadcast(found.sparkSession.createDataFrame([(x,) for x in required], "name string"))
    have = found.select("f").distinct().join(asked, F.col("f") == F.col("name"), "left_semi")  # as many rows as are required at most
    out = asked.join(have, F.col("name") == F.col("f"), "left").select("name", F.col("f").isNotNull().alias("present"))
    share = have.agg((F.count(F.lit(1)) * 100 / len(required)).alias("share"))  # one row
    return out.crossJoin(F.broadcast(share))


def sample_size(events: DataFrame, features: DataFrame) -> DataFrame:
    """events, features, ratio, band: the number of events for each distinct feature f, banded."""
    both = events.agg(F.count(F.lit(1)).alias("events")).crossJoin(features.agg(F.countDistinct("f").alias("features")))  # one row each
    out = both.withColumn("ratio", F.try_divide(F.col("events"), F.col("features")))
    band = F.when(F.col("ratio") < SAMPLE_BANDS[0][0], SAMPLE_BANDS[0][1])
    for bound, name in SAMPLE_BANDS[1:]:
        band = band.when(F.col("ratio") < bound, name)
    return out.withColumn("band", band.otherwise("adequate"))


def expected(scores: DataFrame, lists: DataFrame, high: float = 6.0, low: float = 4.0) -> DataFrame:
    """kind, n, found, validated, share of the lists (key, kind high or low) by scores (key, score); a key without a score isn't validated."""
    ok = F.when(F.col("kind") == "high", F.col("score") >= high).otherwise(F.col("score") <= low)
    each = lists.join(scores, "key", "left").withColumn("ok", F.coalesce(ok, F.lit(False)))
    out = each.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("found"), F.count(F.when(F.col("ok"), 1)).alias("validated"))
    return out.withColumn("share", F.col("validated") / F.col("n") * 100)


def ordered_pairs(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, sa, sb, relation (< or >) of the pairs (a, b) that both have a score (key, score)."""
    side = lambda k: scores.select(F.col("key").alias(k), F.col("score").alias("s" + k))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", F.when(F.col("sa") < F.col("sb"), "<").otherwise(">").alias("relation"))


def banded(rows: DataFrame, value: str, bands: DataFrame, on: Sequence[str] = (), name: str = "band", otherwise: str = "NR") -> DataFrame:
    """rows with the band (lo <= value < hi) of their value in bands (on..., band, lo, hi), else `otherwise`.

    Bands are few: a row for each band of a table of thresholds.
    """
    bands = bands.select(*[F.col(x).alias("_on_" + x) for x in on], F.col("band").alias("_band"), "lo", "hi")
    fits = (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    for x in on:
        fits = fits & (F.col(x) == F.col("_on_" + x))
    return rows.join(F.broadcast(bands), fits, "left").select(*rows.columns, F.coalesce("_band", F.lit(otherwise)).alias(name))
