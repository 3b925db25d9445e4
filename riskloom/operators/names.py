"""Names that are nearly equal, without comparing all with all."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import settle

GRAM = 3


def within_distance(names: DataFrame, k: int = 4) -> DataFrame:
    """a, b: all pairs a < b of the distinct names n at an edit distance of k at most.

    Of a name cut into k + 1 even parts one is left whole by k edits, and stands at most k places further in the other name:
    the parts of a name meet the pieces of that length of every name that is as long or up to k longer.
    """
    n = names.select("n").where("n is not null").distinct().withColumn("l", F.length("n"))
    begin = lambda i, length: F.floor(i * length / (k + 1)).cast("int")
    piece = lambda i, length: begin(i + 1, length) - begin(i, length)
    parts = n.select(F.col("n").alias("short"), F.col("l"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.substring("n", begin(i, F.col("l")) + 1, piece(i, F.col("l"))))).alias("i", "s"))
    other = n.select(F.col("n").alias("long"), F.col("l").alias("ll"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("l") - k), F.col("l"))).alias("l"))
    other = other.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn("at", F.explode(F.sequence(F.lit(-k), F.lit(k)))).withColumn("from", begin(F.col("i"), F.col("l")) + F.col("at"))
    other = other.where("from >= 0 and from <= ll").select("long", "l", "i", F.substring("long", F.col("from") + 1, piece(F.col("i"), F.col("l"))).alias("s")).distinct()
    pairs = parts.join(other, ["l", "i", "s"]).where("short <> long").select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct()
    return pairs.where(F.levenshtein("a", "b") <= k)


def _shared(least: float, l1, l2):
    """How many grams two names of these lengths have in common at least if their ratio is above least.

    2 * matched / (l1 + l2) > least bounds the unmatched characters u = l1 + l2 - 2 * matched. Between two matched blocks stands at
    least one of them, so there are u + 1 blocks at most, each of which loses GRAM - 1 of its grams.
    """
    total = l1 + l2
    matched = F.floor(total * least / 2 - 1e-9) + 1
    return matched - (GRAM - 1) * (total - 2 * matched + 1)


def ratio_candidates(names: DataFrame, least: float = 0.9) -> DataFrame:
    """a, b: pairs a < b of the distinct names n whose sequence-match ratio may be above least.

    All (gram, occurrence) are ordered from rare to common. Names with t of g grams in common share one of the g - t + 1
    rarest of each. From 0.9 on any two different names above it have a gram in common (5 and 6 characters: one, longer ones: more); below it that isn't so.
    """
    if least < 0.9:
        raise ValueError("names of a ratio below 0.9 may have no gram in common")
    n = names.select("n").where("n is not null").distinct().withColumn("l", F.length("n"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.col("l") - GRAM + 1, F.lit(1))), lambda i: F.substring("n", i, F.lit(GRAM)))
    each = n.select("n", "l", F.posexplode(grams).alias("at", "g"))
    each = settle(each.groupBy("n", "l", "g").agg(F.count(F.lit(1)).alias("k")).select("n", "l", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("k"), "g"), "grams")
    often = each.groupBy("g", "k").agg(F.count(F.lit(1)).alias("often"))
    ordered = each.join(often, ["g", "k"]).groupBy("n", "l").agg(F.sort_array(F.collect_list(F.struct("often", "g", "k"))).alias("t"))  # one name's
    longest = F.ceil(F.col("l") * (2 - least) / least).cast("int")
    partners = F.sequence(F.floor(F.col("l") * least / (2 - least)).cast("int"), longest)
    close = F.filter(partners, lambda m: F.least(m, F.col("l")) * 2 > (m + F.col("l")) * least - 1e-9)
    need = F.array_min(F.transform(close, lambda m: F.greatest(F.lit(1), _shared(least, m, F.col("l")))))
    size = F.greatest(F.lit(0), F.size("t") - need + 1).cast("int")
    index = settle(ordered.select("n", "l", F.explode(F.slice("t", F.lit(1), size)).alias("t")).select("n", "l", "t.g", "t.k"), "index")
    left, right = (index.select("g", "k", F.col("n").alias(a), F.col("l").alias("l" + a)) for a in "ab")
    fits = (F.col("a") < F.col("b")) & (F.least("la", "lb") * 2 > (F.col("la") + F.col("lb")) * F.lit(least) - 1e-9)
    return left.join(right, ["g", "k"]).where(fits).select("a", "b").distinct()


def similar_by_ratio(names: DataFrame, least: float = 0.9) -> DataFrame:
    """a, b, ratio of all pairs a < b of the distinct names n whose sequence-match ratio is above least."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return ratio_candidates(names, least).select("a", "b", ratio("a", "b").alias("ratio")).where(F.col("ratio") > least)
