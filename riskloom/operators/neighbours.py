"""Filling gaps from the nearest rows, where rows have gaps of their own.

Rows of one pattern of gaps are cut into blocks at approximate quantiles of their features in turn. A block's smallest and largest
values bound from below how near any of its rows can be to a row of another block, over the features that both patterns have. Each block
first meets the few nearest blocks that can give its missing features; the k-th distances found there are the bound for all other
blocks, most of which are never compared row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .gram import as_array
from .helpers import nan_distances
from .tables import settle

CUTS = 4
#: Blocks that each block meets first, for each feature it lacks.
FIRST = 2


def blocks(cells: DataFrame, width: int, block: int) -> DataFrame:
    """cells (key, x) with b, the block of the row: its pattern of gaps, then its cell in it."""
    pattern = F.array_join(F.transform("x", lambda v: F.when(v.isNull(), "0").otherwise("1")), "")
    placed = settle(cells.withColumn("b", pattern), "placed")
    quiet = 0
    for level in range(64 * width):
        sizes = placed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        if quiet >= width or sizes.isEmpty():  # rows that no feature tells apart stay together
            break
        value = F.get("x", F.lit(level % width))
        large = placed.join(sizes.select("b"), "b", "left_semi").where(value.isNotNull())
        edges = settle(large.groupBy("b").agg(F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], 1000).alias("edges"), (F.min(value) < F.max(value)).alias("varies")).where("varies"), "edges")
        quiet = quiet + 1 if edges.isEmpty() else 0
        place = F.size(F.filter("edges", lambda c: c < value)).cast("string")
        placed = settle(placed.join(edges, "b", "left").withColumn("b", F.when(F.col("edges").isNull(), F.col("b")).otherwise(F.concat("b", F.lit("."), place))).select("key", "x", "b"), "placed")
    return placed


def bounded(boxes: DataFrame, width: int) -> DataFrame:
    """b1, b2, least: how near rows of two blocks (b, lo, hi) can be, for blocks that share a feature and of which b2 has one that b1 lacks."""
    one, two = (boxes.select(*[F.col(c).alias(c + k) for c in ("b", "lo", "hi")]) for k in "12")
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(F.lit(0.0), lo2 - hi1, lo1 - hi2)
    each = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(F.get("lo1", k).isNotNull() & F.get("lo2", k).isNotNull(), F.pow(gap(F.get("lo1", k), F.get("hi1", k), F.get("lo2", k), F.get("hi2", k)), F.lit(2.0))))
    lacks = F.exists(F.zip_with("lo1", "lo2", lambda x, y: x.isNull() & y.isNotNull()), lambda x: x)
    pairs = one.crossJoin(two).where(lacks).withColumn("each", F.array_compact(each)).where("size(each) > 0")  # boxes of blocks, not rows
    return pairs.select("b1", "b2", "lo1", "lo2", F.sqrt(F.aggregate("each", F.lit(0.0), lambda a, x: a + x) * width / F.size("each")).alias("least"))


def _compared(pairs: DataFrame, packed: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """b1, key, f, dist, donor, v: of each pair of blocks (b1, b2) the k nearest donors in b2 of each gap in b1."""
    both = pairs.select("b1", "b2").join(packed.select(F.col("b").alias("b1"), F.col("rows").alias("r1")), "b1").join(packed.select(F.col("b").alias("b2"), F.col("rows").alias("r2")), "b2")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b1, r1, r2 in zip(batch["b1"], batch["r1"], batch["r2"], strict=True):
                ka, kb = np.array([r["key"] for r in r1]), np.array([r["key"] for r in r2])
                a, b = (np.array([r["x"] for r in rows], float) for rows in (r1, r2))
                dist = nan_distances(a, b)
                dist[ka[:, None] == kb[None, :]] = np.inf
                for j in np.flatnonzero(np.isnan(a[0]) & ~np.isnan(b[0])):  # rows of a block have the same gaps
                    near = np.argsort(dist, axis=1, kind="stable")[:, :k]  # rows are in order of their keys
                    d = np.take_along_axis(dist, near, axis=1)
                    i, m = np.nonzero(np.isfinite(d))
                    yield pd.DataFrame({"b1": b1, "key": ka[i], "f": features[j], "dist": d[i, m], "donor": kb[near[i, m]], "v": b[near[i, m], j]})

    return both.select("b1", "r1", "r2").mapInPandas(run, "b1 string, key long, f string, dist double, donor long, v double")


def knn_fill(wide: DataFrame, features: Sequence[str], k: int = 5, block: int = 2000) -> DataFrame:
    """key, f, v, confidence: every missing cell of wide (key and features) from the k nearest rows that have the feature.

    Distances are over the features that both rows have, scaled up to all. Weights are 1 / distance, or the rows at distance 0 alone; without a donor
    that shares a feature the column's mean counts. Confidence is 0.7, or 0 where a column has no value at all.
    """
    features, width = list(features), len(features)
    best = donors(wide, features, k, block)
    zero = F.min("dist").over(W.partitionBy("key", "f")) == 0
    best = best.withColumn("w", F.when(zero, (F.col("dist") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "dist")))
    found = best.groupBy("key", "f").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    means = wide.agg(*[F.avg(f).alias(f) for f in features]).unpivot([], features, "f", "m")
    gaps = wide.unpivot(["key"], features, "f", "v").where("v is null").select("key", "f")
    value = F.coalesce("v", "m")
    return gaps.join(found, ["key", "f"], "left").join(F.broadcast(means), "f").select("key", "f", value.alias("v"), F.when(value.isNotNull(), 0.7).otherwise(0.0).alias("confidence"))


def donors(wide: DataFrame, features: Sequence[str], k: int = 5, block: int = 2000, met: list | None = None) -> DataFrame:
    """key, f, dist, donor, v: the k nearest donors of every gap, ties to the smaller key. met: gets the numbers of pairs of blocks that were compared, and of all."""
    features, width = list(features), len(features)
    placed = blocks(wide.select("key", as_array(features).alias("x")), width, block)
    lists = placed.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("key", "x"))).alias("rows"))  # about `block` rows, unless no feature tells them apart
    packed = settle(lists, "packed")
    value = lambda pick: F.array(*[pick(F.get("x", F.lit(j))) for j in range(width)])
    boxes = settle(placed.groupBy("b").agg(value(F.min).alias("lo"), value(F.max).alias("hi")), "boxes")
    pairs = settle(bounded(boxes, width), "pairs")
    gaps = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.get("lo1", j).isNull() & F.get("lo2", j).isNotNull())
    wanted = pairs.select("b1", "b2", "least", F.explode(gaps).alias("j"))
    nearest = wanted.withColumn("m", F.row_number().over(W.partitionBy("b1", "j").orderBy("least", "b2"))).where(F.col("m") <= FIRST)
    first = settle(nearest.select("b1", "b2").distinct(), "first")
    near = settle(_compared(first, packed, features, k), "near")
    # the k-th distance of a block's worst row bounds what other blocks may still give for a feature
    names = F.array(*[F.lit(f) for f in features])
    kth = near.withColumn("m", F.row_number().over(W.partitionBy("key", "f").orderBy("dist", "donor"))).where(F.col("m") == k)
    reach = kth.groupBy("b1", "f").agg(F.max("dist").alias("most"), F.countDistinct("key").alias("n"))
    full = placed.groupBy(F.col("b").alias("b1")).agg(F.count(F.lit(1)).alias("rows"))
    reach = reach.join(full, "b1").where("n = rows").select("b1", "f", "most")  # a row with fewer donors must meet all
    open_ = wanted.select("b1", "b2", "least", F.get(names, "j").alias("f")).join(reach, ["b1", "f"], "left").where(F.col("most").isNull() | (F.col("least") <= F.col("most") * (1 + 1e-9)))
    rest = settle(open_.select("b1", "b2").distinct().join(first, ["b1", "b2"], "left_anti"), "rest")
    if met is not None:
        met += [first.count() + rest.count(), boxes.count() ** 2]
    every = near.unionByName(_compared(rest, packed, features, k))
    return every.withColumn("m", F.row_number().over(W.partitionBy("key", "f").orderBy("dist", "donor"))).where(F.col("m") <= k).select("key", "f", "dist", "donor", "v")
