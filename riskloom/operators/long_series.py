"""Work along series (e, i) that are too long for one task: scans, smoothing, splines.

Points are range-sorted by series and time, so a long series lies over many partitions. What crosses their borders is one row for
each series of a partition. Rows with a null entity, indicator or time belong to no series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import settle

SERIES = ("e", "i")
#: Points of a series in a block.
BLOCK = 4096
_ROW = (1 << 33) - 1


def _sorted(points: DataFrame) -> DataFrame:
    order = [*SERIES, "t", "v"]
    return points.where("e is not null and i is not null and t is not null").repartitionByRange(*order).sortWithinPartitions(*order)


def placed(points: DataFrame) -> DataFrame:
    """points (e, i, t, v and others) with part and row (their place in the sort), x (place in the series, from 0) and n (the series' length); settled."""
    dealt = settle(_sorted(points).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(_ROW).alias("row")), "placed")
    own = dealt.groupBy(*SERIES, "part").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_own"))
    series = W.partitionBy(*SERIES)  # a row for each partition of a series
    ahead = F.sum("_own").over(series.orderBy("part")) - F.col("_own") - F.col("_first")
    own = own.select(*SERIES, "part", ahead.alias("_ahead"), F.sum("_own").over(series).alias("n"))
    return dealt.join(own, [*SERIES, "part"]).withColumn("x", F.col("_ahead") + F.col("row")).drop("_ahead")


def in_blocks(rows: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """rows (placed) with block, and own: each also stands, not its own, in the blocks whose borders are at most `halo` points away."""
    reach = lambda x: F.floor(x / block).cast("int")
    at = F.sequence(reach(F.greatest(F.col("x") - halo, F.lit(0))), reach(F.least(F.col("x") + halo, F.col("n") - 1)))
    return rows.withColumn("block", F.explode(at)).withColumn("own", F.col("block") == reach(F.col("x")))


def exponential_average(panel: DataFrame, span: int, adjusted: bool = False) -> DataFrame:
    """e, i, t, v, ema of each point with a value: the exponential average in order of time.

    A step is the map y -> keep * y + v. Each task composes its own points' maps, one row for each series and task goes through the
    tasks in order, and what comes in from the tasks before is added.
    """
    keep = 1 - 2 / (span + 1)

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, sum_, k = TaskContext.get().partitionId(), None, 0.0, 0
        for x in batches:
            if x.empty:
                continue
            run = ((x["e"] != x["e"].shift()) | (x["i"] != x["i"].shift())).cumsum()
            by = x["v"].groupby(run)
            place = by.cumcount().to_numpy()
            sums = by.ewm(alpha=1 - keep, adjust=True).mean().to_numpy() * (1 - keep ** (place + 1)) / (1 - keep)
            if last == (x["e"].iloc[0], x["i"].iloc[0]):  # goes on from the batch before
                first = (run == run.iloc[0]).to_numpy()
                sums[first] += keep ** (place[first] + 1) * sum_
                place[first] += k
            last, sum_, k = (x["e"].iloc[-1], x["i"].iloc[-1]), sums[-1], place[-1] + 1
            yield x.assign(part=part, k=place, s=sums)

    points = _sorted(panel.where("v is not null").select("e", "i", "t", F.col("v").cast("double").alias("v")))
    scanned = settle(points.mapInPandas(own, "e string, i string, t date, v double, part int, k long, s double"), "scanned")
    part = scanned.groupBy(*SERIES, "part").agg(F.count(F.lit(1)).alias("n"), F.max_by("s", "k").alias("last"), F.min_by("v", "k").alias("first"))
    before = W.partitionBy(*SERIES).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition of a series
    carried = F.aggregate(F.collect_list(F.struct("n", "last")).over(before), F.lit(0.0), lambda a, x: a * F.pow(F.lit(keep), x["n"]) + x["last"])
    part = part.select(*SERIES, "part", carried.alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"), F.coalesce(F.first("first").over(before), "first").alias("first"))
    rows = scanned.join(part, [*SERIES, "part"])
    total, left = F.col("s") + F.pow(F.lit(keep), F.col("k") + 1) * F.col("carry"), F.pow(F.lit(keep), F.col("ahead") + F.col("k") + 1)
    ema = total * (1 - keep) / (1 - left) if adjusted else (1 - keep) * total + left * F.col("first")
    return rows.select("e", "i", "t", "v", ema.alias("ema"))


def smoothed(panel: DataFrame, block: int = BLOCK) -> DataFrame:
    """e, i, t, v, smooth: local quadratics over an odd window of min(points - 1, 7); half windows at the ends take the first and last fit."""
    rows = in_blocks(placed(panel.where("v is not null").select("e", "i", "t", F.col("v").cast("double").alias("v"))), 6, block)
    order = W.partitionBy(*SERIES, "block").orderBy("x")
    near = {k: F.lead("v", k).over(order) if k >= 0 else F.lag("v", -k).over(order) for k in range(-6, 7)}
    rows = rows.withColumns({f"_{k + 6}": v for k, v in near.items()}).where("own")
    x, n = F.col("x"), F.col("n")
    out = F.when(n < 5, F.col("v"))
    for w, fits in ((3, n == 5), (5, (n >= 6) & (n <= 7)), (7, n >= 8)):
        base, half = np.vander(np.arange(w), 3), w // 2
        hat = base @ np.linalg.pinv(base)

        def fit(row: int, hat=hat, w=w) -> Column:
            terms = [F.col(f"_{m - row + 6}") * float(hat[row, m]) for m in range(w)]
            return sum(terms[1:], terms[0])

        for k in range(half):
            out = out.when(fits & (x == k), fit(k)).when(fits & (x == n - 1 - k), fit(w - 1 - k))
        out = out.when(fits, fit(half))
    return rows.select("e", "i", "t", "v", out.alias("smooth"))


def _thirds(a: np.ndarray, d: np.ndarray, c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The unknowns of a tridiagonal block as p + q * left + s * right of the unknowns before and behind it."""
    n = len(d)
    out, diag = np.zeros((n, 3)), d.astype(float).copy()
    out[:, 0] = r
    out[0, 1], out[-1, 2] = -a[0], -c[-1]
    for k in range(1, n):
        f = a[k] / diag[k - 1]
        diag[k] -= f * c[k - 1]
        out[k] -= f * out[k - 1]
    out[-1] /= diag[-1]
    for k in range(n - 2, -1, -1):
        out[k] = (out[k] - c[k] * out[k + 1]) / diag[k]
    return out


def _eliminated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each block (a list of its rows) the rows' p, q, s; the block's last unknown stays."""
    for frame in batches:
        for e, i, block, rows in zip(frame["e"], frame["i"], frame["block"], frame["rows"], strict=True):
            x, a, d, c, r = (np.array([y[k] for y in rows]) for k in ("x", "a", "d", "c", "r"))
            out = np.zeros((len(x), 3))
            out[-1, 2] = 1
            if len(x) > 1:
                out[:-1] = _thirds(a[:-1], d[:-1], c[:-1], r[:-1])
            yield pd.DataFrame({"e": e, "i": i, "block": block, "x": x, "p": out[:, 0], "q": out[:, 1], "s": out[:, 2]})


def _borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last unknown of each block of a series, from the rows (block, equation of its last unknown, neighbours' p, q, s)."""
    for frame in batches:
        for e, i, rows in zip(frame["e"], frame["i"], frame["rows"], strict=True):
            block, a, d, c, r = (np.array([y[k] for y in rows], float) for k in ("block", "a", "d", "c", "r"))
            before, behind = (np.array([[z if (z := y[k + m]) is not None else 0.0 for m in "pqs"] for y in rows], float) for k in ("b", "f"))
            low, high = a * before[:, 1], c * behind[:, 2]
            mid, right = d + a * before[:, 2] + c * behind[:, 1], r - a * before[:, 0] - c * behind[:, 0]
            value = _thirds(low, mid, high, right)[:, 0]
            yield pd.DataFrame({"e": e, "i": i, "block": block.astype(int), "right": value, "left": np.append(0.0, value[:-1])})


def knot_polynomials(knots: DataFrame, block: int = BLOCK) -> DataFrame:
    """knots (placed, with u, the time as a number) with base and c0..c3: the not-a-knot cubic spline between a knot and the next is a polynomial
    in u - base; the last knot has that of the stretch before it. Fewer than four knots: straight lines, level behind the last.

    The second derivatives solve a tridiagonal system. Blocks of unknowns are eliminated by themselves up to each one's last; these few form
    a system of the same kind, with a row for each block, and give the rest back.
    """
    order = W.partitionBy(*SERIES, "block").orderBy("x")
    at = lambda c, k: (F.lead(c, k) if k > 0 else F.lag(c, -k)).over(order)
    near = in_blocks(knots.select(*SERIES, "part", "row", "x", "n", "u", "v"), 2, block)
    near = near.withColumns({"h1": F.col("u") - at("u", -1), "h2": at("u", 1) - F.col("u"), "h0": at("u", -1) - at("u", -2), "h3": at("u", 2) - at("u", 1)})
    near = near.withColumns({"s1": (F.col("v") - at("v", -1)) / F.col("h1"), "s2": (at("v", 1) - F.col("v")) / F.col("h2")})
    x, n, h1, h2 = (F.col(c) for c in ("x", "n", "h1", "h2"))
    first, last = x == 1, x == n - 2  # here the end's unknown is replaced by its two neighbours'
    rows = near.where("own and n >= 4 and x > 0 and x < n - 1").select(
        *SERIES, "block", "x", "n",
        F.when(first, 0.0).when(last, h1 - h2 * h2 / h1).otherwise(h1).alias("a"),
        (2 * (h1 + h2) + F.when(first, h1 * (h1 + h2) / h2).otherwise(0.0) + F.when(last, h2 * (h1 + h2) / h1).otherwise(0.0)).alias("d"),
        F.when(last, 0.0).when(first, h2 - h1 * h1 / h2).otherwise(h2).alias("c"), (6 * (F.col("s2") - F.col("s1"))).alias("r"),
    )
    rows = settle(rows, "equations")
    lists = rows.groupBy(*SERIES, "block").agg(F.sort_array(F.collect_list(F.struct("x", "a", "d", "c", "r"))).alias("rows"))  # at most `block` rows
    part = settle(lists.mapInPandas(_eliminated, "e string, i string, block int, x long, p double, q double, s double"), "eliminated")
    ends = part.groupBy(*SERIES, "block").agg(F.max("x").alias("x"), F.count(F.lit(1)).alias("k"), *[F.min_by(c, "x").alias("f" + c) for c in "pqs"])
    inner = part.join(ends.select(*SERIES, "block", (F.col("x") - 1).alias("x")), [*SERIES, "block", "x"]).select(*SERIES, "block", *[F.col(c).alias("b" + c) for c in "pqs"])
    links = ends.select(*SERIES, "block", "x").join(inner, [*SERIES, "block"], "left").join(ends.select(*SERIES, (F.col("block") - 1).alias("block"), "fp", "fq", "fs"), [*SERIES, "block"], "left")
    # a block of one unknown has the one before it as its left neighbour
    links = links.withColumns({"bq": F.when(F.col("bp").isNull(), 1.0).otherwise(F.col("bq")), "bp": F.coalesce("bp", F.lit(0.0)), "bs": F.coalesce("bs", F.lit(0.0))})
    links = links.join(rows.select(*SERIES, "block", "x", "a", "d", "c", "r"), [*SERIES, "block", "x"])
    links = links.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct("block", "a", "d", "c", "r", "bp", "bq", "bs", "fp", "fq", "fs"))).alias("rows"))  # a row for each block
    solved = links.mapInPandas(_borders, "e string, i string, block int, right double, left double")
    second = part.join(solved, [*SERIES, "block"]).select(*SERIES, "x", (F.col("p") + F.col("q") * F.col("left") + F.col("s") * F.col("right")).alias("m"))
    full = in_blocks(knots.select(*SERIES, "part", "row", "x", "n", "u", "v").join(second, [*SERIES, "x"], "left"), 3, block)
    m, u, v = F.col("m"), F.col("u"), F.col("v")
    h = lambda k: at("u", k + 1) - (at("u", k) if k else u)  # noqa: E731  the stretch behind the k-th neighbour
    ends = F.when(x == 0, ((h(0) + h(1)) * at("m", 1) - h(0) * at("m", 2)) / h(1)).when(x == n - 1, ((h(-1) + h(-2)) * at("m", -1) - h(-1) * at("m", -2)) / h(-2))
    full = full.withColumn("m", F.when(n >= 4, F.coalesce(m, ends)))
    slope, gap = (at("v", 1) - v) / h(0), h(0)
    line = {"base": u, "c0": v, "c1": F.when(n < 4, F.coalesce(slope, F.lit(0.0))).otherwise(slope - gap * (2 * F.col("m") + at("m", 1)) / 6), "c2": F.coalesce(F.col("m"), F.lit(0.0)) / 2, "c3": F.when(n < 4, 0.0).otherwise((at("m", 1) - F.col("m")) / (6 * gap))}
    full = full.withColumns({"_" + k: e for k, e in line.items()})
    end = (x == n - 1) & (n >= 4)
    return full.select(*SERIES, "part", "row", "x", "n", "own", "u", "v", *[F.when(end, at("_" + k, -1)).otherwise(F.col("_" + k)).alias(k) for k in line]).where("own").drop("own")


def spline_fill(panel: DataFrame, block: int = BLOCK) -> DataFrame:
    """e, i, t, v, confidence: gaps of each series (e, i, t, v) from the cubic spline through its points, lines for fewer than four.

    Confidence is 1 for real points, else max(0.1, 1 - distance to the nearest / 5); 0.1 for a series of one point, 0 without any. Time is
    year + month / 12.
    """
    every = placed(panel.select("e", "i", "t", F.col("v").cast("double").alias("v"), (F.year("t") + F.month("t") / 12).alias("u"))).drop("x", "n")
    real = every.where("v is not null").withColumns({"_part": F.col("part"), "_row": F.col("row")}).drop("part", "row")
    real = placed(real).drop("part", "row").withColumnsRenamed({"_part": "part", "_row": "row"})
    poly = settle(knot_polynomials(real, block), "polynomials")
    knot = F.when(F.col("base").isNotNull(), F.struct("u", "v", "base", "c0", "c1", "c2", "c3", "n"))
    rows = every.join(poly.select("part", "row", "base", "c0", "c1", "c2", "c3", "n"), ["part", "row"], "left").withColumn("k", knot)
    # the nearest knots in the row's own partition, or else in the partitions before and behind
    own = rows.where("k is not null").groupBy(*SERIES, "part").agg(F.min_by("k", "row").alias("lo"), F.max_by("k", "row").alias("hi"))
    own = rows.select(*SERIES, "part").distinct().join(own, [*SERIES, "part"], "left")
    parts = W.partitionBy(*SERIES).orderBy("part")  # a row for each partition of a series
    own = own.select(*SERIES, "part", F.last("hi", True).over(parts.rowsBetween(W.unboundedPreceding, -1)).alias("hi"), F.first("lo", True).over(parts.rowsBetween(1, W.unboundedFollowing)).alias("lo"))
    inside = W.partitionBy(*SERIES, "part").orderBy("row")
    rows = rows.join(own, [*SERIES, "part"])
    rows = rows.withColumns({"l": F.coalesce(F.last("k", True).over(inside.rowsBetween(W.unboundedPreceding, 0)), "hi"), "f": F.coalesce(F.first("k", True).over(inside.rowsBetween(0, W.unboundedFollowing)), "lo")})
    use, count = F.coalesce("l", "f"), F.coalesce(F.col("l.n"), F.col("f.n"), F.lit(0))
    d = F.col("u") - use["base"]
    value = F.when(F.col("v").isNotNull(), F.col("v")).when((count < 4) & F.col("l").isNull(), F.col("f.v")).otherwise(use["c0"] + d * (use["c1"] + d * (use["c2"] + d * use["c3"])))
    near = F.least(F.col("u") - F.col("l.u"), F.col("f.u") - F.col("u"))
    sure = F.when(F.col("v").isNotNull(), 1.0).when(count == 0, 0.0).when(count == 1, 0.1).otherwise(F.greatest(F.lit(0.1), 1 - near / 5))
    return rows.select("e", "i", "t", value.alias("v"), sure.alias("confidence"))
