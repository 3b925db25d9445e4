"""Nearest neighbours in the plane, by cells of a tree as join keys.

Equal points are one location. Locations are cut at approximate quantiles, by x and y in turn, until no cell holds more than `block` of
them. A location's k-th neighbour inside its own cell bounds how far it must look; the tree tells which other cells its square of that size
reaches, so only locations near a border meet other cells, and a cell meets only those that reach it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .tables import settle

CUTS = 16
#: Rounding of distances, after which ties go to the smaller key.
DIGITS = 6
_SLACK = 1e-5
#: Locations that ask a cell at once.
ASKED = 2000


def _child(node: Column, place: Column) -> Column:
    return node * CUTS + place


def _below(edges: str, value: Column) -> Column:
    return F.size(F.filter(edges, lambda c: c < value))


def cells(points: DataFrame, block: int) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """points (x, y, distinct) with their cell, and the tree: for each level its axis and (cell, edges) of the cells that are cut."""
    placed, tree = settle(points.withColumn("cell", F.lit(0).cast("long")), "placed"), []
    while True:
        sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
        if sizes.isEmpty():
            return placed, tree
        axis = "xy"[len(tree) % 2]
        large = placed.join(F.broadcast(sizes.select("cell")), "cell", "left_semi")  # a row for each `block` points at most
        edges = settle(large.groupBy("cell").agg(F.percentile_approx(axis, [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("edges")), "edges")
        tree.append((axis, edges))
        place = F.when(F.col("edges").isNull(), 0).otherwise(_below("edges", F.col(axis)))
        placed = settle(placed.join(edges, "cell", "left").withColumn("cell", _child(F.col("cell"), place)).drop("edges"), "placed")


def reached(asked: DataFrame, tree: list[tuple[str, DataFrame]]) -> DataFrame:
    """asked (x, y, r) with each cell that the square of half width r around (x, y) reaches."""
    out = asked.withColumn("cell", F.lit(0).cast("long"))
    for axis, edges in tree:
        both = out.join(edges, "cell", "left")
        first, last = _below("edges", F.col(axis) - F.col("r")), _below("edges", F.col(axis) + F.col("r"))
        places = F.when(F.col("edges").isNull(), F.array(F.lit(0))).otherwise(F.sequence(first, last))
        out = both.withColumn("place", F.explode(places)).withColumn("cell", _child(F.col("cell"), F.col("place"))).drop("edges", "place")
    return out


def _near(asked: np.ndarray, own: np.ndarray, k: int, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in asked and own of the k nearest and all that tie with the last of them, their distances, and each one's k-th distance."""
    d = np.hypot(asked[:, 0, None] - own[None, :, 0], asked[:, 1, None] - own[None, :, 1])
    last = np.partition(d, k - 1, axis=1)[:, k - 1] if len(own) >= k else np.full(len(asked), np.inf)
    i, j = np.nonzero(d <= (np.minimum(last, most) if most is not None else last)[:, None] + _SLACK)
    return i, j, d[i, j], last


def nearest_peers(points: DataFrame, k: int = 4, block: int = 1000) -> DataFrame:
    """key, peer, place: the k nearest others of each point (key, x, y) by rounded distance, then key. Points with a null coordinate have no peers and are none."""
    points = settle(points.where("key is not null and x is not null and y is not null").select("key", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "points")
    # of a location only the k + 1 smallest keys can be anyone's peers
    among = F.row_number().over(W.partitionBy("x", "y").orderBy("key"))
    named = settle(points.withColumn("m", among).where(F.col("m") <= k + 1).groupBy("x", "y").agg(F.sort_array(F.collect_list("key")).alias("keys")), "locations")
    placed, tree = cells(named.select("x", "y"), block)
    held = settle(placed.groupBy("cell").agg(F.collect_list(F.struct("x", "y")).alias("own")), "cells")  # `block` locations at most

    def array(rows) -> np.ndarray:
        return np.array([(r["x"], r["y"]) for r in rows], float).reshape(-1, 2)

    def pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, r: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"x": a[i, 0], "y": a[i, 1], "px": b[j, 0], "py": b[j, 1], "d": d, "r": r[i]})

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for own in map(array, frame["own"]):
                for at in range(0, len(own), ASKED):
                    a = own[at : at + ASKED]
                    i, j, d, last = _near(a, own, k + 1, None)
                    yield pairs(a, own, i, j, d, last)

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for asked, own in zip(frame["asked"], map(array, frame["own"]), strict=True):
                a, r = array(asked), np.array([x["r"] for x in asked], float)
                i, j, d, _ = _near(a, own, k + 1, r)
                yield pairs(a, own, i, j, d, r)

    schema = "x double, y double, px double, py double, d double, r double"
    first = settle(held.select("own").mapInPandas(inside, schema), "inside")
    asking = first.groupBy("x", "y").agg((F.max("r") + _SLACK).alias("r")).join(placed.withColumnRenamed("cell", "home"), ["x", "y"])
    others = reached(asking, tree).where("cell <> home")
    lists = others.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(64))).groupBy("cell", "part").agg(F.collect_list(F.struct("x", "y", "r")).alias("asked"))
    chunks = lists.select("cell", F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("asked") - 1) / ASKED).cast("int")), lambda c: F.slice("asked", c * ASKED + 1, F.lit(ASKED)))).alias("asked"))
    more = chunks.join(held, "cell").select("asked", "own").mapInPandas(across, schema)
    met = first.unionByName(more).select("x", "y", "px", "py", F.round("d", DIGITS).alias("d"))
    # the best k + 1 of a location, its own keys among them; each of its points leaves itself out
    peers = met.join(named.select(F.col("x").alias("px"), F.col("y").alias("py"), "keys"), ["px", "py"]).select("x", "y", "d", F.explode("keys").alias("peer"))
    best = peers.withColumn("m", F.row_number().over(W.partitionBy("x", "y").orderBy("d", "peer"))).where(F.col("m") <= k + 1)
    best = best.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("d", "peer"))).alias("best"))
    each = points.join(best, ["x", "y"]).select("key", F.slice(F.filter("best", lambda b: b["peer"] != F.col("key")), 1, k).alias("best"))
    return each.select("key", F.posexplode("best").alias("place", "b")).select("key", F.col("b.peer").alias("peer"), (F.col("place") + 1).cast("long").alias("place"))
