"""Points and ranges against many spans, without pairing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .quantiles import CUTS, MOST, running


def overlaps(asked: DataFrame, spans: DataFrame, by: Sequence[str] = ("e",), most: int = MOST, cuts: int = CUTS) -> DataFrame:
    """asked (by..., lo, hi, others) with n_spans: how many spans (by..., start, end; both ends included) of the same group each range lo..hi meets.

    These are the spans that start at or before hi without those that end before lo. So no range meets any span: starts, ends and the asked
    places are counted place by place, and running sums over a group's places answer all ranges. A group with a million spans or ranges is ordered
    by levels of bins like any large group (see `running`). asked is read twice: settle it where it is dear. Rows with a null in by, lo or hi meet none; spans with a null, or that end before they start, don't count.
    """
    by = list(by)
    whole = spans.where("start <= end")
    there = lambda x, at, s, e: x.select(*by, F.col(at).cast("double").alias("_at"), F.lit(s).alias("s"), F.lit(e).alias("e_"))
    places = there(whole, "start", 1, 0).unionByName(there(whole, "end", 0, 1)).unionByName(there(asked, "lo", 0, 0)).unionByName(there(asked, "hi", 0, 0))
    for x in (*by, "_at"):
        places = places.where(F.col(x).isNotNull())
    counts = running(places.groupBy(*by, "_at").agg(F.sum("s").alias("_s"), F.sum("e_").alias("_e")), "_at", ["_s", "_e"], by, most, cuts)
    counts = counts.select(*by, "_at", (F.col("before__s") + F.col("_s")).alias("_started"), F.col("before__e").alias("_ended"))
    low = counts.select(*by, F.col("_at").alias("_lo"), "_ended")
    high = counts.select(*by, F.col("_at").alias("_hi"), "_started")
    rows = asked.withColumns({"_lo": F.col("lo").cast("double"), "_hi": F.col("hi").cast("double")}).join(low, [*by, "_lo"], "left").join(high, [*by, "_hi"], "left")
    return rows.select(*asked.columns, F.coalesce(F.col("_started") - F.col("_ended"), F.lit(0)).alias("n_spans"))
