"""Queries on panels: latest values, coverage, trends, ranks, gaps."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import intervals, panel as p
from .adapters import IV, PN, PU, error_spans, nation_panel, query, rounded, table, user_panel

EVENTS = ("click", "error", "purchase", "signup", "view")
INDICATORS = ("price", "quantity", "discount", "tax", "returned")
LATEST = "la AS (SELECT e, i, arg_max(v, t) AS v, year(max(t))::INT AS year FROM pn GROUP BY e, i)"
PCT = "pc AS (SELECT e, i, v, (rank() OVER (PARTITION BY i ORDER BY v) + (count(*) OVER (PARTITION BY i, v) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY i) AS pct FROM la)"
ECON, INDUSTRY = {"price": 1.0, "quantity": 0.8, "returned": -1.0}, {"discount": -0.5, "tax": -1.0, "quantity": 1.0}
SCORES = """ec AS (SELECT e, avg(CASE i WHEN 'price' THEN pct * 100 * 1.0::DOUBLE WHEN 'quantity' THEN pct * 100 * 0.8::DOUBLE WHEN 'returned' THEN (1 - pct) * 100 * 1.0::DOUBLE END) AS econ FROM pc WHERE i IN ('price', 'quantity', 'returned') GROUP BY e),
ind AS (SELECT e, avg(CASE i WHEN 'discount' THEN (1 - pct) * 100 * 0.5::DOUBLE WHEN 'tax' THEN (1 - pct) * 100 * 1.0::DOUBLE WHEN 'quantity' THEN pct * 100 * 1.0::DOUBLE END) AS industry FROM pc WHERE i IN ('discount', 'tax', 'quantity') GROUP BY e)"""


@query("l1_latest", "SELECT e, i, round(v, 6) + 0.0 AS v, year FROM la", PN, LATEST)
def l1(spark, d):
    return rounded(p.latest(nation_panel(spark, d)))


@query("l1_latest_as_of", "SELECT e, i, round(arg_max(v, t), 6) + 0.0 AS v, year(max(t))::INT AS year FROM pn WHERE year(t) <= 1997 GROUP BY e, i", PN)
def l1_as_of(spark, d):
    return rounded(p.latest(nation_panel(spark, d), as_of_year=1997))


@query("l2_mapped_features", """SELECT e, round(max(v) FILTER (i = 'price'), 6) AS mean_price, round(max(v) FILTER (i = 'tax'), 6) AS mean_tax,
  max(year) FILTER (i = 'price') AS mean_price_year, max(year) FILTER (i = 'tax') AS mean_tax_year FROM la WHERE i IN ('price', 'tax') GROUP BY e""", PN, LATEST)
def l2(spark, d):
    return rounded(p.widen(p.latest(nation_panel(spark, d)), {"price": "mean_price", "tax": "mean_tax"}))


@query("l5_covered_matrix", "SELECT e, " + ", ".join(f"round(max(v) FILTER (c = 'user_{x}'), 6) + 0.0 AS user_{x}" for x in EVENTS) + ", " + ", ".join(f"round(max(v) FILTER (c = 'nation_{x}'), 6) + 0.0 AS nation_{x}" for x in INDICATORS) + """
  FROM (SELECT e, 'user_' || i AS c, arg_max(v, t) AS v, count(DISTINCT e) OVER (PARTITION BY i) AS n, 10 AS least FROM pu GROUP BY e, i UNION ALL SELECT e, 'nation_' || i, arg_max(v, t), count(DISTINCT e) OVER (PARTITION BY i), 20 FROM pn GROUP BY e, i) WHERE n >= least GROUP BY e""", PU, PN)
def l5(spark, d):
    """All indicators that enough entities have, by dataset, each with its own bound; the columns are those that there are."""
    return rounded(p.covered_matrix([("user", p.latest(user_panel(spark, d)), 10), ("nation", p.latest(nation_panel(spark, d)), 20)]))


@query("l6_period_matrix", "SELECT e, t, " + ", ".join(f"round(avg(v) FILTER (c = 'n_{x}'), 6) + 0.0 AS n_{x}" for x in INDICATORS) + ", " + ", ".join(f"round(avg(v) FILTER (c = 'o_{x}'), 6) + 0.0 AS o_{x}" for x in ("1-URGENT", "5-LOW")).replace("o_1-URGENT,", '"o_1-URGENT",').replace("AS o_5-LOW", 'AS "o_5-LOW"') + """
  FROM (SELECT e, t, 'n_' || i AS c, v FROM pn UNION ALL SELECT n_name, make_date(year(o_orderdate), quarter(o_orderdate) * 3, 1), 'o_' || o_orderpriority, 1.0 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND year(o_orderdate) >= 1996) GROUP BY e, t""", PN)
def l6(spark, d):
    """Two datasets on one (entity, period) grid, prefixed, all indicators that there are, in order."""
    nations = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("e"))
    orders = table(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '5-LOW') and year(o_orderdate) >= 1996").join(nations, F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.select("e", F.make_date(F.year("o_orderdate"), F.quarter("o_orderdate") * 3, F.lit(1)).alias("t"), F.col("o_orderpriority").alias("i"), F.lit(1.0).alias("v"))
    return rounded(p.period_matrix([("n", nation_panel(spark, d)), ("o", orders)]))


@query("l8_annual_resample", """SELECT e, i, year::INT AS year, round(v, 6) + 0.0 AS v, t FROM (SELECT *, max(t) OVER (PARTITION BY e, i) AS l FROM (SELECT e, i, year(t) AS year, arg_max(v, t) AS v, max(t) AS t FROM pn GROUP BY ALL)) WHERE t >= l - INTERVAL 60 MONTH""", PN)
def l8(spark, d):
    return rounded(p.last_years(nation_panel(spark, d), 5))


@query("l10_ratio_of_latest_pair", """SELECT e, round(r, 6) AS r, year, CASE WHEN r > 200 THEN 'UNUSUAL' WHEN r < 30 THEN 'UNDER_PROVISIONED' ELSE 'OK' END AS flag FROM
  (SELECT a.e, arg_max(a.v / b.v * 100, a.t) AS r, year(max(a.t))::INT AS year FROM pn a JOIN pn b ON a.e = b.e AND a.t = b.t AND a.i = 'tax' AND b.i = 'discount' WHERE b.v > 0 GROUP BY a.e)""", PN)
def l10(spark, d):
    from ..functions.columns import ratio_flag

    both = nation_panel(spark, d).where("i in ('tax', 'discount')").groupBy("e", "t").pivot("i", ["tax", "discount"]).agg(F.first("v")).where("tax is not null and discount > 0")
    last = both.groupBy("e").agg(F.max_by(F.col("tax") / F.col("discount") * 100, "t").alias("r"), F.year(F.max("t")).alias("year"))
    return rounded(last.withColumn("flag", ratio_flag(F.col("r"))))


@query("l11_aligned_difference", """SELECT e, t, round(x, 6) + 0.0 AS diff FROM (SELECT a.e, a.t, a.v - b.v AS x, row_number() OVER (PARTITION BY a.e ORDER BY a.t DESC) AS k FROM pn a JOIN pn b ON a.e = b.e AND a.t = b.t AND a.i = 'discount' AND b.i = 'tax') WHERE k <= 3""", PN)
def l11(spark, d):
    both = nation_panel(spark, d).where("i in ('tax', 'discount')").groupBy("e", "t").pivot("i", ["tax", "discount"]).agg(F.first("v")).where("tax is not null and discount is not null")
    k = F.row_number().over(W.partitionBy("e").orderBy(F.desc("t")))
    return rounded(both.withColumn("k", k).where("k <= 3").select("e", "t", (F.col("discount") - F.col("tax")).alias("diff")))


@query("a1_entity_coverage", "SELECT e, count(DISTINCT i) AS n_i, min(t) AS first_t, max(t) AS last_t, count(*) AS n_rows FROM pu GROUP BY e", PU)
def a1(spark, d):
    return p.coverage(user_panel(spark, d), "e", other="i")


@query("a2_indicator_coverage", "SELECT i, count(DISTINCT e) AS n_e, min(t) AS first_t, max(t) AS last_t, count(*) AS n_rows FROM pu GROUP BY i", PU)
def a2(spark, d):
    return p.coverage(user_panel(spark, d), "i", other="e")


@query("a3_indicator_summary", "SELECT i, count(DISTINCT e) AS n_e, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) + 0.0 AS lo, round(max(v), 6) AS hi, max(t) AS last_t FROM pu GROUP BY i ORDER BY n_e DESC, i LIMIT 10", PU)
def a3(spark, d):
    s = user_panel(spark, d).groupBy("i").agg(F.countDistinct("e").alias("n_e"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("t").alias("last_t"))
    return rounded(s.orderBy(F.desc("n_e"), "i").limit(10))


@query("a5_size_summary", "SELECT CASE WHEN grouping(ds) = 1 THEN 'total' ELSE ds END AS ds, count(*) AS n_rows, count(DISTINCT e) AS n_e, count(DISTINCT i) AS n_i FROM (SELECT 'nation' AS ds, e, i FROM pn UNION ALL SELECT 'user', e, i FROM pu) GROUP BY ROLLUP (ds)", PN, PU)
def a5(spark, d):
    both = nation_panel(spark, d).select(F.lit("nation").alias("ds"), "e", "i").unionByName(user_panel(spark, d).select(F.lit("user").alias("ds"), "e", "i"))
    return both.rollup("ds").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("e").alias("n_e"), F.countDistinct("i").alias("n_i")).select(F.coalesce("ds", F.lit("total")).alias("ds"), "n_rows", "n_e", "n_i")


@query("w1_percentile_rank", "SELECT e, i, round(v, 6) + 0.0 AS v, round(pct, 6) AS pct FROM pc", PN, LATEST, PCT)
def w1(spark, d):
    return rounded(p.percentile_rank(p.latest(nation_panel(spark, d))).select("e", "i", "v", "pct"))


@query("w2_economic_score", "SELECT e, round(econ, 6) AS econ FROM ec", PN, LATEST, PCT, SCORES)
def w2e(spark, d):
    return rounded(p.weighted_percentiles(p.latest(nation_panel(spark, d)), ("econ", ECON)))


@query("w2_industry_score", "SELECT e, round(industry, 6) AS industry FROM ind", PN, LATEST, PCT, SCORES)
def w2i(spark, d):
    return rounded(p.weighted_percentiles(p.latest(nation_panel(spark, d)), ("industry", INDUSTRY)))


@query("w4_composite_score", """SELECT e, round(econ, 6) AS econ, round(industry, 6) AS industry, round(c, 1) AS composite,
  CASE WHEN c >= 80 THEN 'Very Low Risk' WHEN c >= 65 THEN 'Low Risk' WHEN c >= 50 THEN 'Moderate Risk' WHEN c >= 35 THEN 'High Risk' ELSE 'Very High Risk' END AS tier
  FROM (SELECT *, round((econ + industry) / 2, 6) AS c FROM (SELECT coalesce(ec.e, ind.e) AS e, coalesce(econ, 50) AS econ, coalesce(industry, 50) AS industry FROM ec FULL JOIN ind ON ec.e = ind.e))""", PN, LATEST, PCT, SCORES)
def w4(spark, d):
    from ..functions.columns import tier_from

    last = p.latest(nation_panel(spark, d))
    both = p.weighted_percentiles(last, ("econ", ECON), ("industry", INDUSTRY)).fillna(50.0, ["econ", "industry"])
    c = both.withColumn("c", F.round((F.col("econ") + F.col("industry")) / 2, 6))
    names = ["Very Low Risk", "Low Risk", "Moderate Risk", "High Risk", "Very High Risk"]
    return rounded(c.select("e", "econ", "industry", F.round("c", 1).alias("composite"), tier_from(F.col("c"), (80, 65, 50, 35), names).alias("tier")))


@query("w5_peer_comparison", """SELECT pc.e, pc.i, round(pct * 100, 6) AS percentile, n, round(lo, 6) AS lo, round(hi, 6) AS hi, round(med, 6) AS med, round(mean, 6) AS mean, round(v - med, 6) + 0.0 AS from_median
  FROM pc JOIN (SELECT i, count(*) AS n, min(v) AS lo, max(v) AS hi, median(v) AS med, avg(v) AS mean FROM la GROUP BY i) s ON pc.i = s.i""", PN, LATEST, PCT)
def w5(spark, d):
    last = p.settle(p.latest(nation_panel(spark, d)), "latest")
    peers = last.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    peers = peers.join(p.quantiles(last, "v", {"med": 0.5}, ["i"]), "i")
    return rounded(p.percentile_rank(last).join(peers, "i").select("e", "i", (F.col("pct") * 100).alias("percentile"), "n", "lo", "hi", "med", "mean", (F.col("v") - F.col("med")).alias("from_median")))


TREND = """nu AS (SELECT e, i, t, v, (row_number() OVER (PARTITION BY e, i ORDER BY t) - 1)::DOUBLE AS x, count(*) OVER (PARTITION BY e, i) AS n FROM pu),
tr AS (SELECT e, i, max(n) AS n, regr_slope(v, x) AS slope, regr_r2(v, x) AS r2, avg(v) AS mean, stddev_pop(v) AS std, arg_min(v, x) AS first_v, arg_max(v, x) AS last_v, min(v) AS min_v, max(v) AS max_v,
  avg(v) FILTER (n - x <= 3) AS a, avg(v) FILTER (n - x > 3 AND n - x <= 6) AS b FROM nu WHERE n >= 4 GROUP BY e, i),
tq AS (SELECT *, CASE WHEN mean <> 0 THEN slope / abs(mean) * 100 END AS slope_pct FROM tr)"""


@query("w6_trend", """SELECT e, i, n, round(slope, 6) + 0.0 AS slope, round(r2, 6) AS r2, round(mean, 6) AS mean, round(slope_pct, 6) + 0.0 AS slope_pct, round(CASE WHEN mean <> 0 THEN std / abs(mean) * 100 END, 6) AS cv_pct,
  round(CASE WHEN n >= 6 AND b <> 0 THEN (a - b) / abs(b) * 100 END, 6) + 0.0 AS momentum, round(first_v, 6) AS first_v, round(last_v, 6) AS last_v, round(min_v, 6) AS min_v, round(max_v, 6) AS max_v,
  CASE WHEN abs(slope_pct) < 1 THEN 'stable' WHEN slope > 0 THEN 'improving' ELSE 'declining' END AS trend FROM tq""", PU, TREND)
def w6(spark, d):
    return rounded(p.trends(user_panel(spark, d)).select("e", "i", "n", "slope", "r2", "mean", "slope_pct", "cv_pct", "momentum", "first_v", "last_v", "min_v", "max_v", "trend"))


@query("w7_anomalies", """SELECT e, i, t, round(v, 6) AS v, round(z, 6) AS z, CASE WHEN z > 0 THEN 'high' ELSE 'low' END AS kind FROM
  (SELECT *, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z, count(*) OVER w AS n FROM pu WINDOW w AS (PARTITION BY e, i)) WHERE n >= 4 AND abs(z) > 2.5""", PU)
def w7(spark, d):
    return rounded(p.anomalies(user_panel(spark, d)))


@query("w8_deterioration", """SELECT e, i, n, round(slope, 6) + 0.0 AS slope, round(std, 6) AS std, CASE WHEN abs(slope) > std THEN 'High' ELSE 'Medium' END AS severity FROM
  (SELECT e, i, count(*) AS n, regr_slope(v, -b::DOUBLE) AS slope, stddev_pop(v) AS std FROM (SELECT *, row_number() OVER (PARTITION BY e, i ORDER BY t DESC) AS b FROM pu) WHERE b <= 4 GROUP BY e, i)
  WHERE n = 4 AND abs(slope) > 0.1 * std AND CASE WHEN i = 'error' THEN slope > 0 ELSE slope < 0 END""", PU)
def w8(spark, d):
    return rounded(p.deterioration(user_panel(spark, d), ["error"]))


@query("w9_ranked_deterioration", """SELECT e, i, round(slope_pct, 6) AS slope_pct, k FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY abs(round(slope_pct, 6)) DESC, i) AS k FROM tq WHERE slope_pct < -1)""", PU, TREND)
def w9(spark, d):
    k = F.row_number().over(W.partitionBy("e").orderBy(F.desc(F.abs(F.round("slope_pct", 6))), "i"))
    return rounded(p.trends(user_panel(spark, d)).where("slope_pct < -1").withColumn("k", k.cast("long")).select("e", "i", "slope_pct", "k"))


@query("w10_moving_average", "SELECT e, i, t, round(avg(v) OVER (PARTITION BY e, i ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) + 0.0 AS ma FROM pu", PU)
def w10(spark, d):
    return rounded(p.moving_average(user_panel(spark, d), 4).select("e", "i", "t", "ma"))


@query("w11_exponential_average", """, nr AS (SELECT e, i, t, v, row_number() OVER (PARTITION BY e, i ORDER BY t) AS k FROM pn),
  r AS (SELECT e, i, t, k, v AS ema FROM nr WHERE k = 1 UNION ALL SELECT n.e, n.i, n.t, n.k, 0.6::DOUBLE * r.ema + 0.4::DOUBLE * n.v FROM r JOIN nr n ON n.e = r.e AND n.i = r.i AND n.k = r.k + 1) SELECT e, i, t, round(ema, 6) + 0.0 AS ema FROM r""".replace(", nr", ", nr", 1), "RECURSIVE " + PN)
def w11(spark, d):
    return rounded(p.exponential_average(nation_panel(spark, d), 4).select("e", "i", "t", "ema"))


@query("w11_adjusted_average", """, nr AS (SELECT e, i, t, v, row_number() OVER (PARTITION BY e, i ORDER BY t) AS k FROM pn),
  r AS (SELECT e, i, t, k, v AS num, 1.0::DOUBLE AS den FROM nr WHERE k = 1 UNION ALL SELECT n.e, n.i, n.t, n.k, 0.5::DOUBLE * r.num + n.v, 0.5::DOUBLE * r.den + 1 FROM r JOIN nr n ON n.e = r.e AND n.i = r.i AND n.k = r.k + 1) SELECT e, i, t, round(num / den, 6) + 0.0 AS ema FROM r""", "RECURSIVE " + PN)
def w11a(spark, d):
    return rounded(p.exponential_average(nation_panel(spark, d), 3, adjusted=True).select("e", "i", "t", "ema"))


@query("w12_crossovers", """SELECT e, i, t, round(d, 6) + 0.0 AS d, CASE WHEN was <= 0 AND d > 0 THEN 'bullish' ELSE 'bearish' END AS signal FROM
  (SELECT *, lag(d) OVER (PARTITION BY e, i ORDER BY t) AS was, row_number() OVER (PARTITION BY e, i ORDER BY t) - 1 AS k FROM
   (SELECT e, i, t, avg(v) OVER (PARTITION BY e, i ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) - avg(v) OVER (PARTITION BY e, i ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS d FROM pu))
  WHERE k > 8 AND ((was <= 0 AND d > 0) OR (was >= 0 AND d < 0))""", PU)
def w12(spark, d):
    return rounded(p.crossovers(user_panel(spark, d)))


@query("w14_rankings", """SELECT e, round(econ, 6) AS econ, row_number() OVER (ORDER BY round(econ, 6) DESC, e) AS from_top, row_number() OVER (ORDER BY round(econ, 6), e) AS from_bottom, round((rank() OVER (ORDER BY round(econ, 6)) - 1)::DOUBLE / count(*) OVER (), 6) AS share_below FROM ec ORDER BY econ DESC, e LIMIT 10""", PN, LATEST, PCT, SCORES)
def w14(spark, d):
    s = rounded(p.weighted_percentiles(p.latest(nation_panel(spark, d)), ("econ", ECON)))
    counts = p.running(s.groupBy("econ").agg(F.count(F.lit(1)).alias("c")), "econ", ["c"])
    among = F.row_number().over(W.partitionBy("econ").orderBy("e"))
    top = s.join(counts, "econ").withColumn("k", among.cast("long")).orderBy(F.desc("econ"), "e").limit(10)
    return rounded(top.select("e", "econ", (F.col("all_c") - F.col("before_c") - F.col("c") + F.col("k")).alias("from_top"), (F.col("before_c") + F.col("k")).alias("from_bottom"), (F.col("before_c") / F.col("all_c")).alias("share_below")))


@query("i1_gap_fill", """SELECT e, i, t, round(CASE WHEN v IS NOT NULL THEN v WHEN k = 1 THEN coalesce(l.v, f.v) WHEN l IS NOT NULL AND f IS NOT NULL THEN l.v + (f.v - l.v) * (x - l.x) / (f.x - l.x)
  WHEN l IS NOT NULL THEN l.ov + (l.v - l.ov) * (x - l.ox) / (l.x - l.ox) WHEN f IS NOT NULL THEN f.v + (f.ov - f.v) * (x - f.x) / (f.ox - f.x) END, 6) + 0.0 AS v,
  round(CASE WHEN v IS NOT NULL THEN 1.0 WHEN k = 0 THEN 0.0 WHEN k = 1 THEN 0.1 ELSE greatest(0.1, 1 - least(coalesce(x - l.x, 1e9), coalesce(f.x - x, 1e9)) / 5) END, 6)::DOUBLE AS confidence FROM
  (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {'x': x, 'v': v, 'ox': px, 'ov': pv} END IGNORE NULLS) OVER (PARTITION BY e, i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l,
    first_value(CASE WHEN v IS NOT NULL THEN {'x': x, 'v': v, 'ox': nx, 'ov': nv} END IGNORE NULLS) OVER (PARTITION BY e, i ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM
   (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER b AS px, last_value(v IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN v IS NOT NULL THEN x END IGNORE NULLS) OVER a AS nx, first_value(v IGNORE NULLS) OVER a AS nv, count(v) OVER (PARTITION BY e, i) AS k FROM
    (SELECT g.i, g.t, z.e, h.v, year(g.t) + month(g.t) / 12::DOUBLE AS x FROM (SELECT DISTINCT i, t FROM ps) g CROSS JOIN (SELECT DISTINCT e FROM ps) z LEFT JOIN ps h ON h.e = z.e AND h.i = g.i AND h.t = g.t)
    WINDOW b AS (PARTITION BY e, i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY e, i ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)))""", PN, "ps AS (SELECT * FROM pn WHERE (length(e) + month(t) + year(t)) % 3 <> 0)")
def i1(spark, d):
    sparse = nation_panel(spark, d).where((F.length("e") + F.month("t") + F.year("t")) % 3 != 0)
    return rounded(p.fill_gaps(sparse))


@query("j5_horizon_label", "SELECT u.e, y.y, max(CASE WHEN s <= y.y + 3 AND z >= y.y + 1 THEN 1 ELSE 0 END) AS label FROM (SELECT DISTINCT e FROM iv) u CROSS JOIN (SELECT DISTINCT s - 2 AS y FROM iv) y JOIN iv ON iv.e = u.e GROUP BY 1, 2", IV)
def j5(spark, d):
    """Each entity and each asked day: the result has as many rows as there are pairs of these."""
    spans = p.settle(error_spans(spark, d), "spans")
    asked = spans.select("e").distinct().crossJoin(spans.select((F.col("start") - 2).alias("y")).distinct())
    found = intervals.overlaps(asked.withColumns({"lo": F.col("y") + 1, "hi": F.col("y") + 3}), spans)
    return found.select("e", "y", (F.col("n_spans") > 0).cast("int").alias("label"))


@query("j6_in_event", "SELECT DISTINCT o.e, o.d FROM (SELECT user_id AS e, (ts::DATE - DATE '2020-01-01')::INT AS d FROM events WHERE event_type = 'purchase') o JOIN iv ON iv.e = o.e AND o.d BETWEEN s AND z", IV)
def j6(spark, d):
    asked = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("e"), F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("d")).distinct()
    found = intervals.overlaps(asked.withColumns({"lo": F.col("d"), "hi": F.col("d")}), error_spans(spark, d))
    return found.where("n_spans > 0").select("e", "d")


@query("j7_overlapping_entities", "SELECT DISTINCT e FROM iv WHERE s <= (SELECT min(s) + 5 FROM iv) AND z >= (SELECT min(s) + 3 FROM iv)", IV)
def j7(spark, d):
    spans = error_spans(spark, d)
    first = F.broadcast(spans.agg(F.min("start").alias("m")))
    return spans.join(first, (F.col("start") <= F.col("m") + 5) & (F.col("end") >= F.col("m") + 3)).select("e").distinct()


@query("j8_exploded_events", "SELECT e, s AS start, z AS \"end\", unnest(generate_series(s, z))::INT AS d FROM iv", IV)
def j8(spark, d):
    return error_spans(spark, d).select("e", "start", "end", F.explode(F.sequence("start", "end")).alias("d"))


@query("a17_event_summary", "SELECT e, count(*) AS n_events, sum(z - s + 1)::BIGINT AS days, min(s) AS first_start, max(z) AS last_end FROM iv GROUP BY e", IV)
def a17(spark, d):
    return error_spans(spark, d).groupBy("e").agg(F.count(F.lit(1)).alias("n_events"), F.sum(F.col("end") - F.col("start") + 1).alias("days"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
