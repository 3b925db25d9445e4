"""Queries that need files, numpy helpers or pyspark.ml."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window as W, functions as F

from ..functions import columns as c
from ..operators import gram, helpers as h, names, nearest, neighbours, panel as p
from ..sources import files
from ..sources.files import scratch
from .adapters import DIMENSIONS, FEATURES, IV, PD, PN, PU, XL, XS, dimension_panel, error_spans, long_features, nation_panel, query, rounded, supplier_features, table, user_panel
from .series import ECON, INDUSTRY, LATEST, PCT, SCORES


# sources and sinks


def write_wide(spark, d) -> str:
    """The nation panel as wide CSV files of two kinds: until 1995, and after it without units, in another order of columns and with a byte-order mark."""
    x = nation_panel(spark, d).withColumn("period", F.concat(F.year("t").cast("string"), F.lit("-Q"), F.quarter("t").cast("string")))
    number = F.split_part("e", F.lit("_"), F.lit(2))
    x = x.withColumns({"series_key": F.concat(F.lpad(number, 3, "0"), F.lit("."), "i"), "COUNTRY": F.initcap(F.replace("e", F.lit("_"), F.lit(" "))), "INDICATOR": F.concat(F.lit("Mean "), "i"), "UNIT": F.when(F.col("i") == "price", "US dollar")})
    x, path = p.settle(x, "panel"), scratch(spark, "wide")
    periods = sorted(r["period"] for r in x.select("period").distinct().collect())  # the columns
    early = x.where("year(t) <= 1995").groupBy(F.lit("PN").alias("DATASET"), "series_key", "COUNTRY", "INDICATOR", "UNIT").pivot("period", [y for y in periods if y < "1996"]).agg(F.first("v"))
    late = x.where("year(t) > 1995").groupBy("INDICATOR", "series_key", "COUNTRY").pivot("period", [y for y in periods if y > "1996"]).agg(F.first("v")).withColumnRenamed("INDICATOR", "\ufeffINDICATOR")
    files.write_csv(early, f"{path}/early")
    files.write_csv(late, f"{path}/late")
    return path


@query("s1_read_wide_csv", "SELECT lpad(split_part(e, '_', 2), 3, '0') AS e, i, 'Nation ' || split_part(e, '_', 2) AS entity_name, 'Mean ' || i AS indicator_name, CASE WHEN i = 'price' AND year(t) <= 1995 THEN 'US dollar' ELSE '' END AS unit, 'Quarterly' AS freq, t, round(v, 6) + 0.0 AS v, 'pn' AS dataset FROM pn", PN)
def s1(spark, d):
    """Files with different periods, columns and orders of columns."""
    return rounded(files.read_wide(spark, write_wide(spark, d), "pn").drop("period_str"))


@query("s1_file_report", "SELECT early, count(DISTINCT (e, i)) AS n_series, count(*) AS n_values, count(DISTINCT t) AS n_periods, count(DISTINCT t) + CASE WHEN early THEN 5 ELSE 3 END AS n_columns FROM (SELECT *, year(t) <= 1995 AS early FROM pn) GROUP BY early", PN)
def s1_files(spark, d):
    """What each kind of file holds, from the counts of its files."""
    each = files.file_report(spark, write_wide(spark, d))
    return each.groupBy(F.col("file").contains("/early/").alias("early")).agg(F.sum("n_series").alias("n_series"), F.sum("n_values").alias("n_values"), F.max("n_periods").cast("long").alias("n_periods"), F.max("n_columns").cast("long").alias("n_columns"))


@query("s1_load_report", "SELECT 'pn' AS dataset, count(*) AS n_rows, count(DISTINCT e) AS n_e FROM pn", PN)
def s1_report(spark, d):
    return files.load_report(files.read_wide(spark, write_wide(spark, d), "pn"))


@query("s2_newest_file", "SELECT 'fsic' AS dataset, 0 AS place, 'new' AS version, count(*) AS n FROM nation UNION ALL SELECT 'weo', 1, 'late', count(*) FROM region UNION ALL SELECT 'wgi', 1, 'only', count(*) FROM supplier")
def s2(spark, d):
    """Two search folders with files of several ages; what the picked files hold."""
    first, second = scratch(spark, "first"), scratch(spark, "second")
    plan = [(first, "fsic_1", "old", "nation"), (second, "fsic_3", "newer, elsewhere", "nation"), (first, "fsic_2", "new", "nation"), (second, "weo_9", "early", "region"), (second, "weo_1", "late", "region"), (second, "wgi", "only", "supplier"), (second, "fsic_4", "newest, elsewhere", "nation")]
    for folder, name, version, source in plan:
        rows = table(spark, d, source).agg(F.count(F.lit(1)).alias("n")).select(F.lit(version).alias("version"), "n")
        files.write_csv(rows.coalesce(1), f"{folder}/{name}")
    picked = files.newest(spark, [first, second], {"fsic": r"^fsic_.*\.csv$", "weo": r"^weo.*\.csv$", "wgi": r"^wgi/.*\.csv$"})
    read = lambda folder: spark.read.option("header", True).option("recursiveFileLookup", "true").schema("version string, n long").csv(folder).select("version", "n", F.col("_metadata.file_path").alias("p"))
    name = lambda x: F.substring_index(x, "/", -1)
    return picked.join(read(first).unionByName(read(second)), name("path") == name("p")).select("dataset", "place", "version", "n")


BALANCE = """bs AS (SELECT n_name, c_mktsegment, o_orderpriority, year(o_orderdate) + 8 AS y, count(*)::DOUBLE AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


@query("s3_filtered_sector", "SELECT n_name AS COUNTRY, c_mktsegment AS SECTOR, o_orderpriority AS INDICATOR, CASE WHEN n_nationkey < 20 THEN 'N' || n_nationkey END AS code, y, n FROM bs JOIN nation USING (n_name) WHERE c_mktsegment = 'BUILDING' AND y >= 2000", BALANCE)
def s3(spark, d):
    """A wide table with other sectors, other columns and years before 2000, written and read back for one sector."""
    nations = table(spark, d, "nation")
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("y", F.year("o_orderdate") + 8)
    wide = rows.groupBy(F.col("n_name").alias("COUNTRY"), F.col("c_mktsegment").alias("SECTOR"), F.lit("a note").alias("NOTE"), F.col("o_orderpriority").alias("INDICATOR"), F.lit(1).alias("1999")).pivot("y").count()
    path = scratch(spark, "balance")
    files.write_csv(wide, path)
    codes = nations.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    got = files.read_balance(spark, path, "BUILDING", codes)
    years = [x for x in got.columns if x.startswith("20")]
    return got.unpivot(["COUNTRY", "SECTOR", "INDICATOR", "code"], years, "y", "n").where("n is not null").withColumn("y", F.col("y").cast("long"))


@query("s4_merge_dimensions", "SELECT e, year(t)::INT AS y, " + ", ".join(f"round(arg_max(v, t) FILTER (i = '{i}'), 6) + 0.0 AS {i}" for i in DIMENSIONS) + " FROM pd WHERE v IS NOT NULL AND (length(e) + year(t)) % 5 <> length(i) % 5 GROUP BY 1, 2", PD)
def s4(spark, d):
    """Six dimensions, each in a file of its own with years of its own, merged to one row for each (entity, year)."""
    panel, path = p.settle(dimension_panel(spark, d).where("(length(e) + year(t)) % 5 <> length(i) % 5"), "panel"), scratch(spark, "dimensions")
    for i in DIMENSIONS:
        files.write_csv(panel.where(F.col("i") == i).select("e", "t", "v"), f"{path}/{i}")
    return rounded(files.read_dimensions(spark, {i: f"{path}/{i}" for i in DIMENSIONS}))


@query("s5_parquet_cache", "SELECT dataset, count(*) AS n FROM (SELECT 'nation' AS dataset FROM pn UNION ALL SELECT 'user' FROM pu) GROUP BY 1", PN, PU)
def s5(spark, d):
    path = scratch(spark, "cache")
    both = nation_panel(spark, d).withColumn("dataset", F.lit("nation")).unionByName(user_panel(spark, d).withColumn("dataset", F.lit("user")))
    both.write.partitionBy("dataset").parquet(path)
    return spark.read.parquet(path).groupBy(F.col("dataset").cast("string").alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@query("s5_reload", "SELECT 1 AS call, 'built' AS how, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 2, 'reloaded', (SELECT count(*) FROM nation) UNION ALL SELECT 3, 'built', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)")
def s5_reload(spark, d):
    """A dataset is built, read again without its source, and built anew when the source has changed."""
    source, folder, calls = scratch(spark, "source"), scratch(spark, "cache"), []
    load = lambda: files.cached(spark, folder, "names", source, lambda: spark.read.csv(source, header=True, schema="n string", recursiveFileLookup=True).withColumn("call", F.lit(len(calls) + 1)))
    for name, column in (("nation", "n_name"), (None, None), ("region", "r_name")):
        if name:
            files.write_csv(table(spark, d, name).select(F.col(column).alias("n")), f"{source}/{name}")
        calls.append(load().groupBy("call").agg(F.count(F.lit(1)).alias("n")).select(F.lit(len(calls) + 1).alias("call"), F.when(F.col("call") == len(calls) + 1, "built").otherwise("reloaded").alias("how"), "n"))
    return calls[0].unionByName(calls[1]).unionByName(calls[2])


@query("s6_exports", "SELECT e, i, round(v, 6) + 0.0 AS v, t FROM pn ORDER BY e, i, t LIMIT 1000", PN)
def s6(spark, d):
    path = scratch(spark, "sample")
    files.sample(rounded(nation_panel(spark, d)), "e", "i", "t").write.json(path)
    return spark.read.schema("e string, i string, t date, v double").json(path)


COLUMNS = "e string, region string, econ double, industry double, composite double, tier string, price double, quantity double, discount double, tax double, returned double"


@query("s6_score_table", "SELECT ec.e, r_name AS region, round(econ, 4) AS econ, round(industry, 4) AS industry, round((econ + industry) / 2, 4) AS composite, CASE WHEN (econ + industry) / 2 >= 50 THEN 'upper' ELSE 'lower' END AS tier, " + ", ".join(f"round(max(v) FILTER (i = '{x}'), 4) + 0.0 AS {x}" for x in ("price", "quantity", "discount", "tax", "returned")) + " FROM ec JOIN ind USING (e) JOIN la USING (e) JOIN nation ON n_name = ec.e JOIN region ON n_regionkey = r_regionkey GROUP BY ec.e, r_name, econ, industry", PN, LATEST, PCT, SCORES)
def s6_scores(spark, d):
    """The score table with its eleven columns, as CSV and back."""
    last = p.latest(nation_panel(spark, d))
    scores = p.weighted_percentiles(last, ("econ", ECON), ("industry", INDUSTRY)).withColumn("composite", (F.col("econ") + F.col("industry")) / 2)
    dims = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("e"), F.col("r_name").alias("region"))
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    out = scores.join(dims, "e").join(p.widen(last, {x: x for x in names[6:]}, years=False), "e").withColumn("tier", F.when(F.col("composite") >= 50, "upper").otherwise("lower"))
    path = scratch(spark, "scores")
    files.write_csv(rounded(out.select(*names), 4), path)
    return spark.read.option("header", True).schema(COLUMNS).csv(path)


@query("s6_feature_matrix", "SELECT key, " + ", ".join(f"round({f}, 4) + 0.0 AS {f}" for f in FEATURES) + " FROM xs", XS)
def s6_features(spark, d):
    """The feature matrix without its period columns, as CSV and back."""
    wide = supplier_features(spark, d).drop("nation").withColumns({f + "_period": F.lit("1998-12-31") for f in FEATURES})
    path = scratch(spark, "features")
    files.write_csv(rounded(files.without_periods(wide), 4), path)
    return spark.read.option("header", True).schema("key long, " + ", ".join(f"{f} double" for f in FEATURES)).csv(path)


@query("s6_loadings")
def s6_loadings(spark, d):
    """Each pillar's loadings, as JSON and back."""
    path = scratch(spark, "loadings")
    pillars(supplier_features(spark, d))[1].write.json(path)
    return rounded(spark.read.schema("pillar string, feature string, loading double, share double").json(path), 4)


# names


@query("j12_similar_names", """SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT p_name AS n FROM part) a JOIN (SELECT DISTINCT p_name AS n FROM part) b ON a.n < b.n AND levenshtein(a.n, b.n) <= 4""")
def j12(spark, d):
    return names.within_distance(table(spark, d, "part").select(F.col("p_name").alias("n")))


@query("j12_similar_product_names", """SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT p_type || p_brand || p_name AS n FROM part) a JOIN (SELECT DISTINCT p_type || p_brand || p_name AS n FROM part) b ON a.n < b.n AND levenshtein(a.n, b.n) <= 2 WHERE length(a.n) - length(b.n) BETWEEN -2 AND 2""")
def j12_long(spark, d):
    return names.within_distance(table(spark, d, "part").select(F.concat("p_type", "p_brand", "p_name").alias("n")), 2)


@query("j12_sequence_ratio")
def j12_ratio(spark, d):
    return rounded(names.similar_by_ratio(table(spark, d, "part").select(F.col("p_name").alias("n"))))


# series


@query("w6_p_values")
def w6_p(spark, d):
    @F.pandas_udf("double")
    def tail(r2: pd.Series, n: pd.Series) -> pd.Series:
        r, k = r2.to_numpy(float), n.to_numpy(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.sqrt(r * (k - 2) / (1 - r))
        return pd.Series(np.where(r >= 1, 0.0, h.t_tail(t, k - 2)))

    return rounded(p.trends(user_panel(spark, d)).select("e", "i", "n", "r2", tail("r2", "n").alias("p")))


def _smooth_sql() -> str:
    """The smoothing of helpers.smooth as weights by place in the series, for series of any length."""
    cases = []
    for w in (3, 5, 7):
        fit = np.vander(np.arange(w), 3)
        hat = fit @ np.linalg.pinv(fit)
        half = w // 2
        row = lambda k, first: " + ".join(f"({float(x)!r})::DOUBLE * v[{first} + {m + 1}]" for m, x in enumerate(hat[k]))  # noqa: E731, B023
        when = {3: "n = 5", 5: "n BETWEEN 6 AND 7", 7: "n >= 8"}[w]
        for k in range(half):
            cases.append(f"WHEN {when} AND x = {k} THEN {row(k, 0)}")
            cases.append(f"WHEN {when} AND x = n - {half} + {k} THEN {row(half + 1 + k, f'n - {w}')}")
        cases.append(f"WHEN {when} THEN {row(half, f'x - {half}')}")
    return "CASE WHEN n < 5 THEN v[x + 1] " + " ".join(cases) + " END"


@query("w13_smoothed", f"SELECT e, i, t, round({_smooth_sql()}, 6) + 0.0 AS smooth FROM (SELECT e, i, t, row_number() OVER (PARTITION BY e, i ORDER BY t) - 1 AS x, count(*) OVER (PARTITION BY e, i) AS n, list(v ORDER BY t) OVER (PARTITION BY e, i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM pn)", PN)
def w13(spark, d):
    return rounded(p.smoothed(nation_panel(spark, d)).select("e", "i", "t", "smooth"))


#: A cubic through every series' own points, with a third of the points missing: the spline gives the cubic back, also beyond the edges.
CUBIC = "cu AS (SELECT e, i, t, year(t) + month(t) / 12::DOUBLE AS x, length(i) AS k, (length(e) + month(t) + year(t)) % 3 <> 0 AS real FROM pn), cx AS (SELECT *, max(CASE WHEN real THEN x END) OVER b AS l, min(CASE WHEN real THEN x END) OVER a AS f, count(CASE WHEN real THEN 1 END) OVER (PARTITION BY e, i) AS n FROM cu WINDOW b AS (PARTITION BY e, i ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY e, i ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("i2_spline_of_cubics", "SELECT e, i, t, round(pow(x - 1995, 3) - k * pow(x - 1995, 2) + 2, 5) + 0.0 AS v, round(CASE WHEN real THEN 1.0 ELSE greatest(0.1, 1 - least(coalesce(x - l, 1e9), coalesce(f - x, 1e9)) / 5) END, 5)::DOUBLE AS confidence FROM cx WHERE n >= 4", PN, CUBIC)
def i2_cubic(spark, d):
    x = F.year("t") + F.month("t") / 12 - 1995
    n = nation_panel(spark, d)
    real = (F.length("e") + F.month("t") + F.year("t")) % 3 != 0
    return rounded(p.spline_fill(n.withColumn("v", F.when(real, F.pow(x, 3) - F.length("i") * F.pow(x, 2) + 2))), 5)


@query("i2_spline_fill")
def i2(spark, d):
    n = nation_panel(spark, d)
    return rounded(p.spline_fill(n.withColumn("v", F.when((F.length("e") + F.month("t") + F.year("t")) % 3 != 0, F.col("v")))), 5)


# blocks of rows


NEAREST = """dd AS (SELECT a.key, b.key AS donor, sqrt(6 / count(*)::DOUBLE * sum(pow(a.v - b.v, 2))) AS dist FROM xl a JOIN xl b ON a.f = b.f AND a.key <> b.key AND a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY 1, 2),
nb AS (SELECT *, row_number() OVER (PARTITION BY key, f ORDER BY dist, donor) AS m FROM (SELECT g.key, g.f, d.dist, d.donor, b.v FROM xl g JOIN dd d ON d.key = g.key JOIN xl b ON b.key = d.donor AND b.f = g.f AND b.v IS NOT NULL WHERE g.v IS NULL)),
nw AS (SELECT key, f, v, CASE WHEN min(dist) OVER (PARTITION BY key, f) = 0 THEN (dist = 0)::INT ELSE 1 / dist END AS w FROM nb WHERE m <= 5)"""


@query("i3_nearest_fill", "SELECT g.key, g.f, round(coalesce(n.v, a.m), 5) + 0.0 AS v, CASE WHEN coalesce(n.v, a.m) IS NULL THEN 0.0 ELSE 0.7 END::DOUBLE AS confidence FROM xl g LEFT JOIN (SELECT key, f, sum(w * v) / sum(w) AS v FROM nw GROUP BY 1, 2) n ON n.key = g.key AND n.f = g.f JOIN (SELECT f, avg(v) AS m FROM xl GROUP BY f) a ON a.f = g.f WHERE g.v IS NULL", XL, NEAREST)
def i3(spark, d):
    return rounded(neighbours.knn_fill(supplier_features(spark, d), FEATURES), 5)


def gram_fill(wide, features, rank: int = 10):
    """key, f, v, confidence: missing cells from a low-rank fit; only d x d sums reach the driver."""
    names = list(features)
    means = wide.agg(*[F.avg(f).alias(f) for f in names]).first()
    start = np.array([0.0 if means[f] is None else means[f] for f in names])
    k = min(rank, len(names) - 1)

    def centred(pdf):
        raw = pdf[names].to_numpy(float)
        x = np.where(np.isnan(raw), start, raw)
        m = x.mean(axis=1, keepdims=True)
        return raw, x - m, m

    def sums(batches):
        g = np.zeros((len(names), len(names)))
        for pdf in batches:
            x = centred(pdf)[1]
            g += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(len(names)), len(names)), "j": np.tile(np.arange(len(names)), len(names)), "g": g.ravel()})

    parts = wide.mapInPandas(sums, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).toPandas()
    g = np.zeros((len(names), len(names)))
    g[parts["i"], parts["j"]] = parts["g"]
    top = np.linalg.eigh(g)[1][:, ::-1][:, :k]

    def fill(batches):
        for pdf in batches:
            raw, x, m = centred(pdf)
            fit = x @ top @ top.T + m
            r, j = np.nonzero(np.isnan(raw))
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[r], "f": np.array(names)[j], "v": fit[r, j], "confidence": 0.6})

    return wide.select("key", *names).mapInPandas(fill, "key long, f string, v double, confidence double")


@query("i5_low_rank_fill")
def i5(spark, d):
    return rounded(gram_fill(supplier_features(spark, d), FEATURES), 4)


def hybrid_fill(panel, features):
    """e, t, i, v, confidence, how for every (e, t) of the panel and every feature: the mean of duplicates, gaps along time first,
    what is left from neighbours, then from the low-rank fit. The least confidence of the steps that made a value counts."""
    timed = p.fill_gaps(panel.where(F.col("i").isin(*features)))
    real = panel.where("v is not null").select("e", "i", "t").distinct().withColumn("real", F.lit(True))
    cells = timed.join(real, ["e", "i", "t"], "left").withColumn("key", F.xxhash64("e", "t"))
    path = scratch(panel.sparkSession, "cells")
    cells.write.parquet(path)  # three fills read them
    cells = panel.sparkSession.read.parquet(path)
    wide = cells.groupBy("key").pivot("i", list(features)).agg(F.first("v"))
    near, low = neighbours.knn_fill(wide, features), gram_fill(wide, features)
    out = cells.join(near.select("key", F.col("f").alias("i"), F.col("v").alias("v2"), F.col("confidence").alias("c2")), ["key", "i"], "left").join(low.select("key", F.col("f").alias("i"), F.col("v").alias("v3"), F.col("confidence").alias("c3")), ["key", "i"], "left")
    how = F.when(F.col("real"), "real").when(F.col("v").isNotNull(), "temporal").when(F.col("v2").isNotNull(), "neighbours").when(F.col("v3").isNotNull(), "low rank").otherwise("none")
    sure = F.when(F.col("v").isNotNull(), F.col("confidence")).when(F.col("v2").isNotNull(), F.col("c2")).otherwise(F.least("c2", "c3"))
    return out.select("e", "t", "i", F.coalesce("v", "v2", "v3").alias("v"), sure.alias("confidence"), how.alias("how"))


def _gappy(spark, d):
    """The nation panel without a third of its points and without a whole series of some nations."""
    n = nation_panel(spark, d)
    return n.where("(length(e) + month(t) + year(t)) % 3 <> 0 and not (i = 'tax' and e like '%7')")


@query("i6_hybrid_fill")
def i6(spark, d):
    return rounded(hybrid_fill(_gappy(spark, d), ("price", "quantity", "discount", "tax", "returned")), 4)


@query("i6_hybrid_stats", """SELECT 'all' AS cells, count(*) AS n, count(*) - count(v) AS missing_before, (count(*) FILTER (v IS NULL AND k > 0))::BIGINT AS temporal, (count(*) FILTER (v IS NULL AND k = 0))::BIGINT AS neighbours, count(*) AS filled FROM
  (SELECT g.i, g.t, z.e, h.v, count(h.v) OVER (PARTITION BY z.e, g.i) AS k FROM (SELECT DISTINCT i, t FROM ps) g CROSS JOIN (SELECT DISTINCT e FROM ps) z LEFT JOIN ps h ON h.e = z.e AND h.i = g.i AND h.t = g.t)""", PN, "ps AS (SELECT * FROM pn WHERE (length(e) + month(t) + year(t)) % 3 <> 0 AND NOT (i = 'tax' AND e LIKE '%7'))")
def i6_stats(spark, d):
    x = hybrid_fill(_gappy(spark, d), ("price", "quantity", "discount", "tax", "returned"))
    n = lambda how: F.count(F.when(F.col("how") == how, 1))
    return x.agg(F.lit("all").alias("cells"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - n("real")).alias("missing_before"), n("temporal").alias("temporal"), n("neighbours").alias("neighbours"), F.count("v").alias("filled"))


@query("i6_fill_statistics", """SELECT count(*) FILTER (v IS NULL) AS missing_before, count(*) FILTER (v IS NULL) AS imputed, (count(*) FILTER (v IS NULL AND k > 0))::BIGINT AS temporal, (count(*) FILTER (v IS NULL AND k = 0))::BIGINT AS neighbours, 0::BIGINT AS low_rank,
  round(avg(CASE WHEN v IS NOT NULL THEN 1.0::DOUBLE WHEN k = 0 THEN 0.7 WHEN k = 1 THEN 0.1 ELSE greatest(0.1, 1 - least(coalesce(x - l, 1e9), coalesce(f - x, 1e9)) / 5) END), 6) AS confidence FROM
  (SELECT *, count(v) OVER s AS k, max(CASE WHEN v IS NOT NULL THEN x END) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l, min(CASE WHEN v IS NOT NULL THEN x END) OVER (s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f FROM
   (SELECT z.e, g.i, g.t, h.v, year(g.t) + month(g.t) / 12::DOUBLE AS x FROM (SELECT DISTINCT i, t FROM ps) g CROSS JOIN (SELECT DISTINCT e FROM ps) z LEFT JOIN ps h ON h.e = z.e AND h.i = g.i AND h.t = g.t) WINDOW s AS (PARTITION BY e, i ORDER BY t))""".replace("count(v) OVER s AS k", "count(v) OVER (PARTITION BY e, i) AS k").replace("OVER (s ROWS", "OVER (PARTITION BY e, i ORDER BY t ROWS").replace(" WINDOW s AS (PARTITION BY e, i ORDER BY t)", ""), PN, "ps AS (SELECT * FROM pn WHERE (length(e) + month(t) + year(t)) % 3 <> 0 AND NOT (i = 'tax' AND e LIKE '%7'))")
def i6_statistics(spark, d):
    return rounded(fill_statistics(hybrid_fill(_gappy(spark, d), ("price", "quantity", "discount", "tax", "returned"))))


def fill_statistics(filled):
    """One row: cells missing before, cells imputed, how many by each step, and the mean confidence of all cells that have a value."""
    n = lambda cond: F.count(F.when(cond, 1))
    how = lambda x: n(F.col("how") == x)
    return filled.agg(n(F.col("how") != "real").alias("missing_before"), n((F.col("how") != "real") & F.col("v").isNotNull()).alias("imputed"), how("temporal").alias("temporal"), how("neighbours").alias("neighbours"), how("low rank").alias("low_rank"), F.avg(F.when(F.col("v").isNotNull(), F.col("confidence"))).alias("confidence"))


@query("m11_nearest_peers", """SELECT key, peer, place FROM (SELECT a.key, b.key AS peer, row_number() OVER (PARTITION BY a.key ORDER BY round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6), b.key) AS place FROM (SELECT key, price / 1000 AS x, quantity AS y FROM xs WHERE price IS NOT NULL AND quantity IS NOT NULL) a JOIN (SELECT key, price / 1000 AS x, quantity AS y FROM xs WHERE price IS NOT NULL AND quantity IS NOT NULL) b ON a.key <> b.key) WHERE place <= 4""", XS)
def m11(spark, d):
    x = supplier_features(spark, d).where("price is not null and quantity is not null")
    return nearest.nearest_peers(x.select("key", (F.col("price") / 1000).alias("x"), F.col("quantity").alias("y")))


# pyspark.ml


def assembled(wide, scaler: str = "standard"):
    filled = [f + "_" for f in FEATURES]
    scale = StandardScaler(inputCol="raw", outputCol="x", withMean=True) if scaler == "standard" else RobustScaler(inputCol="raw", outputCol="x", withCentering=True)
    stages = [Imputer(strategy="median", inputCols=list(FEATURES), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), scale]
    return Pipeline(stages=stages).fit(wide).transform(wide)


def first_component(wide, names):
    """key, score of the first principal component, its share of the variance and loadings, the largest loading positive."""
    x = assembled(wide)
    pick = VectorAssembler(inputCols=list(names), outputCol="own")
    cols = x.select("key", *[vector_to_array("x")[i].alias(f) for i, f in enumerate(FEATURES)])
    model = PCA(k=min(5, len(names)), inputCol="own", outputCol="pc").fit(pick.transform(cols))
    load = model.pc.toArray()[:, 0]
    sign = 1.0 if load[np.abs(load).argmax()] > 0 else -1.0
    scored = model.transform(pick.transform(cols)).select("key", (vector_to_array("pc")[0] * sign).alias("pc1"))
    return scored, float(model.explainedVariance[0]), load * sign


def pillars(wide):
    """Each pillar's scores (pillar, key, pc1), loadings (pillar, feature, loading, share): economic, industry, combined."""
    scores, loads = None, []
    for name, own in (("economic", FEATURES[:3]), ("industry", FEATURES[3:]), ("combined", FEATURES)):
        x, share, load = first_component(wide, own)
        part = x.select(F.lit(name).alias("pillar"), "key", "pc1")
        scores = part if scores is None else scores.unionByName(part)
        loads += [(name, f, float(v), share) for f, v in zip(own, load, strict=True)]
    return scores, wide.sparkSession.createDataFrame(loads, "pillar string, feature string, loading double, share double")


@query("m4_first_components")
def m4(spark, d):
    scores, _ = pillars(supplier_features(spark, d))
    return rounded(scores.groupBy("key").pivot("pillar", ["economic", "industry", "combined"]).agg(F.first("pc1")), 4)


@query("m4_loadings")
def m4_loadings(spark, d):
    return rounded(pillars(supplier_features(spark, d))[1], 4)


Z2 = "zf AS (SELECT key, " + ", ".join(f"coalesce({f}, quantile_disc({f}, 0.5) OVER ()) AS {f}" for f in FEATURES[:2]) + " FROM xs), zz AS (SELECT key, " + ", ".join(f"({f} - avg({f}) OVER ()) / stddev_samp({f}) OVER () AS {f}" for f in FEATURES[:2]) + ", corr(price, quantity) OVER () AS r FROM zf)"


@query("m4_component_of_two", "SELECT key, round(abs(price + CASE WHEN r < 0 THEN -1 ELSE 1 END * quantity) / sqrt(2), 4) AS size, round((1 + abs(r)) / 2, 4) AS share FROM zz", XS, Z2)
def m4_two(spark, d):
    """Two features have a closed form: the component is their sum or difference over the root of 2, its share (1 + |r|) / 2."""
    pc, share, _ = first_component(supplier_features(spark, d), FEATURES[:2])
    return rounded(pc.select("key", F.abs("pc1").alias("size"), F.lit(share).alias("share")), 4)


@query("m5_component_of_two", "SELECT key, round((price + CASE WHEN r < 0 THEN -1 ELSE 1 END * quantity) / sqrt(2), 4) + 0.0 AS pc1 FROM zz", XS, Z2)
def m5_two(spark, d):
    wide = supplier_features(spark, d)
    anchor = assembled(wide).select("key", vector_to_array("x")[0].alias("anchor"))
    return rounded(oriented(first_component(wide, FEATURES[:2])[0].join(anchor, "key")).select("key", "pc1"), 4)


def oriented(x):
    """x (key, pc1, anchor) with pc1 turned so that it rises with the anchor, and |r|."""
    r = F.broadcast(x.agg(F.corr("pc1", "anchor").alias("r")))  # one row
    return x.crossJoin(r).select("key", F.when(F.col("r") < 0, -F.col("pc1")).otherwise(F.col("pc1")).alias("pc1"), F.abs("r").alias("r"))


@query("m5_oriented_components")
def m5(spark, d):
    """The component turned so that it rises with the anchor, log10 of the balance."""
    wide = supplier_features(spark, d)
    pc, _, _ = first_component(wide, FEATURES[:3])
    return rounded(oriented(pc.join(wide.select("key", F.log10(F.greatest(F.col("balance"), F.lit(100.0))).alias("anchor")), "key")), 4)


WORSE = ("discount", "tax", "returned")


@query("m6_cluster_matrix", "SELECT key, " + ", ".join(f"round(max({'-' if f in WORSE else ''}v) FILTER (f = '{f}'), 6) + 0.0 AS {f}" for f in FEATURES) + " FROM (SELECT * FROM xl UNION ALL SELECT key, 'rare', CASE WHEN key % 3 = 0 THEN 1.0::DOUBLE END FROM xs) x WHERE f IN (SELECT f FROM (SELECT * FROM xl UNION ALL SELECT key, 'rare', CASE WHEN key % 3 = 0 THEN 1.0::DOUBLE END FROM xs) GROUP BY f HAVING avg((v IS NOT NULL)::INT) > 0.5) GROUP BY key HAVING avg((v IS NOT NULL)::INT) > 0.3", XL)
def m6(spark, d):
    """All features, and one that is too rare to stay."""
    x = p.settle(long_features(spark, d).unionByName(supplier_features(spark, d).select("key", F.lit("rare").alias("f"), F.when(F.col("key") % 3 == 0, 1.0).alias("v"))), "long")
    return rounded(cluster_matrix(x, WORSE))


def cluster_matrix(x, worse, columns: float = 0.5, rows: float = 0.3):
    """key and a column for each feature of x (key, f, v) that more than a share of the rows have, lower-is-better ones turned; of rows that have more than a share of those."""
    good = x.groupBy("f").agg(F.avg(F.col("v").isNotNull().cast("int")).alias("n")).where(F.col("n") > columns).select("f")
    names = sorted(r["f"] for r in good.collect())  # the columns of the result
    x = x.where(F.col("f").isin(names)).withColumn("v", F.when(F.col("f").isin(*worse), -F.col("v")).otherwise(F.col("v")))
    w = x.groupBy("key").agg(*[F.max(F.when(F.col("f") == f, F.col("v"))).alias(f) for f in names], F.avg(F.col("v").isNotNull().cast("int")).alias("_n"))
    return w.where(F.col("_n") > rows).drop("_n")


def clustered(spark, d, k: int = 5):
    """key, cluster (0 best by mean scaled value), x: the scaled features."""
    x = assembled(supplier_features(spark, d), "robust")
    pca = PCA(k=min(10, len(FEATURES)), inputCol="x", outputCol="pc").fit(x).transform(x)
    fit = KMeans(k=k, seed=42, featuresCol="pc", predictionCol="c").fit(pca).transform(pca).select("key", "c", vector_to_array("x").alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, b: a + b) / F.size("x")
    order = fit.groupBy("c").agg(F.avg(mean).alias("m")).withColumn("cluster", F.row_number().over(W.orderBy(F.desc("m"))) - 1)
    return fit.join(F.broadcast(order.select("c", "cluster")), "c").select("key", "cluster", "x")


@query("m7_clusters")
def m7(spark, d):
    return clustered(spark, d).select("key", "cluster", (100 - F.col("cluster") / 4 * 70).alias("score"))


def importance(x):
    """f, importance: mutual information of a feature, binned at its exact tenths, and the cluster, over the largest."""
    long = x.select("cluster", F.posexplode("x").alias("f", "v"))
    counts = p.settle(long.groupBy("f", "v", "cluster").agg(F.count(F.lit(1)).alias("c")), "counts")  # read twice
    values = p.running(counts.groupBy("f", "v").agg(F.sum("c").alias("c")), "v", ["c"], ["f"], bound=counts.rows_at_most)
    bin_ = F.call_function("div", F.col("before_c") * 10, F.col("all_c"))  # how many of the nine cuts lie below the value
    bins = counts.join(values.select("f", "v", bin_.alias("bin")), ["f", "v"]).groupBy("f", "bin", "cluster").agg(F.sum("c").alias("c"))
    total = F.sum("c").over(W.partitionBy("f"))
    joint = bins.withColumns({"p": F.col("c") / total, "pb": F.sum("c").over(W.partitionBy("f", "bin")) / total, "pc": F.sum("c").over(W.partitionBy("f", "cluster")) / total})
    mi = joint.groupBy("f").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("pb") * F.col("pc")))).alias("mi"))
    return mi.withColumn("importance", F.col("mi") / F.max("mi").over(W.partitionBy())).select("f", "importance")


@query("m8_mutual_information")
def m8(spark, d):
    return rounded(importance(clustered(spark, d)), 4)


@query("m7_cluster_checks", "SELECT count(*) AS n, 5::BIGINT AS clusters, true AS ordered, true AS nearest FROM supplier")
def m7_checks(spark, d):
    """Every entity has one of five clusters, whose mean values fall with their number, and no other centre is nearer than its own."""
    x = clustered(spark, d)
    cells = x.select("key", "cluster", F.posexplode("x").alias("f", "v"))
    centre = cells.groupBy("cluster", "f").agg(F.avg("v").alias("m"))
    means = centre.groupBy("cluster").agg(F.avg("m").alias("m")).agg(F.array_sort(F.collect_list(F.struct("cluster", "m"))).alias("l"))  # five rows
    ordered = means.select(F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.get("l", k)["m"] <= F.get("l", k - 1)["m"] + 1e-9).alias("ordered"))
    far = cells.withColumnRenamed("cluster", "own").join(centre, "f").groupBy("key", "own", "cluster").agg(F.sum(F.pow(F.col("v") - F.col("m"), 2)).alias("d"))
    good = far.groupBy("key", "own").agg((F.min("d") >= F.min(F.when(F.col("own") == F.col("cluster"), F.col("d"))) - 0.05 * F.min("d") - 1e-6).alias("ok"))
    return good.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("own").alias("clusters"), F.bool_and("ok").alias("nearest")).crossJoin(ordered)


BINNED = "mb AS (SELECT key % 3 AS cluster, f, (SELECT count(*) FROM (SELECT unnest(cuts) AS c) WHERE c < v) AS bin FROM (SELECT key, f, coalesce(v, 0) AS v FROM xl) JOIN (SELECT f, quantile_disc(coalesce(v, 0), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM xl GROUP BY f) USING (f)), mj AS (SELECT f, bin, cluster, count(*)::DOUBLE AS c FROM mb GROUP BY ALL), mi AS (SELECT f, sum(p * ln(p / (pb * pc))) AS mi FROM (SELECT f, c / sum(c) OVER (PARTITION BY f) AS p, sum(c) OVER (PARTITION BY f, bin) / sum(c) OVER (PARTITION BY f) AS pb, sum(c) OVER (PARTITION BY f, cluster) / sum(c) OVER (PARTITION BY f) AS pc FROM mj) GROUP BY f)"


@query("m8_information_of_labels", "SELECT CASE f " + " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(FEATURES)) + " END AS f, round(mi / max(mi) OVER (), 5) + 0.0 AS importance FROM mi", XL, BINNED)
def m8_labels(spark, d):
    """The same measure for labels that SQL has, too."""
    return rounded(importance(key_labels(supplier_features(spark, d))), 5)


def key_labels(wide):
    """key, cluster, x: entities by key arithmetic, with the unscaled features."""
    return wide.select("key", (F.col("key") % 3).alias("cluster"), F.array(*[F.coalesce(f, F.lit(0.0)) for f in FEATURES]).alias("x"))


def cluster_scores(x, wide, weights, k: int = 5):
    """key, score, confidence, tier: the cluster's base score moved by importance (weights) x scaled value x 5, in 0..100; confidence is the filled share."""
    long = x.select("key", "cluster", F.posexplode("x").alias("f", "v")).join(F.broadcast(weights), "f")  # a row for each feature
    s = long.groupBy("key", "cluster").agg(F.sum(F.col("importance") * F.col("v") * 5).alias("a"))
    score = c.clip(100 - F.col("cluster") / (k - 1) * 70 + F.col("a"), 0.0, 100.0)
    filled = wide.select("key", (sum((F.col(f).isNotNull().cast("int") for f in FEATURES[1:]), F.col(FEATURES[0]).isNotNull().cast("int")) / len(FEATURES)).alias("confidence"))
    return s.join(filled, "key").select("key", score.alias("score"), "confidence").withColumn("tier", c.tier_from(F.col("score"), (80, 65, 50, 35), ["very low", "low", "medium", "high", "very high"]))


@query("m9_cluster_scores")
def m9(spark, d):
    x = clustered(spark, d)
    return rounded(cluster_scores(x, supplier_features(spark, d), importance(x)), 3)


@query("m9_scores_of_labels", "SELECT key, round(score, 4) + 0.0 AS score, round(confidence, 4) AS confidence, CASE WHEN score >= 80 THEN 'very low' WHEN score >= 65 THEN 'low' WHEN score >= 50 THEN 'medium' WHEN score >= 35 THEN 'high' ELSE 'very high' END AS tier FROM (SELECT key, greatest(0, least(100, 100 - key % 3 / 4.0::DOUBLE * 70 + sum(mi / top * coalesce(v, 0) / (1 + abs(coalesce(v, 0))) * 5))) AS score, avg((v IS NOT NULL)::INT) AS confidence FROM xl JOIN mi USING (f) CROSS JOIN (SELECT max(mi) AS top FROM mi) GROUP BY key)", XL, BINNED)
def m9_labels(spark, d):
    """The scores that given clusters lead to. Bins are those of unscaled values: scaling makes some unequal large ones equal."""
    wide = p.settle(supplier_features(spark, d), "features")
    raw = key_labels(wide)
    scaled = raw.withColumn("x", F.transform("x", lambda v: v / (1 + F.abs(v))))
    return rounded(cluster_scores(scaled, wide, importance(raw)), 4)


def key_drivers(x, weights, top: int = 5):
    """key, f, z, weight, risk, place: the features (key, f, v) whose distance from the median in deviations, times the feature's weight, is largest."""
    x = p.settle(x.where("v is not null"), "long")
    x = x.join(x.groupBy("f").agg(F.stddev_samp("v").alias("s")), "f").join(p.quantiles(x, "v", {"m": 0.5}, ["f"]), "f").join(weights, "f")
    x = x.withColumn("z", F.round((F.col("v") - F.col("m")) / F.col("s"), 5)).withColumn("weight", F.round(F.col("importance") * F.abs("z"), 6))
    x = x.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy(F.desc("weight"), "f")).cast("long")).where(F.col("place") <= top)
    return rounded(x.select("key", "f", "z", "weight", (F.col("z") < -0.5).alias("risk"), "place"))


WEIGHTS = {"price": 1.0, "quantity": 0.5, "discount": 0.2, "tax": 0.7, "returned": 0.6, "balance": 0.4}


@query("m10_key_drivers", """SELECT key, f, z + 0.0 AS z, w AS weight, z < -0.5 AS risk, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC, f) AS place FROM (SELECT key, f, z, round(g * abs(z), 6) AS w FROM (SELECT key, f, round((v - m) / s, 5) AS z FROM xl JOIN (SELECT f, median(v) AS m, stddev_samp(v) AS s FROM xl GROUP BY f) USING (f) WHERE v IS NOT NULL) JOIN (VALUES """ + ", ".join(f"('{f}', {v}::DOUBLE)" for f, v in WEIGHTS.items()) + """) q(f, g) USING (f))) WHERE place <= 5""", XL)
def m10(spark, d):
    return key_drivers(long_features(spark, d), spark.createDataFrame(list(WEIGHTS.items()), "f string, importance double"))


@query("m10_model_drivers")
def m10_model(spark, d):
    """The same with the importances of the clusters."""
    names = F.array(*[F.lit(f) for f in FEATURES])
    return key_drivers(long_features(spark, d), importance(clustered(spark, d)).select(F.get(names, F.col("f")).alias("f"), "importance"))


BASE_DAY, HORIZON, ROUNDS = 1475, 3, 100
KINDS = ("click", "error", "purchase", "signup", "view")


def labelled(spark, d):
    """key, five features of each user up to the base day, the label (an error in the days after it, J5) and the classes' weights; settled."""
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date"))
    before = table(spark, d, "events").where(day <= BASE_DAY).groupBy(F.col("user_id").alias("key")).pivot("event_type", list(KINDS)).agg(F.avg("value"))
    hit = (F.col("start") <= BASE_DAY + HORIZON) & (F.col("end") >= BASE_DAY + 1)
    label = error_spans(spark, d).groupBy(F.col("e").alias("key")).agg(F.max(hit.cast("double")).alias("label"))
    path = scratch(spark, "labelled")
    before.join(label, "key", "left").fillna(0.0, ["label"]).write.parquet(path)
    x = spark.read.parquet(path)
    w = F.broadcast(x.agg((F.sum(1 - F.col("label")) / F.greatest(F.sum("label"), F.lit(1.0))).alias("w")))  # one row
    return x.crossJoin(w).withColumn("weight", F.when(F.col("label") == 1, F.col("w")).otherwise(1.0)).drop("w")


def fitted(train, rounds: int = ROUNDS):
    """Boosted trees on median-filled, robustly scaled features; what fills and scales is learned from train."""
    filled = [f + "_" for f in KINDS]
    gbt = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.1, weightCol="weight", seed=42, featuresCol="x", cacheNodeIds=True, checkpointInterval=-1)
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(KINDS), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), RobustScaler(inputCol="raw", outputCol="x", withCentering=True), gbt]).fit(train)


def probabilities(model, x):
    return model.transform(x).select("key", "label", vector_to_array("probability")[1].alias("p"))


def roc(scored):
    """thr, tpr, fpr of each distinct probability, from running counts."""
    g = scored.groupBy("p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    share = lambda x: F.try_divide(F.col(f"all_{x}") - F.col(f"before_{x}"), F.col(f"all_{x}"))
    return p.running(g, "p", ["pos", "neg"]).select("p", share("pos").alias("tpr"), share("neg").alias("fpr"))


def auc(scored, by=()):
    by = list(by)
    ranked = p.percentile_rank(scored, "p", by)
    n1, n = F.sum("label"), F.count(F.lit(1))
    return ranked.groupBy(*by).agg(F.try_divide(F.sum(F.col("label") * F.col("pct")) * n - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc"))


GRID = 99


def mean_curve(scored):
    """fpr, tpr on a grid of 100 points: the folds' curves (fold, label, p), each a straight line between its points, averaged; from 0 to 1."""
    g = scored.groupBy("fold", "p").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    share = lambda x: F.try_divide(F.col(f"all_{x}") - F.col(f"before_{x}"), F.col(f"all_{x}"))
    points = p.running(g, "p", ["pos", "neg"], ["fold"]).select("fold", share("neg").alias("x"), share("pos").alias("y"))
    start = points.select("fold").distinct().select("fold", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    cell = F.ceil(F.round(F.col("x") * GRID, 9)).cast("int")  # the first grid point at or after x
    cells = points.unionByName(start).groupBy("fold", cell.alias("k")).agg(F.max(F.struct("x", "y")).alias("hi"), F.min(F.struct("x", "y")).alias("lo"))
    every = start.select("fold", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("k")).join(cells, ["fold", "k"], "left")  # 100 rows of each fold
    order = W.partitionBy("fold").orderBy("k")
    every = every.withColumns({"a": F.max("hi").over(order.rowsBetween(W.unboundedPreceding, 0)), "b": F.min("lo").over(order.rowsBetween(1, W.unboundedFollowing))})
    x = F.col("k") / GRID
    y = F.when(F.col("b").isNull() | (F.col("b.x") == F.col("a.x")), F.col("a.y")).otherwise(F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (x - F.col("a.x")) / (F.col("b.x") - F.col("a.x")))
    mean = every.select("fold", "k", y.alias("y")).groupBy("k").agg(F.avg("y").alias("y"))
    return mean.select((F.col("k") / GRID).alias("fpr"), F.when(F.col("k") == 0, 0.0).when(F.col("k") == GRID, 1.0).otherwise(F.col("y")).alias("tpr"))


def area(curve):
    """The area under (fpr, tpr) by trapezoids; 100 rows."""
    order = W.partitionBy().orderBy("fpr")
    step = (F.col("fpr") - F.lag("fpr").over(order)) * (F.col("tpr") + F.lag("tpr").over(order)) / 2
    return curve.select(step.alias("s")).agg(F.sum("s").alias("auc"))


def folded(x, k: int, seed: int = 42):
    """x (key, label, ...) with its fold: rows of a label, in the order of a hash, take folds in turn. The order comes from counts of hashes (`running`), so no task orders a label."""
    x = x.withColumn("_h", F.xxhash64("key", F.lit(seed)))
    counts = p.running(x.groupBy("label", "_h").agg(F.count(F.lit(1)).alias("_c")), "_h", ["_c"], ["label"])
    among = F.row_number().over(W.partitionBy("label", "_h").orderBy("key"))
    placed = x.join(counts.select("label", "_h", "before__c"), ["label", "_h"]).withColumn("fold", ((F.col("before__c") + among) % k).cast("int"))
    return placed.select(*[c for c in x.columns if c != "_h"], "fold")


def cross_validated(x, seed: int = 42, rounds: int = ROUNDS):
    """key, label, p, fold: every row scored by a model of the other folds; k = min(5, smaller class), 2 at least. The fits run side by side."""
    small = x.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    k = max(2, min(5, small))
    spark, x = x.sparkSession, p.settle(folded(x, k, seed), "folds")
    with ThreadPool(k) as pool:
        parts = pool.map(lambda i: probabilities(fitted(x.where(F.col("fold") != i), rounds), x.where(F.col("fold") == i)).withColumn("fold", F.lit(i)), range(k))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    path = scratch(spark, "scored")
    every.write.parquet(path)
    return spark.read.parquet(path)


@query("m12_labels", f"SELECT u.key, max(CASE WHEN s <= {BASE_DAY + HORIZON} AND z >= {BASE_DAY + 1} THEN 1.0 ELSE 0.0 END)::DOUBLE AS label FROM (SELECT DISTINCT user_id AS key FROM events WHERE (ts::DATE - DATE '2020-01-01') <= {BASE_DAY}) u LEFT JOIN iv ON iv.e = u.key GROUP BY 1", IV)
def m12_labels(spark, d):
    return labelled(spark, d).select("key", "label")


@query("m12_event_classifier")
def m12(spark, d):
    """Each user's probability from models of the other folds, and the class at 0.5."""
    return rounded(cross_validated(labelled(spark, d)).withColumn("predicted", (F.col("p") >= 0.5).cast("int")), 4)


@query("m12_trained_classifier")
def m12_trained(spark, d):
    """One model of all users, and what it says of them."""
    x = labelled(spark, d)
    return rounded(probabilities(fitted(x), x).withColumn("predicted", (F.col("p") >= 0.5).cast("int")), 4)


@query("m13_cross_validated_auc")
def m13(spark, d):
    """The area under the folds' mean curve, the deviation of the folds' areas, and the number of folds."""
    scored = cross_validated(labelled(spark, d))
    each = auc(scored, ["fold"]).agg(F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("folds"))
    return rounded(area(mean_curve(scored)).select(F.col("auc").alias("mean_auc")).crossJoin(each), 4)


def _scores(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") % 3).alias("fold"), F.col("p_size").cast("double").alias("p"), (F.col("p_partkey") % 7 < F.col("p_size") / 20).cast("double").alias("label"))


MEAN_CURVE = """sc AS (SELECT p_partkey % 3 AS fold, p_size::DOUBLE AS p, (p_partkey % 7 < p_size / 20.0::DOUBLE)::INT AS l FROM part), gp AS (SELECT fold, p, sum(l) AS pos, sum(1 - l) AS neg FROM sc GROUP BY 1, 2),
pt AS (SELECT fold, sum(neg) OVER (PARTITION BY fold ORDER BY p DESC)::DOUBLE / sum(neg) OVER (PARTITION BY fold) AS x, sum(pos) OVER (PARTITION BY fold ORDER BY p DESC)::DOUBLE / sum(pos) OVER (PARTITION BY fold) AS y FROM gp UNION ALL SELECT DISTINCT fold, 0.0, 0.0 FROM sc),
gd AS (SELECT fold, k, k / 99.0::DOUBLE AS g FROM (SELECT DISTINCT fold FROM sc), (SELECT unnest(range(100)) AS k)),
lh AS (SELECT gd.fold, k, g, max({'x': x, 'y': y}) FILTER (round(x * 99, 9) <= k) AS a, min({'x': x, 'y': y}) FILTER (round(x * 99, 9) > k) AS b FROM gd JOIN pt ON pt.fold = gd.fold GROUP BY 1, 2, 3),
mc AS (SELECT k, g AS fpr, CASE WHEN k = 0 THEN 0.0 WHEN k = 99 THEN 1.0 ELSE avg(CASE WHEN b IS NULL THEN a.y ELSE a.y + (b.y - a.y) * (g - a.x) / (b.x - a.x) END) END AS tpr FROM lh GROUP BY 1, 2)"""


@query("m14_mean_curve", "SELECT round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM mc", MEAN_CURVE)
def m14_mean(spark, d):
    return rounded(mean_curve(_scores(spark, d)))


@query("m14_area_of_mean_curve", "SELECT round(sum(s), 6) AS auc FROM (SELECT (fpr - lag(fpr) OVER (ORDER BY k)) * (tpr + lag(tpr) OVER (ORDER BY k)) / 2 AS s FROM mc)", MEAN_CURVE)
def m14_area(spark, d):
    return rounded(area(mean_curve(_scores(spark, d))))


@query("m14_roc_curve", """SELECT p, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT p, sum(pos) OVER (ORDER BY p DESC) / sum(pos) OVER () AS tpr, sum(neg) OVER (ORDER BY p DESC) / sum(neg) OVER () AS fpr FROM (SELECT p_size::DOUBLE AS p, sum(l)::DOUBLE AS pos, sum(1 - l)::DOUBLE AS neg FROM (SELECT p_size, (p_partkey % 3 = 0)::INT AS l FROM part) GROUP BY 1))""")
def m14(spark, d):
    s = table(spark, d, "part").select(F.col("p_size").cast("double").alias("p"), (F.col("p_partkey") % 3 == 0).cast("double").alias("label"))
    return rounded(roc(s))


@query("m15_evaluation", """SELECT l AS label, q AS predicted, count(*) AS n FROM (SELECT (p_partkey % 3 = 0)::INT AS l, (p_size >= 25)::INT AS q FROM part) GROUP BY ALL""")
def m15(spark, d):
    return table(spark, d, "part").groupBy((F.col("p_partkey") % 3 == 0).cast("int").alias("label"), (F.col("p_size") >= 25).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@query("m15_metrics", """SELECT round((sum(l * r) - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc, round(avg((l = q)::INT), 6) AS accuracy, sum(l * q)::BIGINT AS tp, sum((1 - l) * q)::BIGINT AS fp, sum(l * (1 - q))::BIGINT AS fn, sum((1 - l) * (1 - q))::BIGINT AS tn
  FROM (SELECT l, q, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r, (sum(l) OVER ())::DOUBLE AS n1, (count(*) OVER ())::DOUBLE AS n FROM (SELECT p_size / 51.0::DOUBLE AS p, (p_size >= 25.5)::INT AS q, (p_partkey % 7 < p_size / 20.0::DOUBLE)::INT AS l FROM part)) GROUP BY n1, n""")
def m15_metrics(spark, d):
    return rounded(evaluated(_scores(spark, d).withColumn("p", F.col("p") / 51)))


def evaluated(scored, limit: float = 0.5):
    """One row: the area, the accuracy and the four counts of scored rows (label, p)."""
    q = (F.col("p") >= limit).cast("int")
    one = lambda a, b: F.count(F.when((F.col("label") == a) & (q == b), 1))
    counts = scored.agg(F.avg((F.col("label") == q).cast("int")).alias("accuracy"), one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    return auc(scored).crossJoin(counts)


@query("m14_auc", """SELECT round((sum(l * r) - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) AS auc FROM (SELECT l, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r, (sum(l) OVER ())::DOUBLE AS n1, (count(*) OVER ())::DOUBLE AS n FROM (SELECT p_size AS p, (p_partkey % 3 = 0)::INT AS l FROM part)) GROUP BY n1, n""")
def m14_auc(spark, d):
    return rounded(auc(table(spark, d, "part").select(F.col("p_size").cast("double").alias("p"), (F.col("p_partkey") % 3 == 0).cast("double").alias("label"))))


@query("m16_importances")
def m16(spark, d):
    got = fitted(labelled(spark, d)).stages[-1].featureImportances.toArray()
    top = max(got.max(), 1e-12)
    rows = [(f, float(v / top)) for f, v in zip(KINDS, got, strict=True)]
    return rounded(spark.createDataFrame(rows, "f string, importance double").orderBy(F.desc("importance"), "f").limit(10), 4)


EMBEDDED = "em AS (SELECT vec_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query("a12_gram_correlations", "SELECT a.k::INT AS a, b.k::INT AS b, round(corr(a.v, b.v), 5) + 0.0 AS r FROM em a JOIN em b ON a.vec_id = b.vec_id AND a.k < b.k GROUP BY 1, 2", EMBEDDED)
def a12_gram(spark, d):
    """The correlations of many columns (embeddings) from sums of products taken task by task."""
    return rounded(_embedded(spark, d, F.lit(False)).select("a", "b", "r"), 5)


@query("a12_gapped_correlations", "SELECT a.k::INT AS a, b.k::INT AS b, count(*) AS n, round(corr(a.v, b.v), 5) + 0.0 AS r FROM em a JOIN em b ON a.vec_id = b.vec_id AND a.k < b.k WHERE (a.vec_id + a.k * 3) % 7 <> 0 AND (b.vec_id + b.k * 3) % 7 <> 0 GROUP BY 1, 2", EMBEDDED)
def a12_gapped(spark, d):
    """The same over the rows that have both, with a seventh of the values missing."""
    return rounded(_embedded(spark, d, lambda k: (F.col("vec_id") + k * 3) % 7 == 0), 5)


def _embedded(spark, d, gap):
    rows = table(spark, d, "embeddings").where("embedding is not null")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    missing = gap if callable(gap) else lambda k: gap
    return gram.correlations(rows.select(F.transform("embedding", lambda v, k: F.when(~missing(k), v.cast("double"))).alias("x")), width)
