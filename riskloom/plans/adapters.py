"""Panels and feature tables derived from the generated tables, in Spark and as SQL text for the oracle.

Values are ratios of whole numbers, so both engines get the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    """Register a query; sql follows the named CTEs and is left out where SQL can't express the result."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, and -0.0 as 0.0."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MEASURES = {"price": "l_extendedprice", "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


def _whole(column: str):
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e nation, i measure, t first day of a quarter's last month, v mean."""
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("e"))
    t = F.make_date(F.year("l_shipdate"), F.quarter("l_shipdate") * 3, F.lit(1))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", *MEASURES.values(), "l_returnflag", t.alias("t")).join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    n = F.count(F.lit(1))
    wide = rows.groupBy("e", "t").agg(*[(_whole(c) / n / 100).alias(i) for i, c in MEASURES.items()], (F.sum((F.col("l_returnflag") == "R").cast("long")) / n).alias("returned"))
    return wide.unpivot(["e", "t"], [*MEASURES, "returned"], "i", "v")


PN = """lw AS (SELECT n_name AS e, make_date(year(l_shipdate), quarter(l_shipdate) * 3, 1) AS t, count(*) AS n,
  sum(round(l_extendedprice * 100)::BIGINT) AS price, sum(round(l_quantity * 100)::BIGINT) AS quantity, sum(round(l_discount * 100)::BIGINT) AS discount,
  sum(round(l_tax * 100)::BIGINT) AS tax, sum((l_returnflag = 'R')::INT) AS returned
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
pn AS (SELECT e, t, 'price' AS i, price::DOUBLE / n / 100 AS v FROM lw UNION ALL SELECT e, t, 'quantity', quantity::DOUBLE / n / 100 FROM lw
  UNION ALL SELECT e, t, 'discount', discount::DOUBLE / n / 100 FROM lw UNION ALL SELECT e, t, 'tax', tax::DOUBLE / n / 100 FROM lw
  UNION ALL SELECT e, t, 'returned', returned::DOUBLE / n FROM lw)"""


#: Six dimensions of a nation: the panel's five and the number of lines.
DIMENSIONS = (*MEASURES, "returned", "lines")


def dimension_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_panel with the number of lines as a sixth indicator."""
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("e"))
    t = F.make_date(F.year("l_shipdate"), F.quarter("l_shipdate") * 3, F.lit(1))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", t.alias("t")).join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    lines = rows.groupBy("e", "t").agg(F.count(F.lit(1)).cast("double").alias("v")).select("e", "t", F.lit("lines").alias("i"), "v")
    return nation_panel(spark, sf_dir).unionByName(lines)


PD = PN + ",\npd AS (SELECT e, t, i, v FROM pn UNION ALL SELECT e, t, 'lines', n::DOUBLE FROM lw)"


def user_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e user, i event type, t day, v mean value."""
    v = F.sum(F.round(F.col("value") * 10000).cast("long")) / F.count(F.lit(1)) / 10000
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("e"), F.col("event_type").alias("i"), F.to_date("ts").alias("t")).agg(v.alias("v"))


PU = """pu AS (SELECT user_id::VARCHAR AS e, event_type AS i, ts::DATE AS t, sum(round(value * 10000)::BIGINT)::DOUBLE / count(*) / 10000 AS v FROM events GROUP BY 1, 2, 3)"""

FEATURES = ("price", "quantity", "discount", "tax", "returned", "balance")


def supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, nation and six features of each supplier; every seventh value or so is null by key arithmetic."""
    n = F.count(F.lit(1))
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*[(_whole(c) / n / 100).alias(i) for i, c in MEASURES.items()], (F.sum((F.col("l_returnflag") == "R").cast("long")) / n).alias("returned"))
    rows = table(spark, sf_dir, "supplier").join(own, F.col("s_suppkey") == F.col("l_suppkey"), "left").withColumn("balance", F.col("s_acctbal"))
    return rows.select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), *[F.when((F.col("s_suppkey") + k) % 7 != 0, F.col(f)).alias(f) for k, f in enumerate(FEATURES)])


XS = """xo AS (SELECT l_suppkey, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS price, sum(round(l_quantity * 100)::BIGINT)::DOUBLE / count(*) / 100 AS quantity,
  sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) / 100 AS discount, sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*) / 100 AS tax, sum((l_returnflag = 'R')::INT)::DOUBLE / count(*) AS returned FROM lineitem GROUP BY 1),
xs AS (SELECT s_suppkey AS key, s_nationkey AS nation, CASE WHEN s_suppkey % 7 <> 0 THEN price END AS price, CASE WHEN (s_suppkey + 1) % 7 <> 0 THEN quantity END AS quantity,
  CASE WHEN (s_suppkey + 2) % 7 <> 0 THEN discount END AS discount, CASE WHEN (s_suppkey + 3) % 7 <> 0 THEN tax END AS tax, CASE WHEN (s_suppkey + 4) % 7 <> 0 THEN returned END AS returned,
  CASE WHEN (s_suppkey + 5) % 7 <> 0 THEN s_acctbal END AS balance FROM supplier LEFT JOIN xo ON s_suppkey = l_suppkey)"""


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, f, v of supplier_features; nulls stay."""
    return supplier_features(spark, sf_dir).unpivot(["key"], list(FEATURES), "f", "v")


XL = XS + """,
xl AS (""" + " UNION ALL ".join(f"SELECT key, '{f}' AS f, {f} AS v FROM xs" for f in FEATURES) + ")"  # fmt: skip


def error_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """e, start, end: runs of days (as numbers) on which a user had an error."""
    from pyspark.sql import Window as W

    days = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("e"), F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).alias("d")).distinct()
    island = F.col("d") - F.row_number().over(W.partitionBy("e").orderBy("d"))
    return days.withColumn("g", island).groupBy("e", "g").agg(F.min("d").alias("start"), F.max("d").alias("end")).drop("g")


IV = """id AS (SELECT DISTINCT user_id AS e, (ts::DATE - DATE '2020-01-01')::INT AS d FROM events WHERE event_type = 'error'),
ig AS (SELECT e, d, d - row_number() OVER (PARTITION BY e ORDER BY d) AS g FROM id), iv AS (SELECT e, min(d) AS s, max(d) AS z FROM ig GROUP BY e, g)"""
