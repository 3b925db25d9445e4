"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a schedule over training time u in [0, 1], here linear with a slope of its own:
rate(u) = target * (1 + slope * (2u - 1)). Its integral is the source's cumulative demand of words,
D(u) = target * (u + slope * (u^2 - u)). A document's copy that ends the source's first c words is trained on
where demand reaches the middle of its words: position = D^-1(c - size / 2). A range sort by position gives the order of training.

Everything is DataFrame expressions. Running totals inside a source are taken in two steps, over buckets of
the id's hash and then inside each bucket, so one source may hold any share of the rows.

Defined cases: a null text has size 0, is never counted and is never taken more than its source's whole
rounds; null is a source of its own, last in order; rows with equal ids are ordered by their text;
equal rows are taken one by one. Sources without words get target 0. An empty table gives an
empty mix. Further columns are carried along; names that clash with the operator's own are the caller's
(the operator works on prefixed ones).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import _common as c

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Slopes of the schedules, repeating like the weights; between -1 and 1.
SLOPES = (-0.6, 0.0, 0.6)
#: Buckets of a source's running totals, at least, and rows for which one more is made; the mix doesn't depend on them.
BUCKETS, BUCKET_ROWS = 256, 100_000


def words(text: str = "text") -> Column:
    """The number of words, from the places where one starts."""
    t = F.col(text)
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """source, source_size, target, slope for each source of sizes (source, size); a row for each source.

    The share of all sizes is dealt by weight; a target stops at `most` times its source's size and the excess is
    dealt anew. A source is capped when its size over weight is below the final level, so with the sources in order of
    size / weight the level follows from running totals, without rounds: it is the level of the first source
    that isn't capped, and later ones would only be lower.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("_i", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_i") % len(values) + 1).cast("int"))
    per = per.withColumn("_w", pick(weights)).withColumn("slope", pick(slopes))
    whole, ordered = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.orderBy(F.col("source_size") / F.col("_w"), "_i")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({
        "_need": F.sum("source_size").over(whole) * share,
        "_done": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most,
        "_left": F.sum("_w").over(ordered.rowsBetween(0, W.unboundedFollowing)),
    })
    level = (F.col("_need") - F.col("_done")) / F.col("_left")
    capped = level * F.col("_w") >= most * F.col("source_size")
    per = per.withColumn("_level", F.when(~capped, level)).withColumn("_level", F.max("_level").over(whole))
    target = F.when(F.col("_level").isNull() | (F.col("_level") * F.col("_w") >= most * F.col("source_size")), most * F.col("source_size")).otherwise(F.col("_level") * F.col("_w"))
    return per.select("source", "source_size", target.cast("double").alias("target"), "slope")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, slopes: Sequence[float] = SLOPES, buckets: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with _mix: struct(size, source_size, target, copies, taken, positions).

    All documents of a source are taken floor(target / source_size) times; of one more round those that come
    first by the hash of their id and whose middle lies before the words still missing, so that the words
    taken are within half a document of the target. positions has one entry for each copy.
    """
    names = list(keep) if keep else docs.columns
    buckets = buckets or max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    key = F.struct(F.md5(F.concat_ws("|", F.lit("mix"), F.col("doc_id").cast("string"))), F.col("doc_id"), F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select(F.struct(*names).alias("_row"), F.col("source").alias("_source"), words().alias("_size"), key.alias("_key"))
    rows = c.settle(rows, "sizes")
    prefix = F.conv(F.substring("_key.col1", 1, 8), 16, 10).cast("long")  # buckets follow the keys' order
    rows = rows.withColumn("_bucket", F.shiftright(prefix * buckets, 32).cast("int"))
    sums = c.settle(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")), "sums")  # sources x buckets rows
    first = F.coalesce(F.sum("_sum").over(W.partitionBy("_source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    goal = targets(sums.select(F.col("_source").alias("source"), F.col("_sum").alias("size")), weights, share, most, slopes)
    goal = goal.withColumnsRenamed({"source": "_s", "source_size": "_source_size", "target": "_target", "slope": "_slope"})
    starts = sums.withColumn("_first", first).drop("_sum").join(goal, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.withColumnsRenamed({"_source": "_s", "_bucket": "_b"})
    inside = F.sum("_size").over(W.partitionBy("_source", "_bucket").orderBy("_key").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_inside", inside).join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    full = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("long")
    end = F.col("_first") + F.col("_inside")
    missing = F.col("_target") - full * F.col("_source_size")
    copies = full + F.when(end - F.col("_size") / 2 < missing, 1).otherwise(0)
    copies = F.least(copies, F.lit(int(most)))
    #: A copy's last word in the source's stream of words, then the time at which demand reaches its middle.
    middle = lambda k: ((k * F.col("_source_size") + end - F.col("_size") / 2) / F.col("_target")).cast("double")
    a = F.col("_slope")

    def when(k: Column) -> Column:
        y = F.least(F.lit(1.0), middle(k))
        root = F.sqrt(F.greatest(F.lit(0.0), (1 - a) * (1 - a) + 4 * a * y))
        return F.when(F.abs(a) < 1e-9, y).otherwise((root - (1 - a)) / (2 * a))

    positions = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1), when)).otherwise(F.array().cast("array<double>"))
    rows = rows.withColumn("_copies", copies)
    out = F.struct(F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"), positions.alias("positions"))
    return rows.select("_row.*", out.alias("_mix"))


def training_order(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs, one for each copy, range-sorted by position over the partitions.

    The mix is worked out on narrow rows and joined back by id, source and text, so that texts are shuffled by
    the sort alone. Of rows that are equal in these three, one stands for all copies of them.
    """
    names = docs.columns
    key, crc, place, places, n = (c.free(docs, x) for x in ("_doc", "_crc", "_position", "_positions", "_n"))
    own = docs.withColumns({key: F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()), crc: F.sha1(F.coalesce("text", F.lit("")))})
    mixed = mix(own, keep=[key, crc], **how).groupBy(key, crc).agg(F.flatten(F.collect_list("_mix.positions")).alias(places), F.count(F.lit(1)).alias(n))
    mixed = c.settle(mixed.where(F.size(places) > 0), "mixed")
    once = c.join_by_size(own, mixed.where(F.col(n) == 1).drop(n), [key, crc], "inner", mixed)
    again = c.join_by_size(own, mixed.where(F.col(n) > 1).drop(n), [key, crc], "inner", mixed).dropDuplicates([key, crc])
    copies = once.unionByName(again).select(*names, F.explode(places).alias(place))
    return copies.sort(place, "doc_id").select(*names)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    c.small_batches(spark)
    return training_order(docs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(c.table(spark, sf_dir, "documents"), keep=["doc_id"])
    m = F.col("_mix")
    out = mixed.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), m["taken"].alias("taken"), m["copies"].cast("int").alias("copies"), F.element_at(m["positions"], F.when(m["copies"] > 0, 1)).alias("first_position"))
    return out.sort(F.asc_nulls_last("first_position"), "doc_id")


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
q AS (SELECT *, CASE i % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
      CASE i % 3 WHEN 0 THEN -0.6::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END AS a FROM p),
r AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS need,
      coalesce(sum(source_size) OVER (ORDER BY source_size / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE AS done,
      sum(w) OVER (ORDER BY source_size / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM q),
s AS (SELECT *, max(CASE WHEN (need - done) / rest * w < 2.0 * source_size THEN (need - done) / rest END) OVER () AS level FROM r),
t AS (SELECT source, source_size, a, CASE WHEN level IS NULL OR level * w >= 2.0 * source_size THEN 2.0::DOUBLE * source_size ELSE level * w END AS target FROM s),
u AS (SELECT d.*, source_size, target, a,
      sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || d.doc_id::VARCHAR), d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS f FROM u),
x AS (SELECT *, least(f + CASE WHEN e - size / 2.0::DOUBLE < target - f * source_size THEN 1 ELSE 0 END, 2)::INTEGER AS copies FROM v),
y AS (SELECT *, least(1.0::DOUBLE, (e - size / 2.0::DOUBLE) / target) AS m FROM x)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN CASE WHEN abs(a) < 1e-9 THEN m ELSE (sqrt(greatest(0.0::DOUBLE, (1 - a) * (1 - a) + 4 * a * m)) - (1 - a)) / (2 * a) END END AS first_position
FROM y
"""
