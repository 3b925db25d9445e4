"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query of a block. Each task counts its scores in a histogram for
each query, the counts are summed by Spark, and the bin that holds the k-th score becomes the next, finer
histogram's range, until a bin is one score wide. Ties at the k-th score are cut by the same selection over
ids. A last scoring keeps exactly the rows above the cuts.

Queries are handled in blocks of bounded size, which travel with the tasks; candidates never move.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no part, nor does
a row with a null id. A query meets the vectors of its own length only; each length is searched by itself (of query
rows with equal ids and lengths the smallest vector is the query). Equal query rows count once; repeated
candidate rows are candidates each. Fewer than k candidates: all. Ties go to the smaller id. An empty table
or no query gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import _common as c

K = 20
SCALE = 64
BINS = 256
#: Queries of a block, about; also bounds what the driver holds.
BLOCK = 4096
#: Candidates scored at once.
ROWS = 512


def whole_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, v: floor(scale * x) of each component as long."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return good.select(F.col("vec_id").cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(column, dim: int, kind) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)


class _Block:
    """Queries of one block and how far their cuts are known."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: np.ndarray, kind):
        self.ids, self.vectors, self.kind, self.k = ids, vectors.astype(kind), kind, k
        n = len(ids)
        self.low = -bound - 1
        self.width = np.maximum(1, -(-(2 * bound + 3) // BINS))
        self.need = np.full(n, k, np.int64)  # still to be found at or below the range's top
        self.score = None  # the k-th score of each, once known
        self.id_cut = None


def _scores(block: _Block, batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, scores (rows x queries), and which of them count."""
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    v = _matrix(batch.column("v"), dim, block.kind)
    for at in range(0, len(ids), ROWS):
        own = ids[at : at + ROWS]
        s = (v[at : at + ROWS] @ block.vectors.T).astype(np.int64)
        ok = np.ones(s.shape, bool)
        where = np.minimum(np.searchsorted(block.ids, own), len(block.ids) - 1)
        same = np.flatnonzero(block.ids[where] == own)
        ok[same, where[same]] = False
        yield own, s, ok


def _histogram(vectors: DataFrame, block: _Block, dim: int, low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray, by_id: bool) -> dict[int, dict[int, int]]:
    """For each query the counts of its highest bins from low to below high, down to the need-th value's at least.

    Values are scores, or the negative ids of the rows that tie at block.score. A task leaves out the bins
    below that of its own need-th value: the need-th of all rows isn't there.
    """
    n = len(block.ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, BINS), np.int64)
        for batch in batches:
            for ids, s, ok in _scores(block, batch, dim):
                value = s
                if by_id:
                    ok &= s == block.score
                    value = np.broadcast_to(-ids[:, None], s.shape)
                place = (value - low) // width
                ok &= (place >= 0) & (value < high)
                place += np.arange(n) * BINS
                total += np.bincount(place[ok], minlength=n * BINS).reshape(n, BINS)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < need[:, None]))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(total[q, b], pa.int64())], names=["q", "b", "n"])

    counted = vectors.transform(c.in_arrow, count, "q int, b int, n long").groupBy("q", "b").agg(F.sum("n").alias("n")).toArrow()
    found: dict[int, dict[int, int]] = {}
    for q, b, m in zip(*(counted.column(x).to_pylist() for x in ("q", "b", "n")), strict=True):
        found.setdefault(q, {})[b] = m
    return found


def _select(vectors: DataFrame, block: _Block, dim: int, low: np.ndarray, width: np.ndarray, need: np.ndarray, by_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The need-th highest value of each query, how many of that value are needed, and how many there are.

    A query with fewer values gets the lowest value its range has.
    """
    low, width, need = low.copy(), width.copy(), need.copy()
    high = low + width * BINS
    there = np.zeros(len(need), np.int64)
    open_ = need > 0
    while True:
        found = _histogram(vectors, block, dim, low, high, width, np.where(open_, need, 0), by_id)
        for q in np.flatnonzero(open_):
            rest, last = need[q], 0
            for b, m in sorted(found.get(q, {}).items(), reverse=True):
                last = b
                if m >= rest:
                    there[q] = m
                    break
                rest -= m
            else:
                rest, last, there[q] = 0, 0, 0  # fewer than needed: all are in
                open_[q] = False
            need[q] = rest
            low[q] += last * width[q]
            high[q] = low[q] + width[q]
            if width[q] == 1:
                open_[q] = False
            width[q] = max(1, -(-int(width[q]) // BINS)) if open_[q] else width[q]
        if not open_.any():
            return low, need, there


def _search_block(vectors: DataFrame, block: _Block, dim: int, id_low: int, id_high: int) -> DataFrame:
    score, need, there = _select(vectors, block, dim, block.low, block.width, block.need, False)
    block.score = score
    cut = np.full(len(block.ids), id_high, np.int64)
    if (tied := there > need).any():
        width = np.full(len(cut), max(1, -(-(id_high - id_low + 1) // BINS)), np.int64)
        last, _, _ = _select(vectors, block, dim, np.full(len(cut), -id_high, np.int64), width, np.where(tied, need, 0), True)
        cut[tied] = -last[tied]
    block.id_cut = cut

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, s, ok in _scores(block, batch, dim):
                ok &= (s > block.score) | ((s == block.score) & (ids[:, None] <= block.id_cut))
                r, q = np.nonzero(ok)
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids[r]), pa.array(s[r, q])], names=["query_id", "vec_id", "score"])

    return vectors.transform(c.in_arrow, keep, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query, k: int = K, block_size: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of vectors (id, v) for each row that is_query (a condition on id) holds for.

    The vectors are settled as integers first, so no block parses them again; every block adds its rows to one folder.
    """
    spark = vectors.sparkSession
    vectors = c.settle(vectors.withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    kinds = vectors.groupBy(F.size("v").alias("dim")).agg(F.max(square).alias("most"), F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.when(F.col("query"), 1)).alias("queries")).where("queries > 0")
    folder, schema = c.fresh_path(spark, "topk"), "query_id long, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)
    for dim, most, id_low, id_high, queries in kinds.orderBy("dim").collect():
        own = vectors.where(F.size("v") == dim)
        blocks = -(-queries // block_size)
        wanted = own.where("query").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
        for i in range(blocks):
            block = wanted.where(F.col("block") == i).groupBy("id").agg(F.min("v").alias("v")).toArrow().combine_chunks()
            if not block.num_rows:
                continue
            ids = block.column("id").to_numpy()
            v = _matrix(block.column("v").combine_chunks(), dim, np.int64)
            order = np.argsort(ids)
            bound = np.ceil(np.sqrt((v[order].astype(np.float64) ** 2).sum(axis=1) * most) * (1 + 1e-9)).astype(np.int64)
            kind = np.float64 if most < 2**50 and bound.max() < 2**50 else np.int64  # doubles add such integers exactly
            _search_block(own.select("id", "v"), _Block(ids[order], v[order], k, bound, kind), dim, id_low, id_high).write.mode("append").parquet(folder)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = spark.read.schema(schema).parquet(folder).select("query_id", rank.alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)  # equal ids at the cut come in together


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(whole_vectors(c.table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
