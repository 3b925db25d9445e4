"""Near-duplicate groups of documents by min-max hashing, banding and confirmed links.

Each document's shingles are hashed once; under each of PERMUTATIONS permutations both the smallest and the
largest value are kept. Bands of ROWS minima and bands of ROWS maxima are the buckets: two documents of
similarity s share none of 2 * PERMUTATIONS / ROWS bands with probability (1 - s^4)^32, 5e-6 at s = 0.75.

Documents with equal sets are one class from the start. In every bucket each class is first compared with the
bucket's smallest id. Classes of buckets that hold several groups afterwards are compared if they share one of their
rarest shingles, without which no two sets are similar enough, and no bound rules a link out: the
distances to a common neighbour (1 - similarity is a metric), or the bits that both sets have in a bitmap of BITS
bits, plus the shingles that share a bit, which no intersection exceeds. Links count only if the full sets confirm them. Groups are the links' connected components.

Defined cases: a document without words or with null text has an empty set and stays alone; with fewer than
`size` words the whole sequence is its one shingle. Equal rows are linked like any equal sets. Rows with equal
ids and different sets belong to the groups of their sets; sets whose smallest id is the same share a node, and
links are confirmed on the smaller of them. n_shingles is each row's own. A null id is a document like
others, its component_id is null and it is kept. Very long texts are hashed whole. An empty table gives an
empty result. Extra columns are kept by `keep_one_of_each` and else not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _common as c, _text as t

SIZE = 5
PERCENT = 75
PERMUTATIONS, ROWS = 64, 4
BITS = 2048
_NULL = -(2**63)
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(hashes: np.ndarray) -> np.ndarray:
    """The PERMUTATIONS minima, then the maxima."""
    low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(hashes), 1024):
        x = (hashes[None, at : at + 1024] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS values."""
    v = t.mix(values.reshape(-1, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = np.arange(1, len(v) + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(ROWS):
        key = t.mix(key ^ v[:, i])
    return key.view(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """BITS bits as longs, one set for each hash."""
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _each(docs: DataFrame, size: int, schema: str, make) -> DataFrame:
    """make(ids, sets) -> arrays, for the documents of each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, off = t.bytes_of(batch.column("text"))
            ids = t.ids_of(batch.column("id"))
            for lo, hi in t.slices(off):
                sets = list(t.shingle_hashes(b[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], size))
                arrays = make(ids[lo:hi], sets)
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").transform(c.in_arrow, run, schema)


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """id (null as the smallest long), n, set identity s1 and s2, bands, bitmap and how many shingles share a bit with another."""

    def make(ids, sets):
        none = np.zeros(0, np.int64)
        bands = [band_keys(min_max(x)) if len(x) else none for x in sets]
        s1 = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
        s2 = np.array([t.mix(x).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64)
        maps = [bitmap(x) if len(x) else none for x in sets]
        shared = [len(x) - int(np.bitwise_count(m.view(np.uint64)).sum()) for x, m in zip(sets, maps, strict=True)]

        def lists(parts):
            off = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else none))

        return [pa.array(ids), pa.array([len(x) for x in sets], pa.int64()), pa.array(s1), pa.array(s2), lists(bands), lists(maps), pa.array(shared, pa.int64())]

    return _each(docs, size, "id long, n long, s1 long, s2 long, bands array<long>, bits array<long>, slack long", make)


def full_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """id, set: the sorted shingle hashes."""

    def make(ids, sets):
        off = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return [pa.array(ids), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))]

    return _each(docs, size, "id long, set array<long>", make)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node, comp: the smallest node reachable, for every node of edges (a, b); alternating large and small stars until every group is one star."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = c.settle(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(edges):
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        around = both(edges)
        near = c.settle(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        large = around.where("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = c.settle(large, name)
        # small star: smaller neighbours and the node itself are linked to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, c.settle(small, name)
        c.forget(before, near, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (a, b), a > b, has larger neighbours only, or one neighbour that is such a node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    per = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("k"))
    return per.where("up > 1 or (up = 1 and k > 1)").count() == 0


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, sim (inter, union) of pairs (a, b) by their full sets."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    inter = F.size(F.array_intersect("x", "y")).cast("long")
    return both.select("a", "b", inter.alias("i"), (F.size("x") + F.size("y")).cast("long").alias("s")).select("a", "b", "i", (F.col("s") - F.col("i")).alias("u"), (100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).alias("ok"))


def groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """id, n, comp for every row of docs."""
    sig = c.settle(signatures(docs, size), "sig", 1 << 20)
    classes = sig.where("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "bands", "bits", "slack")).alias("r"))
    classes = c.settle(classes.select("s1", "s2", "n", "r.*"), "classes")
    band = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = c.settle(band.groupBy("band").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("k")).where("k > 1").select("band", "centre"), "shared")
    member = c.settle(band.join(shared, "band"), "member")
    involved = c.settle(member.select("id").distinct(), "involved")
    rows = involved.count()
    if not rows:
        links = docs.sparkSession.createDataFrame([], "node long, comp long")
        return _labelled(sig, classes, links)
    mine = c.join_by_size(docs.select("doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL))), involved.withColumnRenamed("id", "_id"), "_id", "left_semi", involved)
    sets = c.settle(full_sets(mine, size).groupBy("id").agg(F.min("set").alias("set")), "sets", 1 << 20)

    # one centre for each class, the smallest of its buckets', then the other centres while groups are apart
    star = member.where("id <> centre")
    tried = c.settle(_confirmed(star.groupBy(F.col("id").alias("a")).agg(F.min("centre").alias("b")), sets, percent), "tried")
    comp = _with_all(components(tried.where("ok")), involved)
    apart = star.select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    more = c.settle(_confirmed(_between(apart, comp), sets, percent), "tried")
    tried = tried.unionByName(more)
    comp = _linked(comp, more.where("ok"))

    # buckets that still hold several groups: their classes are compared by their rarest shingles
    placed = c.settle(member.join(comp.select(F.col("node").alias("id"), "comp"), "id"), "placed")
    mixed = c.settle(_several(placed, "band"), "mixed")
    if mixed.isEmpty():
        return _labelled(sig, classes, comp)
    open_ = c.settle(placed.join(mixed, "band").select("id", "comp").distinct(), "open")
    pairs = c.settle(_candidates(sets.join(open_, "id"), percent), "pairs")
    done = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = tried.select(F.col("a").alias("id"), F.col("b").alias("c"), (1 - F.col("i") / F.col("u")).alias("d")).groupBy("id").agg(F.min(F.struct("c", "d")).alias("near"))
    kept = c.settle(classes.select("id", "n", "bits", "slack").join(open_.select("id"), "id").join(near, "id", "left"), "kept")
    side = lambda x, k: kept.select(F.col("id").alias(x), F.struct("n", "bits", "slack", F.col("near.c").alias("c"), F.col("near.d").alias("d")).alias(k))
    both = pairs.join(done, ["a", "b"], "left_anti").join(side("a", "x"), "a").join(side("b", "y"), "b")
    far = 1 - percent / 100 + 1e-9
    apart = F.coalesce((F.col("x.c") == F.col("y.c")) & (F.abs(F.col("x.d") - F.col("y.d")) > far), F.lit(False))
    shared_bits = F.aggregate(F.zip_with("x.bits", "y.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda a, x: a + x)
    most = F.least(shared_bits + F.least("x.slack", "y.slack"), "x.n", "y.n")
    alike = 100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)
    last = c.settle(_confirmed(both.where(~apart & alike).select("a", "b"), sets, percent), "tried")
    return _labelled(sig, classes, _linked(comp, last.where("ok")))


def _several(rows: DataFrame, key: str) -> DataFrame:
    """The keys of rows (key, id, comp) under which several groups meet, and the largest of these."""
    sizes = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("k"))
    return sizes.groupBy(key).agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select(key, F.col("top.comp").alias("main"))


def _candidates(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs a > b of sets (id, set, comp) of different groups that may reach `percent`, ids alone.

    Sets of n shingles that reach it share one of the n - ceil(percent * n / 100) + 1 rarest ones of each (the rarest
    in one order for all), so shingles that many unlike sets have in common bring no pairs. From the first shared one
    on, both have enough others left: what comes before it isn't shared. Under a shingle, sets outside its largest
    group meet all others.
    """
    shingle = sets.select("id", "comp", F.size("set").alias("n"), F.explode("set").alias("s"))
    often = shingle.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    ranked = shingle.join(often, "s").groupBy("id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("t"))  # one set's
    alone = F.col("n") - F.size("t")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1 - alone
    rare = ranked.withColumn("p", prefix).where("p > 0").select("id", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), F.col("p"))).alias("at", "t"))
    rare = c.settle(rare.select("id", "comp", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("rest"), F.col("t.s").alias("s")), "rare")
    meet = c.settle(_several(rare, "s"), "meet")
    rows = c.settle(rare.join(meet, "s"), "rows")
    few = rows.where("comp <> main").select("s", *[F.col(x).alias(x + "1") for x in ("id", "n", "comp", "rest")])
    enough = (100 + percent) * F.least("rest", "rest1") >= percent * (F.col("n") + F.col("n1"))
    pairs = few.join(rows, "s").where("comp <> comp1 and (comp = main or id < id1)").where(enough)
    return pairs.select(F.greatest("id", "id1").alias("a"), F.least("id", "id1").alias("b")).distinct()


def _with_all(comp: DataFrame, nodes: DataFrame) -> DataFrame:
    """comp with the nodes that have no link, each its own group."""
    alone = nodes.select(F.col("id").alias("node")).join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    return c.settle(alone, "comp")


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose two nodes are in different groups, ca and cb."""
    a = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
    b = comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    return pairs.join(a, "a").join(b, "b").where("ca <> cb").select("a", "b", "ca", "cb")


def _linked(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp with the groups that links (a, b) connect made one: a search among groups, whose members take no part in it."""
    up = components(_between(links.select("a", "b"), comp).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    up = c.settle(up.select(F.col("node").alias("comp"), F.col("comp").alias("first")), "up")
    return c.settle(c.join_by_size(comp, up, "comp", "left").select("node", F.coalesce("first", "comp").alias("comp")), "comp")


def _labelled(sig: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    named = classes.select("s1", "s2", "n", "id").join(comp, F.col("id") == F.col("node"), "left")
    named = c.settle(named.select("s1", "s2", "n", F.coalesce("comp", "id").alias("comp")), "named")
    out = sig.select("id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    return out.select("id", "n", F.coalesce("comp", "id").alias("comp"))


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    found = groups(docs, size, percent)
    back = lambda x: F.when(F.col(x) != _NULL, F.col(x))
    return found.select(back("id").alias("doc_id"), F.col("n").alias("n_shingles"), back("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """docs without the rows whose group has a smaller id."""
    c.small_batches(spark)
    found = c.settle(groups(docs), "groups")
    key, names = c.free(docs, "_gone"), docs.columns
    gone = c.settle(found.where("id <> comp").select(F.col("id").alias(key)).distinct(), "gone")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)))
    return c.join_by_size(keyed, gone, key, "left_anti").select(*names)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.i >= 75 * (x.n + y.n - p.i)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT k.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, k.doc_id = k.component_id AS kept FROM k LEFT JOIN n USING (doc_id)
"""
