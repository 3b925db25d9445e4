"""URL filters as Bloom filter cascades: exact membership over a corpus's keys, without joins when judging.

A rule is a host and a path written together (`example.org/es/`). It fits its host and all subdomains when
the url's path starts with the rule's; the longest fitting rule decides. Level 0 of a cascade encodes the
listed keys, level 1 the keys of the corpus that level 0 lets through wrongly, level 2 the listed keys that
level 1 lets through wrongly, and so on until nothing is wrong; the first level that a key misses tells
whether it is listed. Building looks at every key of the corpus once; judging evaluates literals.

All work is DataFrame expressions. A filter has at most `max_bits` bits, whatever is listed; past that its
error rate rises and levels are added, and the answer stays exact.

Defined cases: a null url or one without `://` has empty host and path and fits no rule. Repeated rows are
judged one by one. Rules of equal length that fit: block wins. No rules: every url gets the default. An empty
table gives an empty result. Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _common as c

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: For a url that no rule fits: it isn't on the block list, so it passes.
DEFAULT = "allow"
BITS_PER_KEY, HASHES, MAX_BITS = 10, 5, 1 << 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes(keys: Sequence[str]) -> list[tuple[int, int]]:
    """The (labels of the host, characters of the path) that keys have."""
    found = set()
    for key in keys:
        host, slash, path = key.partition("/")
        found.add((host.count(".") + 1, len(slash + path)))
    return sorted(found)


def candidate(host: Column, path: Column, labels: int, chars: int) -> Column:
    """The key of one shape that would fit, or null."""
    enough = (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars) & (host != "")
    return F.when(enough, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))


def _places(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 1000 + i)), F.lit(bits)) for i in range(hashes)]


class Bloom:
    """One level: its words of 64 bits and what is needed to look a key up in them."""

    def __init__(self, level: int, bits: int, hashes: int, words: list[int]):
        self.level, self.bits, self.hashes, self.words = level, bits, hashes, words

    @classmethod
    def of(cls, keys: DataFrame, n: int, level: int, hashes: int = HASHES, max_bits: int = MAX_BITS) -> Bloom:
        bits = 64
        while bits < min(max_bits, n * BITS_PER_KEY):
            bits *= 2
        at = keys.select(F.explode(F.array(*_places(F.col("key"), level, bits, hashes))).alias("p"))
        word = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        words = [0] * (bits // 64)
        for row in word.collect():  # bits / 64 rows at most
            words[row["w"]] = row["b"]
        return cls(level, bits, hashes, words)

    def has(self, key: Column) -> Column:
        words = F.expr("cast(split('" + ",".join(map(str, self.words)) + "', ',') as array<bigint>)")
        hit = F.lit(True)
        for p in _places(key, self.level, self.bits, self.hashes):
            word = F.element_at(words, (F.shiftright(p, 6) + 1).cast("int"))
            hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
        return hit


def cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Bloom]:
    """The levels that tell listed keys (column key) from all other keys of universe (column key)."""
    inside = c.settle(listed.where("key is not null").select("key").distinct(), "listed")
    levels, n = [], inside.count()
    first = Bloom.of(inside, n, 0, max_bits=max_bits)
    levels.append(first)
    passed = universe.where(F.col("key").isNotNull() & first.has(F.col("key"))).select("key").distinct()
    outside = c.settle(passed.join(inside, "key", "left_anti"), "passed")
    tested = inside
    while n := outside.count():
        if len(levels) > 60:
            raise ValueError("the filters are too small for the keys; raise max_bits")
        levels.append(Bloom.of(outside, n, len(levels), max_bits=max_bits))
        wrong = c.settle(tested.where(levels[-1].has(F.col("key"))), "wrong")
        tested, outside = outside, wrong
    return levels


def member(levels: Sequence[Bloom], key: Column) -> Column:
    """Whether key is listed: exact for listed keys and all keys of the universe."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[i].has(key), F.lit(i % 2 == 1)).otherwise(answer)
    return F.coalesce(answer, F.lit(False))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, default: str = DEFAULT, max_bits: int = MAX_BITS) -> DataFrame:
    """pages with _host, _path, _rule, _verdict."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("_url"))
    keyed = pages.withColumn("_url", F.col("url").cast("string")).withColumns({"_host": host, "_path": path}).drop("_url")
    found = []
    for verdict in ("allow", "block"):
        own = [k for v, k in rules if v == verdict]
        if not own:
            continue
        forms = [candidate(F.col("_host"), F.col("_path"), *x) for x in shapes(own)]
        universe = keyed.select(F.explode(F.array(*forms)).alias("key"))
        levels = cascade(spark.createDataFrame([(k,) for k in own], "key string"), universe, max_bits)
        found += [F.when(member(levels, f), F.struct(F.length(f).alias("n"), F.lit(verdict == "block").alias("b"), f.alias("k"))) for f in forms]
    best = F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast("struct<n:int,b:boolean,k:string>")
    out = keyed.withColumn("_best", best)
    verdict = F.when(F.col("_best").isNull(), F.lit(default)).when(F.col("_best.b"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumns({"_rule": F.col("_best.k"), "_verdict": verdict}).drop("_best")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(c.table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"))


OP7_SQL = r"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, host, path, h || p AS rule, verdict,
      row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
      FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
