"""Spelling variants of a corpus' words, found by pivotal grams.

Words one edit apart (a code point inserted, deleted or replaced) are near. Of two words each has two disjoint bigrams, its
pivots, of which one edit destroys one at most. All bigrams are ordered by the number of words they stand in (ties by code point):

1. A word's gram prefix is its three rarest bigrams, by that order and then by place, and up to two more places of the last one: an edit makes two
   new bigrams at most, which is how far places of equal bigrams can shift in the order. Of the first three, the two disjoint ones of least total
   frequency are its pivots, chosen by dynamic programming from left to right.
2. Of two near words, take the one whose last prefix gram comes first in the order: a pivot of it that the edit spares is in the other word's gram prefix.
3. Position limits: what stands on one side of the edit is the same in both words. If the edit is right of the left pivot, the words
   agree from their starts to that pivot's end, if it is left of the right pivot, from that pivot's start to their ends; one of both holds. What
   is left has the edit in one of its halves, so the other half agrees as well. A word is looked up by each gram of its prefix at its place,
   with all on one side of it and either half of the other side, and its length; it is indexed by its two pivots in the same way, for the three lengths that a
   near word may have. Common bigrams thus make no hot keys: words meet only if they share more than half of their letters at fixed places.
4. Candidates are verified by edit distance.

Each word's form is its commonest near word, if that is `times` as common; forms are followed to the root by pointer jumping, whose rounds
grow with the logarithm of the chains' lengths, themselves at most log(n) to base `times`.

Defined cases: a null text has no words, a null doc_id counts as an empty one. Rows are counted each, repeated ones too. A table without rows, or without words that are
long and common enough, gives no rows. Very long texts and words are handled whole. Extra columns aren't looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import _common as c

LETTERS = r"A-Za-zÀ-ÿ"
LETTER_COUNT = 26 + 64
LENGTH, LEAST, TIMES, ERROR = 7, 2, 10, 31
#: The edits that two near words may differ by; prefixes and pivots are made for one.
PREFIX, SHIFT = 3, 2
#: Code points of a word up to which Spark's distance is used.
SHORT = 64


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, run: every maximal run of letters of `length` code points at least, A-Z lower-cased."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"))
    plain = F.col("run").rlike("^[A-Za-z]*$")
    lowered = F.when(plain, F.lower("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    return found.select("doc_id", lowered.alias("run"))


def with_errors(run: Column, doc_id: Column, every: int = ERROR) -> Column:
    """The run, or the run without one code point if `every` divides the checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n of the words that are long and common enough."""
    return words.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _grams(word: Column) -> Column:
    """The bigrams of a word of letters, in order, each as a number below LETTER_COUNT squared; numbers are in code-point order."""
    code = F.transform(F.split(word, ""), lambda x: F.when(F.ascii(x) < 128, F.ascii(x) - ord("a")).otherwise(F.ascii(x) - ord("À") + 26))
    n = F.size(code) - 1
    return F.zip_with(F.slice(code, F.lit(1), n), F.slice(code, F.lit(2), n), lambda x, y: x * LETTER_COUNT + y)


def gram_weights(words: DataFrame) -> list[int]:
    """For each bigram the number of words that have it."""
    often = words.select(F.explode(F.array_distinct(_grams(F.col("word")))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("weight"))
    out = [0] * LETTER_COUNT**2
    for gram, weight in often.collect():  # a row for each bigram of the alphabet at most
        out[gram] = weight
    return out


def _prefix(ordered: Column) -> Column:
    """Of grams (rank, at, weight) in order the first PREFIX, and up to SHIFT more places of the last."""
    first = F.slice(ordered, 1, PREFIX)
    last = F.element_at(first, -1).getField("rank")
    return F.concat(first, F.filter(F.slice(ordered, PREFIX + 1, SHIFT), lambda x: x.getField("rank") == last))


def _pivots(first: Column) -> Column:
    """(left, right) places of the two disjoint grams of least total weight among the first of a prefix; ties to the leftmost.

    From left to right, the state is the best single gram so far that ends before the next one begins, and the best pair.
    """
    by_place = F.array_sort(F.transform(first, lambda x: F.struct(x.getField("at").alias("at"), x.getField("weight").alias("weight"))))

    def step(acc: Column, x: Column) -> Column:
        at, weight = x.getField("at"), x.getField("weight")
        free = F.filter(acc.getField("seen"), lambda y: y.getField("at") <= at - 2)  # grams that end before this one begins
        best = F.array_min(F.transform(free, lambda y: F.struct(y.getField("weight").alias("weight"), y.getField("at").alias("at"))))
        pair = F.when(best.isNotNull(), F.struct((best.getField("weight") + weight).alias("weight"), best.getField("at").alias("left"), at.alias("right")))
        return F.struct(F.concat(acc.getField("seen"), F.array(x)).alias("seen"), F.least(acc.getField("pair"), pair).alias("pair"))

    none = F.struct(F.expr("cast(array() as array<struct<at int, weight bigint>>)").alias("seen"), F.expr("cast(null as struct<weight bigint, left int, right int>)").alias("pair"))
    return F.aggregate(by_place, none, step, lambda acc: acc.getField("pair"))


def signatures(words: DataFrame, weights: list[int]) -> DataFrame:
    """word, n, prefix (rank, at, weight), last (rank of the last prefix gram), pivots (weight, left, right); places from 1."""
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>")  # noqa: E731  a constant
    order = sorted(range(len(weights)), key=lambda g: (weights[g], g))
    rank = [r for _, r in sorted((g, r) for r, g in enumerate(order))]
    grams = F.transform(_grams(F.col("word")), lambda g, i: F.struct(F.get(numbers(rank), g).alias("rank"), (i + 1).alias("at"), F.get(numbers(weights), g).alias("weight")))
    out = words.select("word", "n", F.array_sort(grams).alias("ordered"))
    out = out.select("word", "n", _prefix(F.col("ordered")).alias("prefix"), _pivots(F.slice("ordered", 1, PREFIX)).alias("pivots"))
    return out.select("word", "n", "prefix", F.get("prefix", F.lit(PREFIX - 1)).getField("rank").alias("last"), "pivots")


def _one_apart(a: Column, b: Column) -> Column:
    """Whether two different words are one edit apart; Spark's distance takes the square of a long word's length, so that is cut at the first difference."""
    first = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y)), True)
    rest = lambda x, y: F.substring(x, (first + (F.char_length(x) >= F.char_length(y)).cast("long")).cast("int"), F.char_length(x))
    short = F.greatest(F.char_length(a), F.char_length(b)) <= SHORT
    return F.when(short, F.levenshtein(a, b, 1) == 1).otherwise(rest(a, b) == rest(b, a))


def _head_keys(word: Column, at: Column, length: Column) -> list[Column]:
    """Two keys of a word and its gram at `at` for near words of `length` whose edit is behind that gram: all up to the gram's end with the first, or with the second half of the rest."""
    rest = F.greatest(length - at - 1, F.lit(0))
    half = F.floor(rest / 2).cast("int")
    return [F.xxhash64(F.lit(1), length, at, F.left(word, at + 1 + half)), F.xxhash64(F.lit(2), length, at, F.left(word, at + 1), F.right(word, rest - half))]


def _tail_keys(word: Column, size: Column, length: Column) -> list[Column]:
    """The same for an edit before a gram that begins `size` letters before the word's end."""
    rest = F.greatest(length - size, F.lit(0))
    half = F.floor(rest / 2).cast("int")
    return [F.xxhash64(F.lit(3), length, size, F.left(word, half), F.right(word, size)), F.xxhash64(F.lit(4), length, size, F.right(word, size + rest - half))]


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n for all words (word, n; settled) and all words near them, both ways round."""
    signed = c.settle(signatures(words, gram_weights(words)), "signed")
    word = F.col("word")
    index = signed.select(word, "n", "last", "pivots.left", "pivots.right", F.char_length("word").alias("l"))
    keys = [key for k in (-1, 0, 1) for key in (*_head_keys(word, F.col("left"), F.col("l") + k), *_tail_keys(word, F.col("l") - F.col("right") + 1, F.col("l") + k))]
    index = index.select(word.alias("a"), F.col("n").alias("an"), F.col("last").alias("alast"), F.explode(F.array_distinct(F.array(*keys))).alias("key"))
    asked = signed.select(word, "n", "last", F.char_length("word").alias("l"), F.explode("prefix.at").alias("at"))
    keys = (*_head_keys(word, F.col("at"), F.col("l")), *_tail_keys(word, F.col("l") - F.col("at") + 1, F.col("l")))
    asked = asked.select(word.alias("b"), F.col("n").alias("bn"), F.col("last").alias("blast"), F.explode(F.array(*keys)).alias("key"))
    may = (F.col("alast") <= F.col("blast")) & (F.col("a") != F.col("b"))
    met = index.join(asked, "key").where(may).where(_one_apart(F.col("a"), F.col("b")))
    ends = [F.struct(F.col(word).alias("w"), F.col(n).alias("k")) for word, n in (("a", "an"), ("b", "bn"))]
    found = met.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).distinct()
    pairs = c.settle(found, "near")
    c.forget(signed)
    side = lambda this, that: pairs.select(F.col(f"{this}.w").alias("word"), F.col(f"{this}.k").alias("n"), F.col(f"{that}.w").alias("other"), F.col(f"{that}.k").alias("other_n"))
    return side("x", "y").unionByName(side("y", "x"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form) that have a form: pointers jump until none moves."""
    at = c.settle(forms.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = c.settle(c.join_by_size(at, next_, "root", "left", at).select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        c.forget(at)
        at = moved
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = c.settle(words, "words")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= times * F.col("n")
    formed = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    formed = c.settle(formed, "formed")
    roots = rooted(formed)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(c.table(spark, sf_dir, "documents"))
    return variants(counted(found.select(with_errors(F.col("run"), F.col("doc_id")).alias("word"))))


#: Letters of more than one byte in UTF-8 for characters of one, so that the oracle's distance counts code points.
_ONE_BYTE = "translate({}, '" + "".join(map(chr, range(0xC0, 0x100))) + "', '" + string.ascii_uppercase + string.digits + "!#$%&()*+,-./:;<=>?@[]^_`{{|}}~' || chr(127))"
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) r(i) UNION ALL SELECT i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
occ AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
kinds AS (SELECT run, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM occ GROUP BY doc_id, run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda j: ('0x' || substr(x, (2 * j + 1)::BIGINT, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM kinds, crc),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(k) >= 2),
v AS (SELECT word, n, @ AS bytes FROM w WHERE length(word) >= 7),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON length(a.word) - length(b.word) BETWEEN -1 AND 1 AND a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1),
best AS (SELECT word, count(*) AS n_near, min({'less': -other_n, 'word': other}) AS b FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * n THEN b.word END AS form, CASE WHEN -b.less >= 10 * n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
walk(word, place) AS (SELECT word, word FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.place AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f z ON z.word = walk.place AND z.form IS NULL
""".replace("@", _ONE_BYTE.format("word"))
