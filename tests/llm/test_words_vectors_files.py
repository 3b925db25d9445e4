"""Spelling variants, whitening and files of token ids against brute force, with null, empty, repeated, tied and very long rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("riskloom.llm")
from riskloom.llm import _files, packing, spelling, tokenfiles as tf, whitening as wh  # noqa: E402
from riskloom.llm import _common as c  # noqa: E402

DOCS = "doc_id long, text string, word string, n long, a string, ids binary"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, None, None) for i, t in rows], DOCS)


# spelling


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def variants_by_force(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in counts if one_apart(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def words_of(spark, df):
    return spelling.variants(spelling.counted(spelling.runs(df).select(spelling.with_errors(F.col("run"), F.col("doc_id")).alias("word"))))


def test_variants_by_force(spark):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcé÷", k=rng.randint(6, 11))) for _ in range(40)]
    rows = [(None, None), (1, ""), (2, "Aaaaaaa aaaaaaaa AAAAAAA aaaaaaaa aaaaaab ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ"), (None, "abcdefg abcdefg 12abcdefg3"), (3, "z" * 300_000), (4, "z" * 300_000), (5, "z" * 300_001 + " " + "z" * 300_001)]
    for i in range(300):
        some = []
        for _ in range(rng.randint(0, 60)):
            w = base[int(rng.paretovariate(1)) % len(base)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k:], w[:k] + rng.choice("abcd") + w[k + 1 :]])
            some.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((10 + i // 2, " ".join(some)))
    rows += rows[20:30]
    got, want = found(words_of(spark, docs(spark, rows).repartition(5))), variants_by_force(rows)
    assert got == want
    assert any(v[0] for v in want.values()) and "z" * 300_000 in want


def test_chains_of_forms_reach_their_root(spark):
    text = " ".join(["abcdefgh"] * 2 + ["abcdefghi"] * 20 + ["abcdefghij"] * 200 + ["abcdefghijk"] * 2000 + ["abcdefghijx"] * 2000)
    rows = [(7, text)]
    got = found(words_of(spark, docs(spark, rows)))
    assert got == variants_by_force(rows)


def test_near_words_of_a_small_alphabet(spark):
    """Many words with repeated bigrams, each with many near ones: no pair is missed by prefixes and pivots."""
    rng = random.Random(2)
    words = {"".join(rng.choices("aaabÿ", k=rng.randint(7, 9))) for _ in range(900)} | {"ab" * k for k in range(4, 9)} | {"ab" * k + "a" for k in range(4, 9)} | {"a" * k for k in range(7, 20)}
    df = c.settle(spark.createDataFrame([(w, 2 + len(w)) for w in words], "word string, n long"), "words")
    got = {(r["word"], r["other"]): (r["n"], r["other_n"]) for r in spelling.near_words(df).collect()}
    want = {(a, b): (2 + len(a), 2 + len(b)) for a in words for b in words if one_apart(a, b)}
    assert got == want and len(want) > 1000


def test_no_words(spark):
    assert words_of(spark, docs(spark, [])).count() == 0
    assert words_of(spark, docs(spark, [(1, "short ones only"), (2, None)])).count() == 0


# whitening


VECTORS = "vec_id long, embedding array<float>, label int, x array<long>, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, [1], 5) for i, v in rows], VECTORS)


def whitened_by_force(rows, k=16):
    good = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return good, n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ q / np.sqrt(e), e / (y * y).sum() * n


def check_whitening(spark, rows, k=16):
    good, n, deviation, want, explained = whitened_by_force(rows, k)
    got = wh.whitened(wh.shifted(vectors(spark, rows).repartition(3))).toPandas()
    width = want.shape[1]
    assert len(got) == len(good) * width and set(got["n"]) == {n} and set(got["component"]) == set(range(1, width + 1))
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    table = {}
    for r in got.itertuples():
        table.setdefault((None if np.isnan(r.vec_id) else int(r.vec_id), r.deviation), {}).setdefault(r.component, []).append(r.whitened)
    signs = None
    for (i, _), d, w in zip(good, deviation, want, strict=True):
        own = np.array([table[i, d][k + 1][0] for k in range(width)])
        signs = np.sign(own * w) if signs is None else signs
        assert np.allclose(own, w * signs, atol=1e-8), i
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9)


def test_whitening_by_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) * np.linspace(5, 0.3, 40)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # a vector that a third of the rows hold
    rows += [(2000, None), (2001, []), (2002, [None] * 40), (2003, [float("nan")] * 40), (2004, [float("inf")] + [0.0] * 39), (5, rows[7][1]), (None, rows[3][1])]
    check_whitening(spark, rows)


def test_whitening_of_few_dimensions(spark):
    rng = np.random.default_rng(4)
    check_whitening(spark, [(i, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(50, 3)) * [9, 3, 1])], 3)


def test_whitening_without_spread(spark):
    assert wh.whitened(wh.shifted(vectors(spark, []))).count() == 0
    assert wh.whitened(wh.shifted(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))).count() == 0
    line = wh.whitened(wh.shifted(vectors(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(5)]))).toPandas()
    assert set(line["component"]) == {1} and np.allclose(line["explained"], 1)


def test_each_length_is_whitened_by_itself(spark):
    rng = np.random.default_rng(5)
    a = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 4)) * [8, 4, 2, 1])]
    b = [(100 + i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(30, 2)) * [8, 2])]
    both = wh.whitened(wh.shifted(vectors(spark, a + b))).toPandas()
    alone = wh.whitened(wh.shifted(vectors(spark, b))).toPandas()
    key = ["vec_id", "component"]
    assert np.allclose(both[both["vec_id"] >= 100].sort_values(key)["whitened"], alone.sort_values(key)["whitened"])
    assert set(both[both["vec_id"] < 100]["n"]) == {40}


@pytest.mark.parametrize(("dim", "ratio"), [(150, 0.93), (64, 0.999), (30, 0.2), (1, 1.0)])
def test_jacobi_davidson_gives_eigenpairs(dim, ratio):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    matrix = q * (7 * ratio ** np.arange(dim)) @ q.T
    values, axes = wh.eigenpairs(lambda b: matrix @ b, dim)
    k = len(values)
    assert k == min(16, dim) and np.abs(values - 7 * ratio ** np.arange(k)).max() < 1e-13
    assert np.linalg.norm(matrix @ axes - axes * values, axis=0).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(k)).max() < 1e-12


def test_jacobi_davidson_with_equal_eigenvalues():
    values, axes = wh.eigenpairs(lambda b: np.diag([3.0] * 20 + [1.0] * 60) @ b, 80)
    assert np.allclose(values, 3) and np.abs(axes.T @ axes - np.eye(16)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(25, 25))
    a = a + a.T
    right = np.column_stack([rng.normal(size=(25, 3)), np.zeros(25)])
    assert np.abs(a @ wh.minres(lambda t: a @ t, right, 40) - right).max() < 1e-8


def test_deviations_beyond_a_long_are_errors(spark):
    rows = spark.createDataFrame([(k, [k * 2**40, 1]) for k in range(4)], "vec_id long, x array<long>")
    with pytest.raises(Exception, match="deviation exceeds a long"):
        wh.whitened(rows).collect()


# files


def test_codes_come_back(spark):
    rng = np.random.default_rng(7)
    ranks = np.concatenate([rng.integers(0, 1 << int(b), 1000) for b in (1, 8, 9, 16, 17, 24, 25, 32)]).astype(np.uint32)
    rng.shuffle(ranks)
    control, codes, covers = tf.encode(ranks)
    assert int(covers.sum()) == len(codes) and len(control) == len(ranks) // 4
    assert (tf.decode(control, codes) == ranks).all()
    assert len(tf.decode(control[:0], codes[:0])) == 0


def ids_by_force(rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


def test_token_files_by_the_library(spark):
    rng = random.Random(8)
    some = [" ".join("".join(rng.choices("abcdé<|>endoftxt ", k=rng.randint(1, 9))) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(some)] + [(-5, None), (-4, ""), (None, "no id"), (70, "a <|endoftext|> b"), (71, "x" * 50_000), (72, "word " * 60_000), (80, "twice"), (80, "twice"), (80, "other"), (2**40, "!")]
    rng.shuffle(rows)
    folder = c.fresh_path(spark, "ids")
    manifest = tf.write_files(docs(spark, rows).repartition(4), folder, added=packing.added_tokens(), block=3000)
    got = sorted(tf.read_documents(folder, manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start, want = 0, Counter((i, tuple(x)) for i, x in ids_by_force(rows))
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        want[r["doc_id"], tuple(ids.tolist())] -= 1
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        start += len(ids)
    assert not any(want.values())
    sizes = sum(n for _, n in _files.listing(folder, ".ids"))
    assert sizes < 2.2 * start + 40 * 10 * len(rows)


def test_common_ids_get_low_ranks(spark):
    folder = c.fresh_path(spark, "ids")
    tf.write_files(docs(spark, [(k, "the the the cat") for k in range(5)]), folder)
    ranks = tf.read_ranks(folder)
    (_, ids), *_ = ids_by_force([(0, "the the the cat")])
    counts = Counter(ids)
    assert list(ranks) == sorted(counts, key=lambda x: (-counts[x], x))


def test_damaged_files_are_noticed(spark):
    folder = c.fresh_path(spark, "ids")
    manifest = tf.write_files(docs(spark, [(k, f"text {k} of some words") for k in range(50)]), folder)
    path, _ = _files.listing(folder, ".ids")[0]
    raw = bytearray(open(path, "rb").read())
    raw[-3] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        tf.read_documents(folder, manifest).collect()


def test_no_documents_no_files(spark):
    folder = c.fresh_path(spark, "ids")
    manifest = tf.write_files(docs(spark, []), folder)
    assert manifest.count() == 0 and tf.read_documents(folder, manifest).count() == 0
