"""The training-data operators against brute force, round trips and held-out accuracy, with null, empty, repeated and very long rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("riskloom.llm")
from riskloom.llm import langid, licenses, media, minhash, mixing, packing, suffix_dedup as sd, topk, urlfilter, warc  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id long"


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, f"s{i % 3}", None, 7) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def texts(seed=1):
    rng = random.Random(seed)
    base = [words(rng, n) for n in (3, 40, 90, 200, 400)]
    long = words(rng, 3000)
    near = base[3].split()
    near[50] = "changed"
    shared = words(rng, 30)
    return [None, "", "a", base[0], base[1], base[2], base[3], base[3], " ".join(near), base[4] + " " + shared, shared + " " + base[1][::-1], long, long[100:9000] + "é", "x" * 400, "é" * 150, "x" * 130, base[0]]


def spans_by_force(rows):
    seen, out = {}, {}
    order = sorted(rows, key=lambda r: r[0])
    for i, raw in order:
        for s in range(len(raw) - 99):
            seen.setdefault(raw[s : s + 100], (i, s))
    for i, raw in order:
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] < (i, s):
                gone[s : s + 100] = True
        out[i] = gone
    return out


def check_spans(spark, rows, **how):
    """rows: (id, text)"""
    df = spark.createDataFrame([(i, t, "en", None, None, 7) for i, t in rows], DOCS).repartition(3)
    got = {(r["id"], r["twin"]): r["spans"] for r in sd.marks(df, **how).collect()}
    gone = spans_by_force([(i, (t or "").encode()) for i, t in rows])
    assert {i for i, _ in got} <= set(gone)
    for i, own in gone.items():
        edges = np.flatnonzero(np.diff(np.r_[0, own.astype(int), 0]))
        assert list(edges) == list(got.get((i, 0), [])), i


def test_suffix_dedup_by_brute_force(spark):
    check_spans(spark, list(enumerate(texts())))


def test_suffix_dedup_when_every_k_gram_is_dealt_wide(spark):
    check_spans(spark, list(enumerate(texts())), wide=1, merged=50)


def test_suffix_dedup_with_hot_k_grams_and_passages(spark):
    """One phrase of 40 bytes in every document, passages that only some documents share at its sides."""
    rng = random.Random(11)
    phrase, left, right = words(rng, 9)[:40], [words(rng, 30) for _ in range(4)], [words(rng, 30) for _ in range(4)]
    rows = [(i, f"{words(rng, 5)} {rng.choice(left)[-rng.randint(0, 90):]} {phrase} {rng.choice(right)[:rng.randint(0, 90)]} {words(rng, 12)}") for i in range(300)]
    check_spans(spark, rows, wide=8, merged=400)


def test_suffix_dedup_in_stretches_of_a_long_text(spark):
    rng = random.Random(12)
    long = words(rng, 70_000)
    assert len(long) > 262_144 + 1000
    check_spans(spark, [(0, long), (1, long[262_000:262_700]), (2, "ab" * 140_000)])


def test_suffix_dedup_with_equal_ids(spark):
    rng = random.Random(13)
    a, b = words(rng, 60), words(rng, 60)
    rows = [(1, a), (1, b), (1, b), (None, a[:150]), (None, None), (0, b[50:200])]
    out = sd.keep_rest(spark, spark.createDataFrame([(i, t, "en", None, None, 7) for i, t in rows], DOCS))
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a[150:]), (1, b[:50] + b[200:]), (1, b[:50] + b[200:]), (None, a[:150]), (None, None), (0, b[50:200])], key=str)


def test_suffix_dedup_keeps_columns_and_takes_empty_tables(spark):
    out = sd.keep_rest(spark, frame(spark, texts()))
    assert out.columns == frame(spark, []).columns
    assert {r["doc_id"]: r["text"] for r in out.collect()}[7] == ""
    assert sd.keep_rest(spark, frame(spark, [])).count() == 0


def test_minhash_by_brute_force(spark):
    rng = random.Random(3)
    rows = texts(2)
    core = words(rng, 120).split()
    for _ in range(12):
        own = list(core)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = words(rng, 1)
        rows.append(" ".join(own).upper())
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert [got[i]["component_id"] for i in range(len(rows))] == comp
    assert [got[i]["n_shingles"] for i in range(len(rows))] == [len(s) for s in sets]


def test_minhash_on_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("edges", [[(5, 5)], [(i, i + 1) for i in range(9)], [(i * 7919 % 31, i * 104729 % 29) for i in range(24)] + [(-(2**63), 4)]])
def test_components_by_force(spark, edges):
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    pairs = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, minhash.components(pairs).collect())) == sorted(root.items())
    # the same in two steps: groups of the first half, then what the rest links
    nodes = spark.createDataFrame([(x,) for x in root], "id long")
    half = minhash._with_all(minhash.components(spark.createDataFrame(edges[::2], "a long, b long")), nodes)
    assert sorted(map(tuple, minhash._linked(half, spark.createDataFrame(edges[1::2], "a long, b long")).collect())) == sorted(root.items())


def test_warc_round_trip(spark):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    htmls = [None, "", "one", "two" * 400, "one", trap * 3, "x" + trap, "one"]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://a/{i}%0A\n", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in warc.round_trip(pages, file_bytes=900, range_bytes=128).collect()}
    assert len(got) == len(htmls)
    last = {(h or ""): i for i, h in enumerate(htmls)}
    for i, h in enumerate(htmls):
        raw, target = (h or "").encode(), last[h or ""]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(raw), warc.digest_of(raw))
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("response", None) if i == target else ("revisit", target))
        assert got[i]["url"] == (None if i == 3 else f"http://a/{i}%0A\n")
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_media_round_trip(spark, tmp_path):
    rows = texts()
    media.write_archives(frame(spark, rows).repartition(3), str(tmp_path / "m"), archive_bytes=3000)
    got = {r["doc_id"]: r for r in media.digests(media.read_archives(spark, str(tmp_path / "m"), range_bytes=1000, batch_bytes=500)).collect()}
    for i, t in enumerate(rows):
        raw = (t or "").encode()
        payload = media.padded(raw)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert got[6]["media_sha256"] == got[7]["media_sha256"]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    rows = [*texts(), "two  spaces \n <|endoftext|> x", texts()[11]]
    got = packing.pack(frame(spark, rows), length=64).collect()
    places = {}
    for r in got:
        assert 0 < r["length"] <= 64 and r["offset"] + r["length"] <= 64
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
    for i, t in enumerate(rows):
        assert sum(r["length"] for r in got if r["doc_id"] == i) == len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.1 * -(-total // 64) + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_with_the_tokenizer_as_loaded(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    rows = [*texts(), f"a {end} b", end, end * 3, f"{end}x  ", f" {end}\n\n two  spaces {end} é{end}", "<|endoftext|", f"<{end}>", (f"one two {end}\n") * 900, None, ""]
    assert loaded.encode(rows[len(texts())], add_special_tokens=False).ids == [64, 220, 50256, 275]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, t in enumerate(rows):
        ids = np.array([*loaded.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, piece, n = 0, 0, len(ids) % 1024 or 1024
        while start < len(ids):
            want.add((i, piece, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            start, piece, n = start + n, piece + 1, 1024
    for out in (packing.op10_packing(spark, str(tmp_path)), packing.packed_documents(spark, docs)):
        got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()]
        assert len(got) == len(want) and set(got) == want


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(2)
    v = [[float(x) for x in r] for r in rng.normal(0, 0.3, (90, 4))]
    for i in range(50, 80):
        v[i] = v[49]
    rows = [(i, x) for i, x in enumerate(v)] + [(200, None), (201, [float("nan")] * 4), (202, [1.0, None, 1.0, 1.0]), (None, v[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in topk.search(topk.whole_vectors(df), F.col("id") % 20 == 0, k=7, block_size=2).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    m = np.floor(np.array(v) * 64).astype(int)
    for q in range(0, 90, 20):
        best = sorted((-int(m[q] @ m[i]), i) for i in range(90) if i != q)[:7]
        assert [got[q][k + 1] for k in range(7)] == [(i, -s) for s, i in best]
    assert topk.search(topk.whole_vectors(df.limit(0)), F.col("id") % 20 == 0).count() == 0


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://ORG", "http://x.org/", "https://a.example.org/es/1", "https://example.org/en/12?q#f", "https://example.org/en/2", "http://com/fr/", "http://b.com/de/x", "http://notexample.org/es/", "http://net/a://org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = [(r["_rule"], r["_verdict"]) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    none = (None, "allow")
    assert got == [none, none, none, none, ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow"), none]


def test_cascade_is_exact_with_tiny_filters(spark):
    listed = spark.range(60).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(600).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = urlfilter.cascade(listed, universe, max_bits=256)
    assert len(levels) > 1
    assert universe.where(urlfilter.member(levels, F.col("key")) != (F.substring("key", 2, 9).cast("int") < 60)).count() == 0


def test_mixing_targets(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(0, 30)), "en", s, None, 1) for i, s in enumerate([None] * 5 + ["a"] * 200 + ["b"] * 60 + ["c"] * 90)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).select("source", "_mix.*").collect()
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in (None, "a", "b", "c")}
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] <= 2 * sizes[s] + 1e-9
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 15
        assert all(r["copies"] <= 2 and len(r["positions"]) == r["copies"] for r in own)
    order = mixing.training_order(spark.createDataFrame(rows, DOCS))
    assert order.count() == sum(r["copies"] for r in got) and order.columns == [x.split()[0] for x in DOCS.split(", ")]
    assert mixing.mix(frame(spark, [])).count() == 0


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    got = langid.predict(docs.unionByName(odd), langid.train(docs)).join(docs.select("doc_id", "lang"), "doc_id", "left")
    assert got.where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.85
    assert got.where("doc_id = -1").first()["lang_pred"] == "und"
    assert langid.keep_identified(spark, docs).columns == docs.columns
    assert [r["lang_pred"] for r in langid.predict(docs.limit(2), []).collect()] == ["und", "und"]


def test_license_scan(spark):
    rng = random.Random(8)
    clean = words(rng, 60)
    rows = [None, "", clean, clean + "\nReleased under the MIT License.", "Licensed under the Apache License, Version 2.0.", clean + " Licensed under CC BY-NC 4.0. " + clean, "This work is licensed under the GNU General Public License, version 3.", "the driver license was licensed to the general public"]
    docs = frame(spark, rows)
    got = [r["family"] for r in licenses.scan(docs, licenses.train(docs, epochs=20)).orderBy("doc_id").collect()]
    assert got == [None, None, None, "MIT", "Apache-2.0", "CC-BY-NC", "GPL", None]


def test_license_lines_of_the_table(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "All rights reserved.": "Proprietary",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = licenses.train(docs)
    want = {(r["doc_id"], f) for r in docs.collect() for x, f in lines.items() if x in (r["text"] or "").split("\n")}
    assert {f for _, f in want} == set(lines.values())
    got = {(r["doc_id"], f) for r in licenses.scan(docs, model).collect() for f in r["families"]}
    assert got == want
    decoys = frame(spark, ["all rights of the citizens are protected by law", "All rights of the citizens."])
    assert [r["family"] for r in licenses.scan(decoys, model).collect()] == [None, None]


def test_license_scan_of_wrapped_headers_and_dual_licences(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    lgpl = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
    bsd = """Redistribution and use in source and binary forms, with or without\r
modification, are permitted provided that the following conditions\r
are met:"""
    mit = """// Permission is hereby granted, free of charge, to any person
// obtaining a copy of this software and associated documentation
// files (the "Software"), to deal in the Software without restriction"""
    rng = random.Random(9)
    lines = "\n".join(words(rng, 9) for _ in range(12))
    want = [(gpl, ["GPL"]), (lgpl, ["LGPL"]), (bsd, ["BSD"]), (mit, ["MIT"])]
    want += [(f"{lines}\n{x}\n{lines}", f) for x, f in want]
    want += [(gpl.replace("\n", " "), ["GPL"]), (lgpl.replace("\n", " "), ["LGPL"])]
    want += [("under the MIT license or the Apache License, Version 2.0", ["Apache-2.0", "MIT"]), (f"{gpl}\n\n{lgpl}", ["GPL", "LGPL"]), ("Licensed under CC BY-NC 4.0 or\nlicensed under CC BY 4.0", ["CC-BY", "CC-BY-NC"])]
    want += [(f"{words(rng, k)}\n{x}\n{lines}", [f]) for k in range(30) for x, f in [("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC")]]
    want += [("Licensed under the Mozilla\n \t\nPublic License 2.0", []), ("the license plate\nof the general public", []), (lines, []), ("\n\n", [])]
    docs = frame(spark, [x for x, _ in want])
    got = licenses.scan(docs, licenses.train(docs, epochs=20)).orderBy("doc_id").collect()
    assert [r["families"] for r in got] == [f for _, f in want]
    assert [r["n_paragraphs"] for r in got][:8] == [1] * 8 and [r["n_paragraphs"] for r in got][-4:] == [2, 1, 1, 0]


def test_pipeline_stages():
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "mixing", "packing"]
