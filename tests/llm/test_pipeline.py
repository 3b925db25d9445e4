"""The whole pipeline against a brute-force version of its five stages, over the smallest documents and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

pytest.importorskip("riskloom.llm")
from riskloom.llm import langid  # noqa: E402

ODD = [(-1, None, "en", "a"), (-2, "", None, None), (-3, "123 456", "en", None), (-4, "é" * 200, "fr", "b")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def identified(rows, model):
    """Rows whose best language is shorter than the next by the margin."""
    coders = []
    for _, body in model:
        d = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders.append(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    kept = []
    for row in rows:
        if not row["text"] or not any(map(str.isalpha, row["text"])):
            continue
        raw = row["text"].lower().encode()
        blocks = [raw[i : i + langid.BLOCK] for i in range(0, len(raw), langid.BLOCK)]
        sizes = sorted(sum(len(z.compress(x)) - len(z.compress(b"")) for x in blocks) for z in coders)
        if sizes[1] - sizes[0] >= langid.MARGIN * sizes[1]:
            kept.append(row)
    return kept


def one_of_each(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, comp = {}, {}
    for r in rows:
        w = WORD.findall(r["text"].translate(fold))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        comp[r["doc_id"]] = r["doc_id"]
    links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    while True:
        before = dict(comp)
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
        if comp == before:
            return [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]


def without_repeats(rows):
    seen, out = {}, []
    ordered = sorted(rows, key=lambda r: r["doc_id"])
    for r in ordered:
        raw = r["text"].encode()
        for s in range(len(raw) - 99):
            seen.setdefault(raw[s : s + 100], (r["doc_id"], s))
    for r in ordered:
        raw = r["text"].encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] < (r["doc_id"], s):
                gone[s : s + 100] = True
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append({**r, "text": kept.decode(errors="ignore")})
    return out


def copies(rows):
    """How often each row is taken, by rounds of dealing the excess anew."""
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in rows}
    per = Counter()
    for r in rows:
        per[r["source"]] += size[r["doc_id"]]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: float((3, 1, 2)[i % 3]) for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(per.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        capped = {s for s in open_ if level * weight[s] >= 2 * per[s]}
        if not capped:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * per[s] for s in capped}
        left -= sum(target[s] for s in capped)
        open_ -= capped
    taken, at = {}, Counter()
    for r in sorted(rows, key=lambda r: (hashlib.md5(f"mix|{r['doc_id']}".encode()).hexdigest(), r["doc_id"])):
        s, n = r["source"], size[r["doc_id"]]
        at[s] += n
        full = int(target[s] // per[s]) if per[s] else 0
        taken[r["doc_id"]] = min(2, full + (at[s] - n / 2 < target[s] - full * per[s]))
    return taken


def best_fit(lengths, room=1024):
    """The number of sequences of best-fit decreasing, piece by piece."""
    gaps = Counter()
    opened = 0
    for n in sorted(lengths, reverse=True):
        fits = [g for g, k in gaps.items() if k and g >= n]
        gap = min(fits) if fits else room
        opened += not fits
        gaps[gap] -= bool(fits)
        gaps[gap - n] += 1
    return opened


def test_pipeline_by_brute_force(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    rows = identified([r.asDict() for r in docs.select("doc_id", "text", "source").collect()], langid.train(docs))
    rows = without_repeats(one_of_each(rows))
    taken = copies(rows)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    want = Counter()
    for r in rows:
        ids = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        start, piece, n = 0, 0, len(ids) % 1024 or 1024
        while start < len(ids):
            want[r["doc_id"], piece, start, n, zlib.crc32(ids[start : start + n].tobytes())] += taken[r["doc_id"]]
            start, piece, n = start + n, piece + 1, 1024

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == +want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    assert len(places) == best_fit([r["length"] for r in got])
