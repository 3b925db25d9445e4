"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous steps.

Documents become token ids and an end id. A longer document is cut into full pieces, its first piece being the
shorter one. Pieces are range-sorted by length and hash, which ranks them inside their length; gaps are kept as runs of equal ones, in order.
A superstep takes all pieces of one length, longest first: a sweep over the gaps in rising order finds each its
successor, the smallest gap that fits; pieces and gaps of one size are matched by rank, so no two pieces want one
place; the gaps are updated and the next length follows. What is left over opens new sequences. Since equal
lengths and equal gaps are interchangeable, a superstep is a few rank intervals: the sweep itself works on counts
(at most `length` of them, whatever the corpus, on the driver), and Spark sorts the pieces and joins their ranks to the intervals.
The result is that of best-fit decreasing.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each. Very long texts are
tokenized in stretches, cut where the tokenizer's own rules cut. An empty table gives an empty result. Null ids
are kept. Extra columns aren't looked at.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import _common as c
from ._text import slices

LENGTH = 1024
END = 2
#: Bytes of text that are encoded together.
STRETCH = 1 << 23


def vocabulary() -> str:
    """The vocabulary as ranks (the ids of byte_bpe_50k.json); a parameter of `tokenized`."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The strings that the tokenizer's file (byte_bpe_50k.json) takes out of a text before all else, and their ids."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(x[k] for x in tokens for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take neighbouring characters into account aren't handled")
    return {x["content"]: x["id"] for x in tokens}


class Encoder:
    """ids of whole texts as the tokenizer gives them: `added` strings are their own ids, what is between them is
    encoded by itself. Without `added`, special tokens' strings are taken as ordinary text.

    This kind of tokenizer starts a new token at every single space between two other characters that aren't white
    space. So texts are cut there and the distinct stretches of a batch are encoded together, each once. Texts with
    a stretch that begins or ends with white space are encoded in one piece.
    """

    def __init__(self, path: str, added: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.added = added or {}
        self.split = "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))
        self.spaced = np.zeros(max(ranks.values()) + 1, bool)
        self.spaced[[i for x, i in ranks.items() if x[:1] == b" "]] = True

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column."""
        column = column.fill_null("")
        if not self.added:
            return self.ordinary(column)
        has = np.zeros(len(column), bool)
        for x in self.added:
            has |= pc.match_substring(column, x).to_numpy(zero_copy_only=False)
        if not has.any():
            return self.ordinary(column)
        parts, first = [], [0]  # of each text, by turns what is between added tokens and one of those
        for text, cut in zip(column.to_pylist(), has, strict=True):
            parts += re.split(f"({self.split})", text) if cut else [text]
            first.append(len(parts))
        own = np.zeros(len(parts), bool)
        for lo, hi in zip(first, first[1:], strict=False):
            own[lo + 1 : hi : 2] = True
        between = iter(self.ordinary(pa.array([x for x, o in zip(parts, own, strict=True) if not o], column.type)))
        coded = [np.array([self.added[x]], np.uint32) if o else next(between) for x, o in zip(parts, own, strict=True)]
        return [np.concatenate(coded[lo:hi]) for lo, hi in zip(first, first[1:], strict=False)]

    def ordinary(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column without nulls, no string of which is special."""
        lists = pc.split_pattern(column, " ")
        off = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        off -= off[0] if len(off) else 0
        odd = pc.match_substring_regex(words, r"^$|^[\p{Z}\t-\r\x1c-\x1f\x{85}]|[\p{Z}\t-\r\x1c-\x1f\x{85}]$").to_numpy(zero_copy_only=False)
        first = off[:-1]
        whole = np.add.reduceat(odd[at], first) > 0 if len(first) else np.zeros(0, bool)
        plain = np.flatnonzero(~odd)
        flat = np.array(self.encode(" " + " ".join(words.take(pa.array(plain)).to_pylist())), np.uint32) if len(plain) else np.zeros(0, np.uint32)
        begins = np.flatnonzero(self.spaced[flat])
        if len(begins) != len(plain):
            raise AssertionError("a stretch isn't apart from its neighbours")
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        begin[plain] = begins
        size[plain] = np.diff(np.append(begins, len(flat)))
        out = []
        for r, text in enumerate(column):
            if whole[r]:
                out.append(np.array(self.encode(text.as_py()), np.uint32))
                continue
            w = at[off[r] + 1 : off[r + 1]]
            n = size[w]
            end = np.cumsum(n)
            rest = flat[np.arange(end[-1]) + np.repeat(begin[w] - end + n, n)] if len(w) else flat[:0]
            out.append(np.concatenate([np.array(self.encode(words[at[off[r]]].as_py()), np.uint32), rest]))
        return out


def _sliced(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    off = np.cumsum([0, *(pc.binary_length(batch.column("text")).fill_null(0).to_pylist())])
    for lo, hi in slices(off, STRETCH):
        part = batch.slice(lo, hi - lo)
        yield part, encoder.ids(part.column("text"))


def tokenized(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; added: strings with an id of their own (`added_tokens`)."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, added)
        for batch, ids_of in ((x, y) for x in batches for x, y in _sliced(x, encoder)):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                start, piece = 0, 0
                size = len(ids) % length or length
                while start < len(ids):
                    for x, v in zip(out, (doc_id, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())), strict=True):
                        x.append(v)
                    start, size, piece = start + size, length, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(c.in_arrow, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def supersteps(counts: dict[int, int], room: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, pieces, pieces a sequence, first sequence, offset) intervals of best-fit decreasing.

    counts: pieces of each length. Sequences with equal gaps are kept as runs of numbers. A length splits one run at most and
    opens two, so it adds four runs at most; filling a run's gap leaves less than half of it. So there are at most
    4 * room * (log2(room) + 2) intervals, some 50,000 (2.4 MB) for 1024 tokens, whatever the corpus: they may be broadcast.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    steps, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for gap in sorted(g for g in gaps if g >= length):
            if not left:
                break
            fit = gap // length
            runs, gaps[gap] = gaps[gap], []
            while runs and left:
                first, n = runs.pop()
                full = min(n, left // fit)
                if full:
                    steps.append((length, rank, full * fit, fit, first, room - gap))
                    gaps.setdefault(gap - fit * length, []).append((first, full)) if gap > fit * length else None
                    rank, left, first, n = rank + full * fit, left - full * fit, first + full, n - full
                if n and left:  # fewer than a sequence's worth
                    steps.append((length, rank, left, left, first, room - gap))
                    gaps.setdefault(gap - left * length, []).append((first, 1))
                    rank, left, first, n = rank + left, 0, first + 1, n - 1
                if n:
                    runs.append((first, n))
            gaps[gap] += runs
            if not gaps[gap]:
                del gaps[gap]
        if left:
            fit = room // length
            full, rest = divmod(left, fit)
            if full:
                steps.append((length, rank, full * fit, fit, opened, 0))
                if room > fit * length:
                    gaps.setdefault(room - fit * length, []).append((opened, full))
                opened += full
            if rest:
                steps.append((length, rank + full * fit, rest, rest, opened, 0))
                gaps.setdefault(room - rest * length, []).append((opened, 1))
                opened += 1
    return steps


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces, range-sorted by length and hash, with their rank inside their length.

    A row's place in the sort is its place in its partition after the rows of the partitions before; what is told of each
    partition is one row for each length in it.
    """
    order = ["length", F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "start", "ids_crc32"]
    dealt = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = c.settle(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_row")), "ranked")
    first = dealt.groupBy("length", "_part").agg(F.min("_row").alias("_least"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_part")) - F.col("_n")  # a row for each partition at most
    first = c.settle(first.select("length", "_part", (before - F.col("_least")).alias("_before")), "parts")
    out = c.join_by_size(dealt, first, ["length", "_part"], "inner")
    return out.withColumn("rank", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def packed(pieces: DataFrame, room: int = LENGTH) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32; settled) with sequence_id and offset."""
    total = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # room rows at most
    plan = c.of_rows(pieces.sparkSession, list(supersteps(total, room)), ["l", "rank0", "pieces", "fit", "sequence0", "offset0"], [pa.int64()] * 6)
    placed = ranked(pieces).join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("pieces")))
    at = F.col("rank") - F.col("rank0")
    return placed.select(*pieces.columns, (F.col("sequence0") + F.expr("(rank - rank0) div fit")).alias("sequence_id"), (F.col("offset0") + at % F.col("fit") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    pieces = c.settle(tokenized(docs, path, length, end, added), "pieces")
    return packed(pieces, length)


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    c.small_batches(spark)
    return pack(docs, added=added_tokens())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents"), added=added_tokens())
