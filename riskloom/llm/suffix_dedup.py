"""Removal of repeated byte strings by a distributed suffix sort over a difference cover.

The sample is a content-defined difference cover: the places of the smallest hashed k-gram of every window of
WIDTH bytes. Like the residues of a periodic cover it gives any two equal windows a common shift at which both are
sampled, but at 1/35 of the positions instead of 2/3. Every sampled position (anchor) stands for the windows it
was picked by, a run of starts lo..hi.

1. Anchors whose runs read the same bytes (two 64-bit hashes, of the k-gram and of the run) form a class; all but the
   earliest are repeats as a whole. A task finds those inside its own rows, Spark deals the others out by hash.
2. The earliest anchors of classes that share a k-gram with another class are suffix-sorted, to the right from the
   k-gram's start and to the left from its end, reversed. Triples of 12-byte characters are range-sorted by Spark and named in
   order; names and the next triples are sorted and named in turn, until the names cover WIDTH bytes.
3. In that order adjacent suffixes' common prefixes are taken. An unsampled start d bytes before its anchor is
   named by the groups of suffixes that agree with it in d bytes to the left and WIDTH - d to the right; starts with
   equal names (merged through the sampled ranks) are equal windows. All but the earliest are repeats.

No step depends on how often a k-gram, a context or a window occurs: a k-gram with more than WIDE contexts in one
task's rows is dealt out by its contexts, equal suffixes are spread by their place over range partitions (names
and groups go on across the borders), classes and windows are counted before they meet.

Defined cases: a null text is empty. Texts shorter than WIDTH bytes lose nothing. Of rows with equal ids and
different texts the one with the smaller hash of the text comes first; rows equal in both lose the same. A null id comes
before all others. Very long texts are handled whole, in stretches that overlap. An empty table gives an empty
result. Extra columns are kept by `keep_rest` and else not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _common as c, _text as t

WIDTH, GRAM = 100, 32
REACH = WIDTH - GRAM
#: Bytes of a triple of characters; so many sorts name WIDTH bytes.
TRIPLE = 36
#: Anchors a task looks through before it passes them on.
MERGED = 1 << 18
#: Contexts of one k-gram in that many anchors beyond which they are dealt out one by one.
WIDE = 16
#: Groups of suffixes are named by partition and row: bits of the row's number.
PART_BITS = 36
#: Rows of an Arrow batch that a task passes on.
BATCH = 1 << 13
#: Bytes of an Arrow batch that a task gets.
TAKEN = 1 << 20
_NULL = -(2**63)


def anchors(b: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """k-gram hash, context hash, place, lo, hi and row of each anchor of the rows of b."""
    none = np.zeros(0, np.int64)
    if len(b) < width:
        return none, none, none, none, none, none
    h0, h1 = t.Hashes(b, 0), t.Hashes(b, 1)
    value = h0.all(gram)
    index = np.arange(len(value), dtype=np.int32)
    span = width - gram + 1

    def lower(shift: int):
        m = len(value) - shift
        keep = value[:m] <= value[shift:]
        return np.where(keep, value[:m], value[shift:]), np.where(keep, index[:m], index[shift:])

    step = 1
    while step * 2 <= span:
        value, index = lower(step)
        step *= 2
    if span > step:
        value, index = lower(span - step)
    ends = np.repeat(off[1:], np.diff(off))
    start = np.flatnonzero(ends - np.arange(len(b)) >= width)
    if not len(start):
        return none, none, none, none, none, none
    place = index[start].astype(np.int64)
    first = np.ones(len(start), bool)
    first[1:] = place[1:] != place[:-1]
    at = np.flatnonzero(first)
    lo, hi, place = start[at], start[np.append(at[1:], len(start)) - 1], place[at]
    shape = ((place - lo) * 1024 + (hi - lo)).astype(np.uint64)
    context = t.mix(h1.of(lo, hi + width) + shape * np.uint64(0x9E3779B97F4A7C15))
    return h0.of(place, place + gram).view(np.int64), context.view(np.int64), place, lo, hi, np.searchsorted(off, place, side="right") - 1


def _cols(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(x).to_numpy(zero_copy_only=False) for x in names]


def _out(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for x in range(0, n, BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(v[x : x + BATCH]) for v in columns.values()], names=list(columns))


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before; the first one does."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _last(new: np.ndarray) -> np.ndarray:
    """For each row the last row at or before it where `new` holds."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _pack(lo: np.ndarray, place: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo << 20) | ((place - lo) << 10) | (hi - lo)


def _end(at: np.ndarray) -> np.ndarray:
    """Where the last window of a packed anchor ends."""
    return (at >> 20) + (at & 1023) + WIDTH


def _anchored(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """kg, cx, id, twin, at of the anchors of a batch, stretch by stretch; a longer text is cut into stretches that share WIDTH - 1 bytes."""
    b, off = t.bytes_of(batch.column("text"))
    ids, twins = t.ids_of(batch.column("id")), t.ids_of(batch.column("twin"))
    for r0, r1 in t.slices(off):
        for shift in range(0, max(1, int(off[r1] - off[r0])) if r1 == r0 + 1 else 1, t.SLICE):
            own = b[off[r0] + shift : min(off[r1], off[r0] + shift + t.SLICE + WIDTH - 1)] if r1 == r0 + 1 else b[off[r0] : off[r1]]
            o = np.array([0, len(own)]) if r1 == r0 + 1 else off[r0 : r1 + 1] - off[r0]
            kg, cx, place, lo, hi, row = anchors(own, o)
            if len(kg):
                base = o[row] - shift
                yield kg, cx, ids[r0:r1][row], twins[r0:r1][row], _pack(lo - base, place - base, hi - base)


def _dealt(parts: list[tuple[np.ndarray, ...]], most: int | None) -> Iterator[pa.RecordBatch]:
    """Of some anchors (which are let go): marks of the repeats among them, and the earliest of each class with the key by which it is dealt.
    Without `most` each class is dealt by itself.

    e is an end for a mark, 0 for an anchor, -1 for one of a k-gram that is dealt out wide, and -2 for the row that tells
    those anchors of such a k-gram that other tasks deal narrowly.
    """
    kg, cx, ids, twin, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.lexsort((at, twin, ids, cx, kg))
    kg, cx, ids, twin, at = (x[order] for x in (kg, cx, ids, twin, at))
    new = _changes(kg, cx)
    lead = _last(new)
    again = ~new & ((ids != ids[lead]) | (twin != twin[lead]) | (at != at[lead]))
    i, w, s, e = _runs(ids[again], twin[again], at[again] >> 20, _end(at[again]))
    none = np.zeros(len(i), np.int64)
    yield from _out({"deal": i, "kg": none, "cx": none, "id": i, "twin": w, "at": s, "e": e})
    kg, cx, ids, twin, at = (x[new] for x in (kg, cx, ids, twin, at))
    first = np.flatnonzero(_changes(kg))
    contexts = np.diff(np.append(first, len(kg)))
    apart = contexts > most if most is not None else np.ones(len(first), bool)
    wide = np.repeat(apart, contexts)
    deal = np.where(wide, t.mix(kg.view(np.uint64) ^ t.mix(cx.view(np.uint64))).view(np.int64), kg)
    yield from _out({"deal": deal, "kg": kg, "cx": cx, "id": ids, "twin": twin, "at": at, "e": np.where(wide, -1, 0)})
    told = first[apart] if most is not None else first[:0]
    yield from _out({"deal": kg[told], "kg": kg[told], "cx": cx[told], "id": ids[told], "twin": twin[told], "at": at[told], "e": np.full(len(told), -2)})


def _runs(ids: np.ndarray, twin: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """The spans s..e of each document, merged where they touch, in order."""
    order = np.lexsort((s, twin, ids))
    ids, twin, s, e = ids[order], twin[order], s[order], e[order]
    doc = _changes(ids, twin)
    far = np.cumsum(doc) << 44  # later documents lie beyond all ends of earlier ones
    reach = np.maximum.accumulate(e + far)
    new = doc.copy()
    new[1:] |= (s + far)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids))[: len(first)] - 1
    return ids[first], twin[first], s[first], (reach - far)[last]


def _sorted_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kg, cx, id, twin, at): marks (e > 0) of all but the first of a class, and the firsts of k-grams with several classes (e = 0).

    Between batches one row is kept: the first of the class that may go on, with what is known of its k-gram.
    """
    held: tuple | None = None  # kg, cx, id, twin, at, e of that row; whether it is still to be passed on
    waits = False
    for batch in batches:
        kg, cx, ids, twin, at, e = _cols(batch, "kg", "cx", "id", "twin", "at", "e")
        mark = e > 0
        yield from _out({"id": ids[mark], "twin": twin[mark], "at": at[mark], "e": e[mark]})
        kg, cx, ids, twin, at, e = (x[~mark] for x in (kg, cx, ids, twin, at, e))
        if held is not None:
            kg, cx, ids, twin, at, e = (np.concatenate([[h], x]) for h, x in zip(held, (kg, cx, ids, twin, at, e), strict=True))
        if not len(kg):
            continue
        fresh = np.ones(len(kg), bool)
        fresh[0] = held is None or waits
        group = np.cumsum(_changes(kg)) - 1
        real = np.flatnonzero(e != -2)
        new = _changes(kg[real], cx[real])
        classes = np.bincount(group[real[new]], minlength=group[-1] + 1)
        several = (classes > 1) | (np.bincount(group[e < 0], minlength=group[-1] + 1) > 0)
        lead = real[_last(new)]
        again = ~new & ((ids[real] != ids[lead]) | (twin[real] != twin[lead]) | (at[real] != at[lead]))
        again = real[again]
        yield from _out({"id": ids[again], "twin": twin[again], "at": at[again] >> 20, "e": _end(at[again])})
        first = real[new]
        first = first[several[group[first]] & fresh[first]]
        yield from _out({"id": ids[first], "twin": twin[first], "at": at[first], "e": np.zeros(len(first), np.int64)})
        here = len(real) and group[real[-1]] == group[-1]
        k = lead[-1] if here else len(kg) - 1  # a row with e = -2 may stand for a k-gram without anchors yet
        waits = bool(here and not several[-1])
        held = kg[k], cx[k], ids[k], twin[k], at[k], (-1 if several[-1] else 0) if here else -2


def classes(rows: DataFrame, make, wide: int | None, merged: int = MERGED) -> DataFrame:
    """id, twin, at, e: marks (at..e) of all but the earliest of the classes that make(batch) tells (kg, cx, id, twin, at),
    and with e = 0 the earliest ones of each kg that has several classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in make(batch):
                held.append(part)
                size += len(part[0])
                if size >= merged:
                    yield from _dealt(held, wide)
                    held, size = [], 0
        if size:
            yield from _dealt(held, wide)

    found = rows.transform(c.in_arrow, run, "deal long, kg long, cx long, id long, twin long, at long, e long")
    dealt = found.repartition("deal").drop("deal").sortWithinPartitions("kg", "cx", "id", "twin", "at")
    return dealt.transform(c.in_arrow, _sorted_classes, "id long, twin long, at long, e long")


def sides(docs: DataFrame, to_sort: DataFrame) -> DataFrame:
    """id, twin, at, side, bytes: from the k-gram to the right (side 0) and, reversed, to the left (side 1) of each anchor (id, twin, at)."""
    places = to_sort.groupBy("id", "twin").agg(F.collect_list("at").alias("ats"))  # of one document
    joined = docs.join(places, ["id", "twin"]).select("id", "twin", "text", "ats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["id", "twin", "at", "side", "bytes"])

        held = []
        for batch in batches:
            for i, w, text, ats in zip(*(batch.column(x) for x in ("id", "twin", "text", "ats")), strict=True):
                i, w, raw = i.as_py(), w.as_py(), text.as_py().encode()
                for at in ats.values.to_pylist():
                    lo = at >> 20
                    place = lo + (at >> 10 & 1023)
                    held.append((i, w, at, 0, raw[place : lo + (at & 1023) + WIDTH]))
                    held.append((i, w, at, 1, raw[lo : place + GRAM][::-1]))
                    if len(held) >= BATCH:
                        yield out(held)
                        held = []
        if held:
            yield out(held)

    return joined.transform(c.in_arrow, run, "id long, twin long, at long, side int, bytes binary")


def named(rows: DataFrame, level: int) -> DataFrame:
    """rows (id, twin, at, side, bytes, name) with the rank of (name, next triple) among the distinct ones as their name.

    Equal keys may lie in several range partitions, so no key is too frequent for a task. Each partition tells its first
    and last key and how many it has; from these rows (two for each partition) follow the partitions' first names.
    """
    key = F.concat(F.unhex(F.lpad(F.hex("name"), 16, "0")), F.expr(f"substring(bytes, {level * TRIPLE + 1}, {TRIPLE})"))
    dealt = rows.withColumn("key", key).repartitionByRange("key", "id", "twin", "at").sortWithinPartitions("key", "id", "twin", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, last, part = ["id", "twin", "at", "side", "bytes", "name", "part", "edge"], -1, None, None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            if not keys:
                continue
            new = np.fromiter((x != y for x, y in zip(keys, [last, *keys], strict=False)), bool, len(keys))
            index = n + np.cumsum(new)
            if last is None:
                part = batch.column("part")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([None], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32())] + [pa.array([keys[0]], pa.binary()), pa.array([0], pa.int64()), pa.array([part], pa.int32()), pa.array([True])], names=names)
            n, last = int(index[-1]), keys[-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names[:5]), pa.array(index), batch.column("part"), pa.array(np.zeros(len(keys), bool))], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32())] + [pa.array([last], pa.binary()), pa.array([n], pa.int64()), pa.array([part], pa.int32()), pa.array([True])], names=names)

    found = c.settle(dealt.withColumn("part", F.spark_partition_id()).transform(c.in_arrow, run, "id long, twin long, at long, side int, bytes binary, name long, part int, edge boolean"), "named", TAKEN)
    edges: dict[int, list] = {}
    for r in found.where("edge").select("part", "name", "bytes").collect():
        edges.setdefault(r["part"], []).append((r["name"], bytes(r["bytes"])))
    base, before, starts = 0, None, []
    for part, own in sorted(edges.items()):
        (_, first), (n, last) = min(own, key=lambda x: x[0]), max(own, key=lambda x: x[0])
        base -= first == before
        starts.append((part, base))
        base, before = base + n + 1, last
    offsets = c.of_rows(found.sparkSession, starts, ["part", "base"], [pa.int32(), pa.int64()])
    out = found.where("not edge").join(F.broadcast(offsets), "part")
    out = out.select("id", "twin", "at", "side", "bytes", (F.col("name") + F.col("base")).alias("name"))
    out.settled_at = found.settled_at
    return out


def _common_prefix(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The length of the common prefix of each two strings of at most WIDTH bytes."""
    x, y = (np.frombuffer(b"".join(s.ljust(WIDTH, b"\0") for s in q), np.uint8).reshape(-1, WIDTH) for q in (a, b))
    differ = x != y
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
    return np.minimum(same, np.fromiter((min(len(p), len(q)) for p, q in zip(a, b, strict=True)), np.int64, len(a)))


def adjacent(rows: DataFrame) -> DataFrame:
    """id, twin, at, side, least, names: for each prefix of least, least + 1, ... bytes by which one of the anchor's windows may
    agree with a neighbour, the group of suffixes that share it. Groups are named by where they start.

    A partition doesn't know groups that start before it (-1); it tells its first and last suffix and the groups of its
    last one, and from these rows (one for each partition) follow the groups that go on.
    """
    level = WIDTH // TRIPLE
    key = [F.col("name"), F.expr(f"substring(bytes, {level * TRIPLE + 1}, {TRIPLE})"), F.col("id"), F.col("twin"), F.col("at")]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key).drop("name").withColumn("part", F.spark_partition_id())
    lengths = np.arange(GRAM, WIDTH + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = ["id", "twin", "at", "side", "least", "names", "part", "first", "last"]
        start = np.full(len(lengths), -1, np.int64)  # of the last row's group, by length
        held = None  # the last row, as long as its successor isn't known
        before, number, opened, part = None, 0, None, 0

        def flush(rows, after):
            """Rows whose neighbours are known; after: the row behind them, or None at the end."""
            nonlocal start, before, number
            ids, twin, at, side, body = rows
            strings = [bytes([k]) + x for k, x in zip(side, body, strict=True)]  # sides don't share a prefix
            around = [strings[0] if before is None else before, *strings, *([after] if after is not None else [])]
            common = np.maximum(_common_prefix([x[1:] for x in around[1:]], [x[1:] for x in around[:-1]]), 0)
            common[[x[0] != y[0] for x, y in zip(around[1:], around[:-1], strict=True)]] = 0
            if before is None:
                common[0] = WIDTH  # may go on from the partition before
            if after is None:
                common = np.append(common, WIDTH)
            n = len(ids)
            here = np.arange(number, number + n)
            back, run_ = (at >> 10) & 1023, at & 1023
            right = side == 0
            least = np.where(right, WIDTH - back, GRAM + back - run_)
            most = np.minimum(np.where(right, WIDTH - back + run_, GRAM + back), np.maximum(common[:n], common[1 : n + 1]))
            groups = np.empty((n, len(lengths)), np.int64)
            for k, length in enumerate(lengths):
                own = np.where(common[:n] < length, (part << PART_BITS) | here, -2)
                own[0] = own[0] if own[0] != -2 else start[k]
                groups[:, k] = own[_last(np.concatenate([[True], own[1:] != -2]))] if n else own
            start, before, number = groups[-1].copy(), strings[-1], number + n
            some = np.flatnonzero(most >= least)
            sizes = (most - least + 1)[some]
            begin = np.cumsum(sizes) - sizes
            inside = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
            flat = groups[np.repeat(some, sizes), np.repeat(least[some] - GRAM, sizes) + inside]
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, sizes.sum()).astype(np.int32)), pa.array(flat))
            none = pa.nulls(len(some), pa.binary())
            return pa.RecordBatch.from_arrays([*(pa.array(x[some]) for x in (ids, twin, at)), pa.array(side[some].astype(np.int32)), pa.array(least[some].astype(np.int32)), lists, pa.array(np.full(len(some), part, np.int32)), none, none], names=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [*_cols(batch, "id", "twin", "at", "side"), batch.column("bytes").to_pylist()]
            if held is None:
                part = batch.column("part")[0].as_py()
                opened = bytes([rows[3][0]]) + rows[4][0]
            else:
                rows = [np.concatenate([h, x]) if isinstance(x, np.ndarray) else h + x for h, x in zip(held, rows, strict=True)]
            held = [x[-1:] for x in rows]
            if len(rows[0]) > 1:
                yield flush([x[:-1] for x in rows], bytes([held[3][0]]) + held[4][0])
        if held is not None:
            yield flush(held, None)
            none = [pa.nulls(1, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([start.tolist()], pa.list_(pa.int64())), pa.array([part], pa.int32()), pa.array([opened], pa.binary()), pa.array([before], pa.binary())], names=schema)

    found = c.settle(dealt.transform(c.in_arrow, run, "id long, twin long, at long, side int, least int, names array<long>, part int, first binary, last binary"), "adjacent", TAKEN)
    carried, last, groups = [], None, [-1] * len(lengths)
    for r in found.where("last is not null").orderBy("part").select("part", "names", "first", "last").collect():
        first = bytes(r["first"])
        common = 0 if last is None or first[0] != last[0] else int(_common_prefix([first[1:]], [last[1:]])[0])
        before = [g if common >= k else r["part"] << PART_BITS for k, g in zip(lengths.tolist(), groups, strict=True)]
        carried.append((r["part"], before))
        groups = [b if g == -1 else g for g, b in zip(r["names"], before, strict=True)]
        last = bytes(r["last"])
    carry = c.of_rows(found.sparkSession, carried, ["part", "before"], [pa.int32(), pa.list_(pa.int64())])
    whole = F.transform("names", lambda x, i: F.when(x == -1, F.element_at("before", F.col("least") - GRAM + i + 1)).otherwise(x))
    out = found.where("last is null").join(F.broadcast(carry), "part").select("id", "twin", "at", "side", "least", whole.alias("names"))
    out.settled_at = found.settled_at
    return out


def repeated_windows(near: DataFrame) -> DataFrame:
    """id, twin, at, e of the windows that have an earlier equal one, from the two sides of each anchor (`adjacent`)."""
    side = lambda k, n: near.where(F.col("side") == k).select("id", "twin", "at", F.col("least").alias(f"l{n}"), F.col("names").alias(f"n{n}"))
    both = side(0, "r").join(side(1, "l"), ["id", "twin", "at"])
    lo = F.greatest(WIDTH + 1 - F.col("lr") - F.size("nr"), F.col("ll") - GRAM)
    hi = F.least(WIDTH - F.col("lr"), F.col("ll") + F.size("nl") - 1 - GRAM)
    both = both.withColumns({"lo": lo, "hi": hi}).where("lo <= hi").withColumn("d", F.explode(F.sequence("lo", "hi")))
    start = F.shiftright("at", 20) + F.expr("(shiftright(at, 10) & 1023)") - F.col("d")
    left = F.shiftleft(F.element_at("nl", F.col("d") + GRAM - F.col("ll") + 1), 7) + F.col("d")
    windows = both.select("id", "twin", F.shiftleft(start, 20).alias("at"), F.element_at("nr", WIDTH - F.col("d") - F.col("lr") + 1).alias("kg"), left.alias("cx"))
    return c.settle(classes(windows, lambda batch: [tuple(_cols(batch, "kg", "cx", "id", "twin", "at"))], None).where("e > 0"), "again", TAKEN)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (id, twin, at) become one row for each document, with the flat starts and ends of what goes."""

    def out(rows):
        ids, twin, s, e = rows
        first = np.flatnonzero(_changes(ids, twin))
        flat = np.stack([s, e], axis=1).reshape(-1)
        return pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(twin[first]), pa.ListArray.from_arrays(pa.array(np.append(first * 2, len(flat)).astype(np.int32)), pa.array(flat))], names=["id", "twin", "spans"])

    held = None
    for batch in batches:
        rows = _cols(batch, "id", "twin", "at", "e")
        rows = _runs(*(np.concatenate(x) for x in zip(held, rows, strict=True))) if held is not None else _runs(*rows)
        if not len(rows[0]):
            continue
        cut = int(np.flatnonzero(_changes(*rows[:2]))[-1])  # the last document may go on
        if cut:
            yield out([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield out(held)


def with_keys(docs: DataFrame, key: str = "id", twin: str = "twin") -> tuple[DataFrame, bool]:
    """docs (doc_id, text, ...) with what tells documents apart, and whether some share an id: key, and twin, which is 0 unless they do."""
    told = c.free(docs, "_several")
    docs = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)), twin: F.lit(0).cast("long")})
    several = c.settle(docs.groupBy(key).agg(F.count(F.lit(1)).alias(told)).where(F.col(told) > 1), "several")
    if several.isEmpty():
        c.forget(several)
        return docs, False
    joined = c.join_by_size(docs, several, key, "left")
    return joined.withColumn(twin, F.when(F.col(told).isNotNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(0)).drop(told), True


def marks(docs: DataFrame, wide: int = WIDE, merged: int = MERGED) -> DataFrame:
    """id, twin, spans (settled): the byte ranges to remove from docs (doc_id, text), sorted, apart; a row for each document that has any."""
    own, several = with_keys(docs.select("doc_id", "text"))
    own = own.select("id", "twin", F.coalesce("text", F.lit("")).alias("text"))
    found = c.settle(classes(own, _anchored, wide, merged), "classes", TAKEN)
    apart = own.dropDuplicates(["id", "twin"]) if several else own
    rows = c.settle(sides(apart, found.where("e = 0")).withColumn("name", F.col("side").cast("long")), "sides", TAKEN)
    for level in range(WIDTH // TRIPLE):
        after = named(rows, level)
        c.forget(rows)
        rows = after
    near = adjacent(rows)
    c.forget(rows)
    again = repeated_windows(near)
    c.forget(near)
    dealt = found.where("e > 0").unionByName(again).repartition("id", "twin").sortWithinPartitions("id", "twin", "at")
    out = c.settle(dealt.transform(c.in_arrow, _merged, "id long, twin long, spans array<long>"), "marks", TAKEN)
    c.forget(found, again)
    return out


def _with_spans(docs: DataFrame, spans: str) -> DataFrame:
    """docs with the flat starts and ends of what goes, in a column named `spans`."""
    found = marks(docs)
    key, twin = c.free(docs, "_id"), c.free(docs, "_twin")
    keyed, _ = with_keys(docs, key, twin)
    named_ = found.withColumnsRenamed({"id": key, "twin": twin, "spans": spans})
    return c.join_by_size(keyed, named_, [key, twin], "left", found).drop(key, twin)


def cut(raw: bytes, spans: list[int] | None) -> tuple[bytes, int]:
    """What is left of raw and the number of runs removed."""
    if not spans:
        return raw, 0
    left, at, n = [], 0, 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        if s < len(raw):
            left.append(raw[at:s])
            at, n = min(e, len(raw)), n + 1
    return b"".join([*left, raw[at:]]), n


_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("_spans"), strict=True):
                raw = (text.as_py() or "").encode()
                kept, n = cut(raw, spans.as_py())
                rows.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            a, b, n, h = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs, "_spans").select("doc_id", "text", "_spans").transform(c.in_arrow, run, _SCHEMA)


def keep_rest(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """docs with repeated bytes cut out of text (a character that is cut in half goes too); n_chars follows if there is one."""
    c.small_batches(spark)
    schema, gone = docs.schema, c.free(docs, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lengths = [], []
            for text, spans in zip(batch.column("text"), batch.column(gone), strict=True):
                text, spans = text.as_py(), spans.as_py()
                texts.append(cut(text.encode(), spans)[0].decode(errors="ignore") if text and spans else text)
                lengths.append(None if text is None else len(texts[-1]))
            arrays = []
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                if name == "text":
                    column = pa.array(texts, pa.string())
                elif name == "n_chars":
                    column = pa.array(lengths, pa.int64()).cast(column.type)
                if name != gone:
                    arrays.append((name, column))
            yield pa.RecordBatch.from_arrays([x for _, x in arrays], names=[n for n, _ in arrays])

    return _with_spans(docs, gone).select(*docs.columns, gone).transform(c.in_arrow, run, schema)
