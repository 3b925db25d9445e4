"""Token ids in binary files: ids ranked by frequency, codes of one to four whole bytes, control bytes apart from them.

1. Documents become token ids and an end id; the table of ids is settled once.
2. Each task counts the ids it made, Spark sums the counts (a row for each id that occurs, so the vocabulary bounds them). The commonest id
   gets rank 0. A rank below 256 takes one byte, below 65,536 two, and so on.
3. Each task encodes documents, which are settled once more: a control byte holds the lengths of four codes, the codes' bytes follow in a stream of their
   own. Documents begin at a control byte, so they can be moved whole.
4. Spark range-sorts the encoded documents by doc_id. Each task writes one file of blocks (a table of documents, the control
   bytes, the codes, a checksum). The manifest names the files of finished attempts in order; a running sum over it, a row for
   each file, gives each file's first position.
5. Readers take the ranks' ids and the blocks from the files and decode by table lookup: a control byte's row in one table says
   how many bytes it covers, its row in another which byte goes where in four 32-bit numbers.

Defined cases: a null or empty text is the end id alone. Documents with a null id come first, with a null id. Rows with equal ids follow
each other in an order of their content; repeated rows are stored each. A very long text is a block of its own. An empty table gives no file and no
rows. Extra columns aren't looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from . import _common as c, _files
from .packing import Encoder, _sliced, added_tokens, vocabulary

END = 0
MAGIC, RANKS_MAGIC = b"RLIDS\x00\x01\n", b"RLRNK\x00\x01\n"
#: Bytes of codes after which a block ends; a document is never split.
BLOCK = 4 << 20
#: Control bytes that are decoded at once.
LANES = 1 << 16
#: Documents, control bytes and code bytes of a block, and the checksum of all of them.
_HEAD = struct.Struct("<QQQI")

_SIZES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1  # of the four codes of each control byte
_COVERS = _SIZES.sum(axis=1)
_BYTE = np.arange(4)
_FROM = (np.where(_BYTE < _SIZES[:, :, None], (np.cumsum(_SIZES, axis=1) - _SIZES)[:, :, None] + _BYTE, 0)).reshape(256, 16)  # place of each of the 16 result bytes
_USED = (_BYTE < _SIZES[:, :, None]).reshape(256, 16).astype(np.uint8)


def encode(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes, code bytes, and the code bytes that each control byte covers; a multiple of four ranks."""
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    control = ((size - 1).reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    codes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[_BYTE < size[:, None]]
    return control, codes, _COVERS[control]


def decode(control: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ranks, four for each control byte, by lookup of the control byte in tables."""
    out = np.empty(4 * len(control), np.uint32)
    at, codes = 0, np.append(codes, np.zeros(16, np.uint8))
    for lo in range(0, len(control), LANES):
        own = control[lo : lo + LANES]
        covers = _COVERS[own]
        start = at + np.cumsum(covers) - covers
        out[4 * lo : 4 * (lo + len(own))] = (codes[start[:, None] + _FROM[own]] * _USED[own]).view("<u4").ravel()
        at += int(covers.sum())
    return out


def id_type(path: str, end: int, added: dict[str, int] | None) -> str:
    """Two bytes for an id where all fit in, else four."""
    with open(path, "rb") as file:
        most = max([end, *(added or {}).values(), *(int(line.split()[1]) for line in file if line.strip())])
    return "<u2" if most < 1 << 16 else "<u4"


def token_ids(docs: DataFrame, path: str | None = None, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, ids (of id_type's bytes, the end id last) of each document; and for each task a row of counts (pairs of ids and counts, 64-bit) alone."""
    path = path or vocabulary()
    kind = id_type(path, end, added)
    names = ["doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(path, added), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part, ids in _sliced(batch, encoder):
                ends = [np.append(x, np.uint32(end)) for x in ids]
                own = np.bincount(np.concatenate(ends)) if ends else total[:0]
                total = np.append(total, np.zeros(max(0, len(own) - len(total)), np.int64))
                total[: len(own)] += own
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(kind).tobytes() for x in ends], pa.binary()), pa.nulls(len(ends), pa.binary())], names=names)
        found = np.flatnonzero(total)
        if len(found):
            counts = np.column_stack([found, total[found]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(c.in_arrow, run, "doc_id long, ids binary, counts binary")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column and each row's number of them."""
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    ids = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind)
    return ids, np.diff(off) // ids.itemsize


def ranking(tokens: DataFrame) -> np.ndarray:
    """The ids that occur, commonest first, equal counts by id; as many as the vocabulary has at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("counts"):
                pairs = np.frombuffer(counts.as_py(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "n"])

    told = tokens.where("counts is not null").select("counts")  # a row for each task
    counted = told.transform(c.in_arrow, rows, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = (counted.column(x).to_numpy() for x in ("id", "n"))
    return ids[np.lexsort((ids, -n))].astype(np.uint32)


def encoded(tokens: DataFrame, by_rank: np.ndarray, kind: str) -> DataFrame:
    """doc_id, n_tokens, control, codes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
        rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n = _flat(batch.column("ids"), kind)
            lanes = -(-n // 4)
            first = np.cumsum(lanes) - lanes
            padded = np.zeros(4 * int(lanes.sum()), np.uint32)
            padded[np.arange(len(ids)) + np.repeat(4 * first - (np.cumsum(n) - n), n)] = rank[ids]
            control, codes, covers = encode(padded)
            edge = np.append(0, np.cumsum(covers))[np.append(first, len(control))]
            lists = lambda data, off: pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n.astype(np.int64)), lists(control, np.append(first, len(control))), lists(codes, edge)], names=["doc_id", "n_tokens", "control", "codes"])

    return tokens.where("counts is null").select("doc_id", "ids").transform(c.in_arrow, run, "doc_id long, n_tokens long, control binary, codes binary")


def _block(rows: list[tuple]) -> bytes:
    """rows: doc_id (or None), tokens, control bytes, code bytes."""
    ids, n, control, codes = zip(*rows, strict=True)
    table = np.array([[x is not None, x or 0, k, len(b)] for x, k, b in zip(ids, n, codes, strict=True)], "<i8").tobytes()
    control, codes = b"".join(control), b"".join(codes)
    return _HEAD.pack(len(rows), len(control), len(codes), zlib.crc32(codes, zlib.crc32(control, zlib.crc32(table)))) + table + control + codes


def write_files(docs: DataFrame, folder: str, path: str | None = None, end: int = END, added: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """Files of docs (doc_id, text) in folder and their manifest (part, path, docs, tokens), settled.

    Every attempt of a task has a file of its own; the manifest has those of the attempts that Spark took.
    """
    _files.make_folder(folder)
    tokens = c.settle(token_ids(docs, path, end, added), "tokens")
    by_rank = ranking(tokens)
    with _files.writing(folder, "ranks", uuid.uuid4().hex) as out:
        out.write(RANKS_MAGIC + by_rank.astype("<u4").tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True))
        row = next(rows, None)
        if row is None:
            return
        part, token = TaskContext.get().partitionId(), uuid.uuid4().hex
        name, held, size, n_docs, n_tokens = f"part-{part:06d}-{token}.ids", [], 0, 0, 0
        with _files.writing(folder, name, token) as out:
            out.write(MAGIC)
            while row is not None:
                held.append(row)
                size += len(row[3])
                n_docs, n_tokens = n_docs + 1, n_tokens + row[1]
                row = next(rows, None)
                if row is None or size + len(row[3]) > block:
                    out.write(_block(held))
                    held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([f"{_files.at(folder)[1]}/{name}"]), pa.array([n_docs]), pa.array([n_tokens])], names=["part", "path", "docs", "tokens"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("control", "codes"), F.col("n_tokens")]
    coded = c.settle(encoded(tokens, by_rank, id_type(path or vocabulary(), end, added)), "coded")  # the range sort reads it twice
    c.forget(tokens)
    dealt = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = c.settle(dealt.transform(c.in_arrow, run, "part long, path string, docs long, tokens long"), "manifest")
    c.forget(coded)
    return manifest


def read_ranks(folder: str) -> np.ndarray:
    """The id of each rank."""
    store, path = _files.at(folder)
    with store.open_input_file(f"{path}/ranks") as file:
        raw = file.read()
    if not raw.startswith(RANKS_MAGIC):
        raise ValueError("no file of ranks")
    return np.frombuffer(raw, "<u4", offset=len(RANKS_MAGIC))


def read_blocks(file, by_rank: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids (or None), tokens of each, and all their ids, block by block."""
    if file.read(len(MAGIC)) != MAGIC:
        raise ValueError("no file of ids")
    while head := file.read(_HEAD.size):
        n_docs, n_control, n_codes, checksum = _HEAD.unpack(head)
        body = file.read(32 * n_docs + n_control + n_codes)
        if len(body) != 32 * n_docs + n_control + n_codes or zlib.crc32(body) != checksum:
            raise ValueError("a block is damaged")
        table = np.frombuffer(body, "<i8", 4 * n_docs).reshape(-1, 4)
        control, codes = np.frombuffer(body, np.uint8, n_control, 32 * n_docs), np.frombuffer(body, np.uint8, n_codes, 32 * n_docs + n_control)
        n = table[:, 2]
        lanes = -(-n // 4)
        first = 4 * (np.cumsum(lanes) - lanes)
        ids = by_rank[decode(control, codes)[np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)]]
        yield [int(x) if there else None for there, x in table[:, :2]], n, ids


def read_documents(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document of the files that the manifest names, a file for each task."""
    before = F.sum("tokens").over(W.orderBy("part")) - F.col("tokens")  # a row for each file
    files = manifest.select("path", before.alias("start")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                by_rank = read_ranks(folder) if by_rank is None else by_rank
                with _files.at(folder)[0].open_input_stream(path) as file:
                    for doc_ids, n, ids in read_blocks(file, by_rank):
                        edge = np.append(0, np.cumsum(n))
                        raw = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * edge), pa.py_buffer(ids.astype("<u4"))])
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + edge[:-1]), pa.array(n), raw.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                        start += int(edge[-1])

    return files.transform(c.in_arrow, run, "doc_id long, start long, n_tokens long, ids binary")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = c.fresh_path(spark, "ids")
    manifest = write_files(c.table(spark, sf_dir, "documents"), folder, added=added_tokens())
    return read_documents(folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
