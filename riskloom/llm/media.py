r"""Media columns: texts stored as 8-bit grey images in archives, read back through a Spark data source.

`write_archives` packs each payload as a losslessly compressed image (64 samples a row) and the images as
members of ZIP archives. The data source `media_archives` plans byte-range partitions over the archive
directory; a task reads the members whose offset lies in its range, each by its own offset and with its own
retries, and streams them as Arrow batches.

Defined cases: a null or empty text is 0 bytes, padded to one row of zeros. Null ids are kept. Repeated rows
are members each. Very long texts are single large members, read one at a time. An empty table gives an empty
directory and no rows. Extra columns aren't looked at. A member that stays unreadable after all retries or
whose checksum is wrong raises an error.
"""

from __future__ import annotations

import hashlib
import re
import struct
import time
import uuid
import warnings
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import _common as c, _files

UNIT = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 1 << 26, 1 << 23, 1 << 22
TRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes, unit: int = UNIT) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def encode_image(payload: bytes, n_bytes: int, level: int = 1) -> bytes:
    """A grey 8-bit PNG with UNIT samples a row; n_bytes goes into a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    lines = np.zeros((len(rows), UNIT + 1), np.uint8)  # filter 0 before each line
    lines[:, 1:] = rows

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(lines, level)) + chunk(b"IEND", b"")


def decode_image(image: bytes) -> tuple[bytes, int]:
    """The samples and n_bytes of an image of encode_image's kind."""
    if not image.startswith(_SIGNATURE):
        raise ValueError("no PNG")
    at, data, n_bytes, shape = 8, [], None, (0, 0)
    while at < len(image):
        (size,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is read")
    return lines[:, 1:].tobytes(), n_bytes


def features_of(payload: bytes) -> str:
    """Mean, spread, entropy and share of zeros of the samples, and the mean step between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    n, values = len(x), np.arange(256)
    mean = int(counts @ values) / n
    spread = max(0.0, int(counts @ (values * values)) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum())
    step = int(np.abs(np.diff(x.astype(np.int16))).sum()) / max(1, n - 1)
    return f"mean={mean:.3f};std={spread:.3f};entropy={abs(entropy):.3f};zero={int(counts[0]) / n:.4f};step={step:.3f}"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """ZIP archives of docs (doc_id, text) in folder; their manifest (path, size, members), settled.

    Every attempt of a task has files of its own; the manifest has those of the attempts that Spark took.
    """
    _files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warnings.filterwarnings("ignore", "Duplicate name")
        part, token, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        waiting = (row for batch in batches for row in zip(batch.column("doc_id"), batch.column("text"), strict=True))
        row = next(waiting, None)
        while row is not None:
            name, members = f"part-{part:06d}-{number:04d}-{token}.zip", 0
            with _files.writing(folder, name, token) as out:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    size = 0
                    while row is not None and size < archive_bytes:
                        doc_id, raw = row[0].as_py(), (row[1].as_py() or "").encode()
                        image = encode_image(padded(raw), len(raw))
                        archive.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}.png"), image)
                        size += len(image)
                        members += 1
                        row = next(waiting, None)
                whole = out.tell()
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{_files.at(folder)[1]}/{name}"]), pa.array([whole], pa.int64()), pa.array([members], pa.int64())], names=["path", "size", "members"])

    return c.settle(docs.select("doc_id", "text").transform(c.in_arrow, run, "path string, size long, members long"), "manifest")


class _Range(InputPartition):
    def __init__(self, path: str, lo: int, hi: int):
        super().__init__((path, lo, hi))
        self.path, self.lo, self.hi = path, lo, hi


class MediaArchives(DataSource):
    """spark.read.format("media_archives").option("path", folder): archive, offset, name, media of each member.

    Option manifest: a folder of Parquet files (path, size) that name the archives to read; without it all of `path`.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.manifest = options["path"], options.get("manifest")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[_Range]:
        """Byte ranges of the archives; the plan of a scan, as of any file source, is made on the driver."""
        files = _files.rows(self.manifest, ["path", "size"]) if self.manifest else _files.listing(self.folder, ".zip")
        return [_Range(path, lo, lo + self.range_bytes) for path, size in files for lo in range(0, size, self.range_bytes)] or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store = _files.at(self.folder)[0]
        with store.open_input_file(partition.path) as file, zipfile.ZipFile(file) as archive:
            mine = sorted((x for x in archive.infolist() if partition.lo <= x.header_offset < partition.hi), key=lambda x: x.header_offset)
            held, size = [], 0
            for member in mine:
                media = self._member(partition.path, archive, member)
                held.append((partition.path, member.header_offset, member.filename, media))
                size += len(media)
                if size >= self.batch_bytes:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _member(self, path: str, archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> bytes:
        """One member by its offset; when reading it fails, it alone is tried again, with the archive opened anew."""
        for left in range(self.tries - 1, -1, -1):
            try:
                if left == self.tries - 1:
                    return archive.open(member).read()
                with _files.at(self.folder)[0].open_input_file(path) as file, zipfile.ZipFile(file) as again:
                    return again.open(next(x for x in again.infolist() if x.header_offset == member.header_offset)).read()
            except (OSError, zipfile.BadZipFile, zlib.error):
                if not left:
                    raise
                time.sleep(0.1)
        raise AssertionError

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        a, o, n, m = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.string()), pa.array(m, pa.binary())], names=["archive", "offset", "name", "media"])


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(path=folder, **options).load()


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """What the stored images hold, and their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {x.split()[0]: [] for x in _SCHEMA.split(", ")}
            for name, image in zip(batch.column("name"), batch.column("media"), strict=True):
                image = image.as_py()
                payload, n_bytes = decode_image(image)
                m = re.fullmatch(r"(-?\d+)\.png", name.as_py())
                for key, value in (("doc_id", int(m[1]) if m else None), ("n_bytes", n_bytes), ("payload_bytes", len(payload)), ("payload_sha256", hashlib.sha256(payload).hexdigest()), ("tail_crc32", zlib.crc32(payload[-UNIT:])), ("media_bytes", len(image)), ("media_sha256", hashlib.sha256(image).hexdigest()), ("feature", features_of(payload))):
                    out[key].append(value)
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds[t]) for n, t in (x.split() for x in _SCHEMA.split(", "))], names=list(out))

    return media.select("name", "media").transform(c.in_arrow, run, _SCHEMA)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = c.fresh_path(spark, "media")
    manifest = write_archives(c.table(spark, sf_dir, "documents"), folder)
    return digests(read_archives(spark, folder, manifest=manifest.settled_at))
