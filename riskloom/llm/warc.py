r"""WARC archives: written with revisit records for equal payloads, read by verified boundary chains.

Reading splits every archive into byte ranges. A task reports, for every place in its range where a record
seems to begin, where the chain of records starting there leaves the range. Pointer jumping over these exits
from the start of each file finds the one true entry of each range; what merely looks like a record inside a
payload is never reached. A second pass parses the records from the entries.

Defined cases: a null html is an empty payload; a null url gives no target header; line ends in a url are
percent-encoded. Payloads shorter than `least` bytes are always responses. Rows of one digest whose page_id
is the largest are responses (also when repeated), rows with a null page_id revisit a known one if there is
one. An empty table gives no archives and no rows. Extra columns aren't looked at. A truncated archive or a
digest that doesn't fit raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _common as c, _files

MAGIC = b"WARC/1.0\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive file, about, and of a range that a task reads.
FILE_BYTES, RANGE_BYTES = 1 << 26, 1 << 22
#: Ranges of a task, about.
RANGES = 4
#: Bytes read for a header at first; longer ones are read again.
HEADER_BYTES = 1 << 16
LEAST = 0


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_targets(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, refers_to: the largest page_id of equal payloads, null for that row itself."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"))
    same = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n"))
    same = c.settle(same.where("n > 1 and target is not null").select("sha", "target"), "same")
    joined = c.join_by_size(rows, same, "sha", "left")
    revisit = F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("target")).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archive files of rows (page_id, url, html, refers_to); their manifest (path, size, records), settled.

    Every attempt of a task has files of its own. The manifest has those of the attempts that Spark took, so what an
    attempt that was lost or repeated has left is never read.
    """
    _files.make_folder(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, token, number = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        waiting = (row for batch in batches for row in zip(*(batch.column(x) for x in ("page_id", "url", "html", "refers_to")), strict=True))
        row = next(waiting, None)
        while row is not None:
            name, size, records = f"part-{part:06d}-{number:04d}-{token}.warc", 0, 0
            with _files.writing(folder, name, token) as out:
                while row is not None and size < file_bytes:
                    page_id, url, html, target = (x.as_py() for x in row)
                    one = record(page_id, url, (html or "").encode(), target)
                    out.write(one)
                    size += len(one)
                    records += 1
                    row = next(waiting, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([f"{_files.at(folder)[1]}/{name}"]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "size", "records"])

    return c.settle(rows.select("page_id", "url", "html", "refers_to").transform(c.in_arrow, run, "path string, size long, records long"), "manifest")


class _File:
    """Reads pieces of one archive."""

    def __init__(self, path: str, uri: str):
        self.file = _files.at(uri)[0].open_input_file(path)
        self.size = self.file.size()

    def piece(self, start: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - start)), start)

    def header(self, at: int, have: bytes = b"", have_at: int = 0) -> tuple[int, int, bytes] | None:
        """(start of block, successor, header lines) of the record that seems to begin at `at`, or None."""
        end = have.find(b"\r\n\r\n", at - have_at, at - have_at + HEADER_BYTES) if have else -1
        if end >= 0:
            head = have[at - have_at : end]
        else:
            n = HEADER_BYTES
            while (end := (more := self.piece(at, n)).find(b"\r\n\r\n")) < 0:
                if len(more) < n or not more.startswith(MAGIC):
                    return None
                n *= 4
            head = more[:end]
        if not head.startswith(MAGIC) or not (length := re.search(rb"\r\nContent-Length: (\d{1,18})(?:\r\n|$)", head)):
            return None
        block = at + len(head) + 4
        return block, block + int(length[1]) + 4, head


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, size of a folder's archives that no manifest names."""
    return spark.createDataFrame(_files.listing(folder, ".warc"), "path string, size long")


def _ranges(manifest: DataFrame, range_bytes: int) -> tuple[DataFrame, int]:
    """path, size, lo, hi of every range, and how many the largest file has."""
    files = manifest.where("size > 0")
    n = F.ceil(F.col("size") / range_bytes).cast("long")
    most, ranges = files.agg(F.max(n), F.sum(n)).first()
    rows = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("lo"))
    rows = rows.withColumn("hi", F.least(F.col("lo") + range_bytes, F.col("size")))
    return rows.repartition(max(1, -(-(ranges or 0) // RANGES)), "path", "lo"), most or 0


def exits(ranges: DataFrame, folder: str) -> DataFrame:
    """path, at, out: for each place that looks like a record, where its chain leaves the range it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, lo, hi in zip(*(batch.column(x).to_pylist() for x in ("path", "size", "lo", "hi")), strict=True):
                file = _File(path, folder)
                data = file.piece(lo, hi - lo + HEADER_BYTES)
                places, leads = [], {}
                for m in re.finditer(re.escape(MAGIC), data):
                    if m.start() < hi - lo:
                        found = file.header(lo + m.start(), data, lo)
                        if found and found[1] <= size:
                            places.append(lo + m.start())
                            leads[lo + m.start()] = found[1]
                for place in reversed(places):  # successors lie behind, so they are known already
                    leads[place] = leads.get(leads[place], leads[place])
                if places:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(places)), pa.array(places, pa.int64()), pa.array([leads[x] for x in places], pa.int64())], names=["path", "at", "out"])

    return ranges.transform(c.in_arrow, run, "path string, at long, out long")


def entries(spark: SparkSession, ranges: DataFrame, folder: str, most: int) -> DataFrame:
    """path, at: the true entry of each range, by pointer jumping from the start of each file."""
    jump = c.settle(exits(ranges, folder), "exits")
    reached = ranges.where("lo = 0").select("path", F.lit(0).cast("long").alias("at"))
    steps = 1
    while True:
        ahead = reached.join(jump, ["path", "at"]).select("path", F.col("out").alias("at"))
        reached = c.settle(reached.unionByName(ahead).distinct(), "reached")
        if steps >= most:
            return reached
        further = jump.select("path", F.col("at").alias("out"), F.col("out").alias("further"))
        jump = c.settle(jump.join(further, ["path", "out"], "left").select("path", "at", F.coalesce("further", "out").alias("out")), "jump")
        steps *= 2


_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, manifest: DataFrame | None = None) -> DataFrame:
    """A row for each record of the folder's archives (those of the manifest, if there is one); digests of responses are taken from the bytes read."""
    ranges, most = _ranges(listed(spark, folder) if manifest is None else manifest, range_bytes)
    if not most:
        return spark.createDataFrame([], _SCHEMA)
    true = entries(spark, ranges, folder, most)
    inside = ranges.join(true.withColumn("range", F.floor(F.col("at") / range_bytes)).withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.floor(F.col("lo") / range_bytes) == F.col("range")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, hi, at in zip(*(batch.column(x).to_pylist() for x in ("path", "size", "hi", "at")), strict=True):
                file, rows = _File(path, folder), []
                while at < hi:
                    found = file.header(at)
                    if not found or found[1] > size:
                        raise ValueError(f"{path}: no whole record at {at}")
                    block, after, head = found
                    rows.append(_parsed(head, file.piece(block, after - 4 - block), path, at))
                    at = after
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return inside.select("path", "size", "hi", "at").transform(c.in_arrow, run, _SCHEMA)


def _parsed(head: bytes, block: bytes, path: str, at: int) -> dict:
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    said = named["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind = named["WARC-Type"]
    if kind == "response" and (digest_of(payload) != said or len(payload) != size):
        raise ValueError(f"{path}: the payload at {at} doesn't fit its digest")
    number = lambda x: int(m[1]) if x and (m := re.search(r"<urn:page:(-?\d+)>", x)) else None
    url = named.get("WARC-Target-URI")
    url = re.sub(r"%(0D|0A|25)", lambda m: chr(int(m[1], 16)), url) if url is not None else None
    return {"page_id": number(named["WARC-Record-ID"]), "url": url, "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": number(named.get("WARC-Refers-To"))}


def round_trip(pages: DataFrame, least: int = LEAST, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """pages written and read back, settled; it's an error if not as many records come back as were written."""
    spark = pages.sparkSession
    folder = c.fresh_path(spark, "warc")
    manifest = write(with_targets(pages, least), folder, file_bytes)
    out = c.settle(read(spark, folder, range_bytes, manifest), "records")
    written, found = manifest.agg(F.sum("records")).first()[0] or 0, out.count()
    if written != found:
        raise ValueError(f"{written} records were written, {found} were read")
    return out


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(c.table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
