"""What the operators of this subpackage share: tables, the shared folder, settled tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _files

#: Bytes up to which a keyed side may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 16 << 20
#: What a job that settles a table runs with: no shuffle files left when it is over.
_SETTLING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def small_batches(spark: SparkSession) -> None:
    """Let texts reach Python in Arrow batches of a few MB, unless the session has its own bound."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema); workers, which Spark keeps for later tasks, give back what a task has freed."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return df.mapInArrow(freed, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session gets one in /tmp; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def settle(df: DataFrame, name: str, batch: int = 4 << 20) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors. Rows reach Python in batches of `batch` bytes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _settings(spark, _SETTLING | {"spark.sql.execution.arrow.maxBytesPerBatch": str(batch)}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def of_rows(spark: SparkSession, rows: list[tuple], names: list[str], types: list[pa.DataType]) -> DataFrame:
    """A table of a few rows of the driver, by way of Arrow: tuples would go through an RDD, for which each executor starts Python workers beside those of mapInArrow."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, types, strict=True)], names=names))


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        store, path = _files.at(df.settled_at)
        store.delete_dir(path)


def join_by_size(left: DataFrame, right: DataFrame, on, how: str, settled: DataFrame | None = None, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast the right side when the files of the settled table that it is (or is made of) are small enough, else shuffle both."""
    small = _files.total((right if settled is None else settled).settled_at) <= most
    return left.join(F.broadcast(right) if small else right, on, how)


def free(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name in any case."""
    taken = {x.lower() for x in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
