"""Tables that a job writes once and reads again: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, in a folder of this application. Where that is unset, a local session gets one in /tmp, which goes when Python ends; a cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str):
    """A path's store and the path, of any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """path as Spark names it in the metadata of files."""
    store, at = _at(spark, path)
    return store.makeQualified(at).toString()


def exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    store, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path and all below it."""
    store, at = _at(spark, path)
    store.delete(at, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again, with the number of its rows (rows_at_most) that the writing job observed; a repeated stage may count rows again."""
    path, seen = scratch(df.sparkSession, name), Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at, out.rows_at_most = path, seen.get["rows"]
    return out


def forget(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.settled_at)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has settled; to be called when none of its results is read any more."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        delete(spark, f"{at.rstrip('/')}/{spark.sparkContext.applicationId}")
