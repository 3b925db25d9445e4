"""Reading and writing panels, tables and reports as files."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as c
from ..operators.tables import children, exists, qualified, scratch

__all__ = ["scratch"]
#: Headers read at once.
THREADS = 8
#: How columns of periods are named.
PERIOD_NAMES = re.compile(r"(19|20)\d\d|Q[1-4]\s*\d{4}|\d{4}[-_]?Q[1-4]|M\d\d\s*\d{4}|\d{4}[-_]?\d\d", re.IGNORECASE)


class Header(NamedTuple):
    """Where a wide file has what, as places of its columns; None where it has no such column."""

    key: int | None
    entity: int | None
    indicator: int | None
    freq: int | None
    unit: int | None
    periods: tuple[int, ...]

    @classmethod
    def of(cls, names: Sequence[str], key: str | None = None) -> Header:
        """By the names, in any case. The series key is the second column or the last one named so, unless `key` names one."""
        low = [x.strip().lower() for x in names]
        periods = [k for k, x in enumerate(low) if PERIOD_NAMES.fullmatch(x)] or [k for k, x in enumerate(low) if x.replace(".", "").isdigit()]
        free = [k for k in range(len(low)) if k not in periods]

        def take(fits: Callable[[str], bool], last: bool = True) -> int | None:
            found = [k for k in free if fits(low[k])]
            for k in found:
                free.remove(k)
            return (found[-1] if last else found[0]) if found else None

        if key is not None:
            series = list(names).index(key)
            free.remove(series)
        else:
            named = [k for k in free if k == 1 or "series_key" in low[k]]
            series = named[-1] if named else None
            free = [k for k in free if k not in named]
        entity = take(lambda x: x in ("country", "reference area"))
        if entity is None:
            entity = take(lambda x: ("reference area" in x or x == "ref_area") and "date" not in x, last=False)
        indicator, freq = take(lambda x: x in ("indicator", "indicator_name")), take(lambda x: x in ("freq", "frequency"))
        return cls(series, entity, indicator, freq, take(lambda x: "unit" in x and "date" not in x), tuple(periods))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, size, time of the files at and below a path; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("time"))


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files at and below path by their header. As Spark does for the schema of one, the first line of each file is read by a small job of its own; a header is one line."""

    def first(name: str) -> tuple[str, ...] | None:
        line = spark.read.text(name).first()
        return tuple(next(csv.reader([line[0].removeprefix("\ufeff")]), ())) if line else None

    names = sorted(r["path"] for r in listing(spark, path).select("path").collect())
    with ThreadPool(THREADS) as pool:
        lines = pool.map(first, names)
    found: dict[tuple[str, ...], list[str]] = {}
    for name, header in zip(names, lines, strict=True):
        if header:
            found.setdefault(header, []).append(name)
    return found


def _texts(spark: SparkSession, header: Sequence[str], paths: Sequence[str]) -> DataFrame:
    """The rows of files with one header, columns named by their place, all text."""
    return spark.read.schema(", ".join(f"_{k} string" for k in range(len(header)))).option("header", True).csv(list(paths))


def _long(spark: SparkSession, names: tuple[str, ...], paths: Sequence[str], dataset: str, key: str | None, monthly: bool) -> DataFrame:
    at, wide = Header.of(names, key), _texts(spark, names, paths)
    series = F.lit(None).cast("string") if at.key is None else F.col(f"_{at.key}")
    text = lambda k: F.lit("") if k is None else F.coalesce(F.col(f"_{k}"), F.lit(""))
    period = F.col("period_str")
    kind = F.when(period.rlike(r"(?i)m") | period.rlike(r"^\d{4}[-_]\d\d$"), "Monthly").when(period.rlike(r"(?i)q"), "Quarterly").otherwise("Annual")
    periods = spark.createDataFrame([(m, names[k].strip()) for m, k in enumerate(at.periods)], "_k int, period_str string")
    periods = periods.select("_k", "period_str", c.parse_period(period, monthly).alias("t"), kind.alias("_kind"))  # a row for each column
    freq = F.col("_kind") if at.freq is None else F.coalesce(F.nullif(F.trim(F.col("_freq")), F.lit("")), "_kind")
    rows = wide.select(
        F.upper(F.substring(c.key_part(series, 0), 1, 3)).alias("e"), c.key_part(series, 1).alias("i"), text(at.entity).alias("entity_name"), text(at.indicator).alias("indicator_name"),
        text(at.unit).alias("unit"), text(at.freq).alias("_freq"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.array(*[f"_{k}" for k in at.periods])).alias("_k", "_text"),
    )
    rows = rows.where("_text is not null").withColumn("v", c.clean_number(F.col("_text"))).where("v is not null").join(F.broadcast(periods), "_k")
    return rows.select("e", "i", "entity_name", "indicator_name", "unit", freq.alias("freq"), "period_str", "t", "v", F.lit(dataset).alias("dataset"), "file")


PANEL = "e string, i string, entity_name string, indicator_name string, unit string, freq string, period_str string, t date, v double, dataset string, file string"


def read_wide(spark: SparkSession, path: str, dataset: str, key: str | None = None, monthly: bool = True, with_file: bool = False) -> DataFrame:
    """The long panel of wide CSV files: e, i, entity_name, indicator_name, unit, freq, period_str, t, v, dataset (and file).

    Files differ in their columns: each header is read, files with one header are scanned together by its names, and the parts united.
    Columns named like periods become rows, the others are metadata by the rules of `Header`. A byte-order mark is skipped. Blank and unreadable
    values are left out; missing names and units are '', a missing frequency follows from the period. A file without period columns, or without a line, has no rows.
    """
    out = None
    for names, paths in headers(spark, path).items():
        if Header.of(names, key).periods:
            part = _long(spark, names, paths, dataset, key, monthly)
            out = part if out is None else out.unionByName(part)
    out = spark.createDataFrame([], PANEL) if out is None else out
    return out if with_file else out.drop("file")


def file_report(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """file, n_columns, n_periods, n_series (its rows) and n_values (those that are numbers) of each wide CSV file that has a row."""
    out = spark.createDataFrame([], "file string, n_columns int, n_periods int, n_series long, n_values long")
    for names, paths in headers(spark, path).items():
        periods = Header.of(names, key).periods
        values = F.size(F.filter(F.array(*[f"_{k}" for k in periods]), lambda x: c.clean_number(x).isNotNull())) if periods else F.lit(0)
        counts = _texts(spark, names, paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_series"), F.sum(values).cast("long").alias("n_values"))
        out = out.unionByName(counts.select("file", F.lit(len(names)).alias("n_columns"), F.lit(len(periods)).alias("n_periods"), "n_series", "n_values"))
    return out


def cached(spark: SparkSession, folder: str, name: str, source: str, build: Callable[[], DataFrame], *partition_by: str) -> DataFrame:
    """The dataset `name` that build() makes of the files at source, from folder if it is there and those files are still the same.

    A version is a folder of its own: the data, then a manifest of the source files' paths, sizes and times, which is written last, so a
    version without one doesn't count. If no manifest fits, build() makes a new version; older ones stay for those that read them.
    """
    now = listing(spark, source)
    held = now.collect()
    for version in reversed(children(spark, f"{folder}/{name}")):
        at = f"{folder}/{name}/{version}"
        if exists(spark, f"{at}/manifest/_SUCCESS"):
            then = spark.read.schema(now.schema).parquet(f"{at}/manifest").collect()
            if sorted(map(tuple, then)) == sorted(map(tuple, held)):
                return spark.read.parquet(f"{at}/data")
    at = f"{folder}/{name}/{len(children(spark, f'{folder}/{name}')):06d}-{uuid.uuid4().hex}"
    build().write.partitionBy(*partition_by).parquet(f"{at}/data")
    spark.createDataFrame(held, now.schema).write.parquet(f"{at}/manifest")
    return spark.read.parquet(f"{at}/data")


def load_report(panel: DataFrame) -> DataFrame:
    """Rows and distinct entities of each dataset."""
    return panel.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("e").alias("n_e"))


def newest(spark: SparkSession, folders: Sequence[str], patterns: dict[str, str]) -> DataFrame:
    """dataset, place, path: of each dataset's pattern the newest file in the first of the folders that has any.

    patterns: dataset -> regular expression on the path below the folder. File contents aren't read.
    """
    every = None
    for place, folder in enumerate(folders):
        below = F.substring("path", len(qualified(spark, folder).rstrip("/")) + 2, 1 << 20)
        fits = F.array_compact(F.array(*[F.when(below.rlike(r), F.lit(k)) for k, r in patterns.items()]))
        part = listing(spark, folder).select(F.lit(place).alias("place"), "path", "time", F.explode(fits).alias("dataset"))
        every = part if every is None else every.unionByName(part)
    best = every.groupBy("dataset", "place").agg(F.max_by("path", F.struct("time", "path")).alias("path"))
    return best.groupBy("dataset").agg(F.min(F.struct("place", "path")).alias("x")).select("dataset", "x.place", "x.path")


def read_dimensions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """e, y and a column for each dimension (name -> CSV files of e, t, v): the last non-null score of the year; one pivot merges all."""
    every = None
    for name, path in paths.items():
        part = spark.read.option("header", True).schema("e string, t date, v double").csv(path).where("v is not null").withColumn("dim", F.lit(name))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("e", F.year("t").alias("y")).pivot("dim", list(paths)).agg(F.max_by("v", "t"))


def read_balance(spark: SparkSession, path: str, sector: str, codes: DataFrame) -> DataFrame:
    """The balance-sheet table of one sector: COUNTRY, SECTOR, INDICATOR, the year columns that start with 20, and the code of codes (name, code), null if unknown."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    years = [x for x in wide.columns if x.startswith("20")]
    rows = wide.select("COUNTRY", "SECTOR", "INDICATOR", *[F.col(y).cast("double").alias(y) for y in years]).where(F.col("SECTOR") == sector)
    return rows.join(codes, F.col("COUNTRY") == F.col("name"), "left").drop("name")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def without_periods(features: DataFrame) -> DataFrame:
    """A feature matrix without its `_period` columns."""
    return features.select(*[x for x in features.columns if not x.endswith("_period")])


def sample(panel: DataFrame, *keys: str | Column, rows: int = 1000) -> DataFrame:
    return panel.orderBy(*keys).limit(rows)
