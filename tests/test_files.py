"""Wide files with different headers, the newest file of a dataset, datasets that are reloaded."""

from __future__ import annotations

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from riskloom.operators import tables
from riskloom.sources import files


def write(folder, name: str, text: str) -> None:
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_years_that_differ_by_file(spark, tmp_path):
    write(tmp_path, "a.csv", "DATASET,SERIES_KEY,COUNTRY,INDICATOR,UNIT,2000,2001\nX,aaa.one,Aland,First,Euro,1,2\n")
    write(tmp_path, "b.csv", "﻿DATASET,SERIES_KEY,INDICATOR,COUNTRY,2001,2002\nX,bbb.two,Second,Bland,3,4\nX,ccc.two,Second,Cland,NA,\n")
    got = files.read_wide(spark, str(tmp_path), "set", with_file=True)
    year = lambda y: dt.date(y, 12, 31)
    assert rows(got, "e", "i", "entity_name", "indicator_name", "unit", "freq", "t", "v") == [
        ("AAA", "one", "Aland", "First", "Euro", "Annual", year(2000), 1.0), ("AAA", "one", "Aland", "First", "Euro", "Annual", year(2001), 2.0),
        ("BBB", "two", "Bland", "Second", "", "Annual", year(2001), 3.0), ("BBB", "two", "Bland", "Second", "", "Annual", year(2002), 4.0),
    ]
    assert {(r["e"], r["file"].rsplit("/", 1)[-1]) for r in got.collect()} == {("AAA", "a.csv"), ("BBB", "b.csv")}
    report = files.file_report(spark, str(tmp_path)).withColumn("file", F.substring_index("file", "/", -1))
    assert rows(report, "file", "n_columns", "n_periods", "n_series", "n_values") == [("a.csv", 7, 2, 1, 2), ("b.csv", 6, 2, 2, 2)]


def test_metadata_by_rule_and_odd_files(spark, tmp_path):
    write(tmp_path, "x/quarters.csv", 'Code,Key,Reference area,Indicator_name,FREQ,Unit of measure,Unit date,2020-Q1,Q2 2020,M03 2020,2020-04\n1,abcd.k.z,"Land, the",Name,,Percent,1999,1.5,x, 2.5 ,7\n')
    write(tmp_path, "x/same.csv", 'Code,Key,Reference area,Indicator_name,FREQ,Unit of measure,Unit date,2020-Q1,Q2 2020,M03 2020,2020-04\n2,b.k,Other,,M,,,,8,,\n')
    write(tmp_path, "empty.csv", "")
    write(tmp_path, "header_only.csv", "A,B,1990\n")
    write(tmp_path, "no_periods.csv", "A,B,C\n1,2,3\n")
    write(tmp_path, "numbers.csv", "A,B,0312\n1,zzz.q,5\n")
    got = files.read_wide(spark, str(tmp_path), "set")
    assert rows(got.where("e <> 'ZZZ'"), "e", "i", "entity_name", "indicator_name", "unit", "freq", "period_str", "v") == [
        ("ABC", "k", "Land, the", "Name", "Percent", "Monthly", "2020-04", 7.0), ("ABC", "k", "Land, the", "Name", "Percent", "Monthly", "M03 2020", 2.5),
        ("ABC", "k", "Land, the", "Name", "Percent", "Quarterly", "2020-Q1", 1.5), ("B", "k", "Other", "", "", "M", "Q2 2020", 8.0),
    ]
    assert rows(got.where("e = 'ZZZ'"), "period_str", "t", "v") == [("0312", None, 5.0)]
    assert got.columns == [x.split()[0] for x in files.PANEL.split(", ")][:-1]


def test_no_files(spark, tmp_path):
    write(tmp_path, "empty.csv", "")
    assert files.read_wide(spark, str(tmp_path), "set").count() == files.file_report(spark, str(tmp_path)).count() == 0


def test_newest_below_folders_with_odd_names(spark, tmp_path):
    base = tmp_path / "a.b"
    write(base, "a.b/set_1.csv", "old")
    write(base, "set_2.csv", "new")
    write(tmp_path / "axb", "set_3.csv", "elsewhere")
    os.utime(base / "a.b/set_1.csv", (1, 1))
    got = files.newest(spark, [str(base), str(tmp_path / "axb")], {"top": r"^set_.*", "below": r"^a\.b/set_.*", "none": "^x"})
    assert {(r["dataset"], r["place"], r["path"].split(str(tmp_path))[-1]) for r in got.collect()} == {("top", 0, "/a.b/set_2.csv"), ("below", 0, "/a.b/a.b/set_1.csv")}


def test_datasets_are_reloaded_until_their_source_changes(spark, tmp_path):
    source, folder, built = tmp_path / "source", f"file://{tmp_path}/cache", []
    write(source, "a.csv", "n\n1\n2\n")

    def load():
        def build():
            built.append(1)
            return spark.read.csv(str(source), header=True, schema="n int")

        return rows(files.cached(spark, folder, "numbers", str(source), build), "n")

    assert load() == load() == [(1,), (2,)] and len(built) == 1
    write(source, "b.csv", "n\n3\n")
    assert load() == load() == [(1,), (2,), (3,)] and len(built) == 2
    write(source, "b.csv", "n\n4\n")
    os.utime(source / "b.csv", (time.time() + 5, time.time() + 5))
    assert load() == [(1,), (2,), (4,)] and len(built) == 3
    last = tables.children(spark, f"{folder}/numbers")[-1]
    tables.delete(spark, f"{folder}/numbers/{last}/manifest/_SUCCESS")  # as if its writer had died
    assert load() == [(1,), (2,), (4,)] and len(built) == 4


def test_settled_tables_go(spark):
    x = tables.settle(spark.range(3), "three")
    assert x.count() == 3 and tables.exists(spark, x.settled_at)
    tables.forget(x)
    assert not tables.exists(spark, x.settled_at) and tables.children(spark, x.settled_at) == []
    with pytest.raises(Exception):  # noqa: B017
        x.count()
