"""A shared session, and DuckDB beside it."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame, SparkSession

TESTDATA = os.environ.get("TESTDATA", "/root/testdata")


def session(partitions: int = 4) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{TESTDATA}/{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    return v


def rows(names: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(df: DataFrame, sql: str, sf: str = "sf0.001") -> int:
    """Asserts equal columns and rows; returns their number."""
    con = duck(sf)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    expected, found = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(expected) == len(found), (len(expected), len(found))
    for a, b in zip(expected, found, strict=True):
        assert a == b, (a, b)
    return len(found)
