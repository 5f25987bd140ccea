from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def value(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x


def bag(names, rows):
    """Rows as a sorted list, columns by name."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def against_sql():
    """Asserts that a DataFrame has the rows that DuckDB finds for a query on the tables of a folder."""

    def check(df, sql, folder):
        db = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            name = os.path.basename(path).removesuffix(".parquet")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        got = db.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want, have = bag(names, got.fetchall()), bag(df.columns, [tuple(r) for r in df.collect()])
        assert len(have) == len(want)
        assert have == want

    return check
