"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("quern-tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        path = f"{SMALL}/{f}"
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.fixture(scope="session")
def same_rows(duck):
    """Whether a frame has the rows of a DuckDB query, column by name, in any order."""

    def check(df, sql: str) -> None:
        names = sorted(df.columns)
        relation = duck.sql(f"SELECT {', '.join(names)} FROM ({sql})")
        got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
        assert got == sorted((tuple(r) for r in relation.fetchall()), key=repr)

    return check
