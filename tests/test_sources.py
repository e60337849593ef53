from __future__ import annotations

import pytest

from quern.sources import TABLES, read_table, register_tables
from tests.conftest import SMALL


def test_reads_every_table(spark):
    for name in TABLES:
        assert read_table(spark, SMALL, name).columns


def test_unknown_table(spark):
    with pytest.raises(ValueError, match="unknown table"):
        read_table(spark, SMALL, "nothing")


def test_registered_tables_are_known_to_sql(spark):
    register_tables(spark, SMALL, ("region", "nation"))
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25


def test_filters_and_columns_reach_the_scan(spark):
    plan = read_table(spark, SMALL, "orders").where("o_custkey = 5").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,5)" in plan and "o_comment" not in plan and "o_totalprice" not in plan
