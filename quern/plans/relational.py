"""Relational queries over the star schema. Money is summed as decimals, so results don't depend on the order of addition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources import read_table

_MONEY = "decimal(15,2)"


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by region of the orders of 1996. Only lineitem and orders are large; their join shuffles on the order key."""
    read = lambda name: read_table(spark, sf_dir, name)
    orders = read("orders").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01'").select("o_orderkey", "o_custkey")
    regions = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    customers = read("customer").select("c_custkey", "c_nationkey").join(regions, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    revenue = F.col("l_extendedprice").cast(_MONEY) * (F.lit(1).cast(_MONEY) - F.col("l_discount").cast(_MONEY))
    lines = read("lineitem").select("l_orderkey", revenue.alias("revenue"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name").agg(F.sum("revenue").cast("decimal(38,4)").alias("revenue"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"revenue_by_region": revenue_by_region}

ORACLES: dict[str, str] = {
    "revenue_by_region": """
    SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))) AS DECIMAL(38,4)) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
    GROUP BY r_name
    """
}
