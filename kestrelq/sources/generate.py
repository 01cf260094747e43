"""Synthetic tables by formula, generated where they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def benchmark_tables(spark: SparkSession, rows: int) -> dict[str, DataFrame]:
    """customer, orders and lineitem; `rows` is the number of lineitem rows."""
    customers, orders = max(rows // 20, 10), max(rows // 4, 20)
    return {
        "customer": spark.range(1, customers + 1).selectExpr("id AS c_custkey", "element_at(array('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'), CAST(id % 4 AS INT) + 1) AS c_region"),
        "orders": spark.range(1, orders + 1).selectExpr("id AS o_orderkey", f"id % {customers} + 1 AS o_custkey", "CAST((id * 7919) % 500000 AS DOUBLE) / 10 AS o_totalprice"),
        "lineitem": spark.range(rows).selectExpr(
            f"id % {orders} + 1 AS l_orderkey",
            "id % 50 + 1 AS l_quantity",
            "CAST((id * 104729) % 100000 AS DOUBLE) / 100 AS l_extendedprice",
            "CAST(id % 10 AS DOUBLE) / 100 AS l_discount",
            "CASE WHEN id % 3 = 0 THEN 'N' ELSE 'R' END AS l_returnflag",
            "id % 7 AS l_shipmode",
        ),
    }


def demo_tables(spark: SparkSession) -> dict[str, DataFrame]:
    customers = [(1, "EUROPE", "BUILDING"), (2, "AMERICA", "AUTOMOBILE"), (3, "EUROPE", "MACHINERY"), (4, "ASIA", "BUILDING")]
    return {
        "customers": spark.createDataFrame(customers, "customer_id bigint, region string, segment string"),
        "orders": spark.range(1, 201).selectExpr("1000 + id AS order_id", "id % 4 + 1 AS customer_id", "20 + (id % 20) * 10 AS total"),
    }
