"""Retail line items derived from the TPC-H-style driver tables.

The driver tables have no nulls, no returns and no bad prices, so the anomalies
a real retail extract carries are injected by arithmetic on the keys:
one line in 97 parts has no description, one order in 13 has no customer,
returned lines (flag ``R``) carry a ``C`` invoice prefix, and one line in a
hundred has price -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail_lines(spark: SparkSession, sf_dir: str, item_col: str = "p_type") -> DataFrame:
    """Raw retail lines (InvoiceNo ... CustomerID) over lineitem, orders, part.

    Only the columns used reach the scans; both joins are equi-joins on the
    TPC-H keys, planned by AQE (broadcast only when the runtime size of a side
    is under the threshold, sort-merge otherwise).
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pt = table(spark, sf_dir, "part").select("p_partkey", F.col(item_col).alias("_item"))
    j = li.join(od, li.l_orderkey == od.o_orderkey).join(pt, li.l_partkey == pt.p_partkey)
    okey = F.col("l_orderkey").cast("string")
    return j.select(
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), okey)).otherwise(okey).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.when(F.col("l_partkey") % 97 == 0, F.lit(None)).otherwise(F.col("_item")).alias("Description"),
        F.col("l_quantity").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 100 == 0, F.lit(-1.0))
         .otherwise(F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))).alias("UnitPrice"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit(None)).otherwise(
            F.col("o_custkey").cast("string")).alias("CustomerID"),
    )


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(CustomerID, segment) from the customer table, ids as retail text."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("CustomerID"),
        F.col("c_mktsegment").alias("segment"))
