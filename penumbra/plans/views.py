"""The test tables seen as pixels, shadow connections and posts; the SQL of each view stands beside it.

Pixels are line items: bands from discount, tax, quantity and price, the label
from the supplier, elevation from the price and change from discount and
quantity. Connections are orders: the caster is the customer. Posts are
customers and suppliers on a plane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("i"),
        F.col("l_linenumber").cast("bigint").alias("j"),
        F.col("l_suppkey").alias("label"),
        F.floor(F.col("l_quantity") / 5.0).cast("bigint").alias("zone"),
        (F.col("l_discount") + 0.01).alias("blue"),
        (F.col("l_tax") + 0.01).alias("green"),
        (F.col("l_quantity") / 50.0).alias("red"),
        (F.col("l_extendedprice") / 100000.0).alias("nir"),
        ((F.col("l_quantity") / 50.0 + F.col("l_extendedprice") / 100000.0) / 2.0).alias("rededge"),
        (F.col("l_discount") * 0.5 + 0.02).alias("swir"),
        F.col("l_extendedprice").alias("z"),
        (F.col("l_discount") * F.col("l_quantity")).alias("dz"),
    )


PIXELS = """(SELECT l_orderkey AS i, CAST(l_linenumber AS BIGINT) AS j, l_suppkey AS label,
 CAST(floor(l_quantity / 5e0) AS BIGINT) AS zone, l_discount + 1e-2 AS blue, l_tax + 1e-2 AS green,
 l_quantity / 50e0 AS red, l_extendedprice / 100000e0 AS nir,
 (l_quantity / 50e0 + l_extendedprice / 100000e0) / 2e0 AS rededge,
 l_discount * 5e-1 + 2e-2 AS swir, l_extendedprice AS z, l_discount * l_quantity AS dz FROM lineitem)"""


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("caster_id"),
        F.to_date("o_orderdate").alias("timestamp"),
        (F.col("o_totalprice") / 1000.0).alias("x"),
        (F.col("o_orderkey") % 997).cast("double").alias("y"),
        ((F.col("o_orderkey") % 50).cast("double") + 30.0).alias("zenith"),
        (F.col("o_custkey") % 10).alias("glacier_id"),
        (F.col("o_orderkey") % 5).alias("orbit_id"),
    )


CONNECTIONS = """(SELECT o_orderkey AS row_id, o_custkey AS caster_id, CAST(o_orderdate AS DATE) AS timestamp,
 o_totalprice / 1000e0 AS x, CAST(o_orderkey % 997 AS DOUBLE) AS y,
 CAST(o_orderkey % 50 AS DOUBLE) + 30e0 AS zenith, o_custkey % 10 AS glacier_id, o_orderkey % 5 AS orbit_id FROM orders)"""


def posts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Customers or suppliers at places made from their keys and balances."""
    p = name[0]
    key, balance = F.col(f"{p}_{'cust' if p == 'c' else 'supp'}key"), F.col(f"{p}_acctbal")
    return read(spark, sf_dir, name).select(key.alias("id"), (balance / 10.0).alias("x"), ((key * 37) % 1009).cast("double").alias("y"))


def posts_sql(name: str) -> str:
    p, key = name[0], "cust" if name[0] == "c" else "supp"
    return f"(SELECT {p}_{key}key AS id, {p}_acctbal / 10e0 AS x, CAST(({p}_{key}key * 37) % 1009 AS DOUBLE) AS y FROM {name})"
