"""The given star-schema tables as spatial samples: customers are spots, brand and size class of what they bought genes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same tables in DuckDB SQL, for the queries' oracles.
COUNTS_SQL = """counts AS (
  SELECT CAST(o_custkey % 5 AS VARCHAR) sample_id, CAST(o_custkey AS VARCHAR) spot_id,
         p_brand || '#' || CAST(p_size % 8 AS VARCHAR) gene, CAST(SUM(l_quantity) AS BIGINT) cnt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""
SPOTS_SQL = """spots AS (
  SELECT CAST(c_custkey % 5 AS VARCHAR) sample_id, CAST(c_custkey AS VARCHAR) spot_id,
         CAST((c_custkey // 5) // 20 AS DOUBLE) AS "row",
         CAST(2 * ((c_custkey // 5) % 20) + ((c_custkey // 5) // 20) % 2 AS DOUBLE) AS col,
         c_acctbal / 100.0 AS x, ((c_custkey * 7919) % 1000) / 10.0 AS y,
         c_mktsegment AS label, c_nationkey AS covar FROM customer)"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, spot_id, gene, cnt)``, one row for each value over 0."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    order = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size")
    rows = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    gene = F.concat_ws("#", "p_brand", (F.col("p_size") % 8).cast("string"))
    sums = rows.groupBy("o_custkey", gene.alias("gene")).agg(F.sum("l_quantity").cast("long").alias("cnt"))  # texts only after the shuffle
    return sums.select((F.col("o_custkey") % 5).cast("string").alias("sample_id"), F.col("o_custkey").cast("string").alias("spot_id"), "gene", "cnt")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_id, spot_id, row, col, x, y, label, covar)``: a lattice of 20 columns a sample, and irregular places x, y."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    place = F.floor(F.col("c_custkey") / 5)
    row = F.floor(place / 20)
    return c.select(
        (F.col("c_custkey") % 5).cast("string").alias("sample_id"),
        F.col("c_custkey").cast("string").alias("spot_id"),
        row.cast("double").alias("row"),
        (2 * (place % 20) + row % 2).cast("double").alias("col"),
        (F.col("c_acctbal") / 100.0).cast("double").alias("x"),
        (((F.col("c_custkey") * 7919) % 1000) / 10.0).cast("double").alias("y"),
        F.col("c_mktsegment").alias("label"),
        F.col("c_nationkey").alias("covar"),
    )
