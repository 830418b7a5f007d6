"""The driver's tables seen as a commit log: orders are revisions, parts are files, nations are authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def commits_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    lines, orders, parts = read("lineitem"), read("orders"), read("part")
    buyers = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    brand = F.replace(F.lower("p_brand"), F.lit("#"), F.lit(""))
    return joined.select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("rev"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.col("n_name").alias("author"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), brand, F.lit("/part"), F.col("p_partkey").cast("string"), F.lit(".go")).alias("entity"),
        F.col("l_quantity").cast("bigint").alias("loc_added"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("loc_deleted"),
        F.struct("l_orderkey", "l_linenumber").alias("ord"),
    )


#: The same in DuckDB's SQL.
COMMITS_SQL = """commits AS (
  SELECT 'r' || o_orderkey AS rev, strftime(o_orderdate, '%Y-%m-%d') AS date, n_name AS author,
         'src/' || lower(p_type) || '/' || replace(lower(p_brand), '#', '') || '/part' || p_partkey || '.go' AS entity,
         CAST(l_quantity AS BIGINT) AS loc_added, CAST(round(l_discount * 100) AS BIGINT) AS loc_deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)"""
