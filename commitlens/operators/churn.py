"""Churn by date, author and entity; ownership; main developers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def churn_by(commits: DataFrame, key: str) -> DataFrame:
    sums = [F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted")]
    return commits.groupBy(key).agg(*sums, F.count_distinct("rev").alias("commits"))


def abs_churn(commits: DataFrame) -> DataFrame:
    return churn_by(commits, "date")


def author_churn(commits: DataFrame) -> DataFrame:
    return churn_by(commits, "author")


def entity_churn(commits: DataFrame) -> DataFrame:
    return churn_by(commits, "entity")


def entity_ownership(commits: DataFrame) -> DataFrame:
    return commits.groupBy("entity", "author").agg(F.sum("loc_added").alias("added"), F.sum("loc_deleted").alias("deleted"))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100 as a double, in that order; 0 where there is nothing to divide."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double") * 100.0)


def top_of(shares: DataFrame, count: str) -> DataFrame:
    """The author with the largest ``count`` of each entity (of equals the first by name)."""
    by_rank = Window.partitionBy("entity").orderBy(F.desc(count), F.asc("author"))
    return shares.withColumn("_rank", F.row_number().over(by_rank)).filter("_rank = 1").drop("_rank")


def _top_by_sum(commits: DataFrame, column: str, name: str) -> DataFrame:
    shares = commits.groupBy("entity", "author").agg(F.sum(column).alias(name))
    every = F.sum(name).over(Window.partitionBy("entity"))
    best = top_of(shares.withColumn(f"total_{name}", every), name)
    return best.select("entity", F.col("author").alias("main_dev"), name, f"total_{name}", percent(F.col(name), F.col(f"total_{name}")).alias("ownership"))


def main_dev(commits: DataFrame) -> DataFrame:
    return _top_by_sum(commits, "loc_added", "added")


def refactoring_main_dev(commits: DataFrame) -> DataFrame:
    return _top_by_sum(commits, "loc_deleted", "removed")
