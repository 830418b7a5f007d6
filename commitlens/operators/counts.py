"""Counts: authors and revisions of entities, the summary, and the log itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.model import COMMIT_COLUMNS


def authors(commits: DataFrame) -> DataFrame:
    """Distinct authors and revisions of each entity."""
    return commits.groupBy("entity").agg(F.count_distinct("author").alias("n_authors"), F.count_distinct("rev").alias("n_revs"))


def revisions(commits: DataFrame) -> DataFrame:
    return commits.groupBy("entity").agg(F.count_distinct("rev").alias("n_revs"))


def summary(commits: DataFrame) -> DataFrame:
    """Four statistics in a fixed order (``position``); all zero without rows."""
    sizes = commits.agg(
        F.count_distinct("rev").alias("revs"),
        F.count_distinct("entity").alias("entities"),
        F.count("*").alias("changed"),
        F.count_distinct("author").alias("authors"),
    )
    names = {"revs": "number-of-commits", "entities": "number-of-entities", "changed": "number-of-entities-changed", "authors": "number-of-authors"}
    cells = ", ".join(f"{i}, '{name}', {column}" for i, (column, name) in enumerate(names.items()))
    return sizes.selectExpr(f"stack({len(names)}, {cells}) AS (position, statistic, value)")


def identity(commits: DataFrame) -> DataFrame:
    return commits.select(*COMMIT_COLUMNS, "ord")
