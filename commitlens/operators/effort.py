"""Who works on what: revisions per author and entity, and how split they are.

A revision that authors share counts once in an entity's total, so totals are
counted over revisions, not summed over authors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.operators.churn import percent, top_of


def _revs(commits: DataFrame) -> DataFrame:
    """entity, author, author_revs, total_revs. Both counts share the exchange that makes rows distinct; it isn't on the entity alone, as a popular one would be one task's."""
    once = commits.select("entity", "author", "rev").distinct()
    each = once.groupBy("entity", "author").agg(F.count("*").alias("author_revs"))
    total = once.groupBy("entity").agg(F.count_distinct("rev").alias("total_revs"))
    return each.join(total, "entity")


def entity_effort(commits: DataFrame) -> DataFrame:
    return _revs(commits).select("entity", "author", "author_revs", "total_revs")


def main_dev_by_revs(commits: DataFrame) -> DataFrame:
    best = top_of(_revs(commits), "author_revs")
    return best.select("entity", F.col("author").alias("main_dev"), F.col("author_revs").alias("revs"), "total_revs", percent(F.col("author_revs"), F.col("total_revs")).alias("ownership"))


def fragmentation(commits: DataFrame) -> DataFrame:
    """1 - sum((revs / total)^2), to two places, half away from zero, in whole numbers.

    With T the total and S the sum of squares it is (T^2 - S) / T^2, and 100 times
    that rounds to (200 * |T^2 - S| + T^2) div (2 * T^2); it is negative where authors share revisions.
    """
    sums = _revs(commits).groupBy("entity").agg(F.sum(F.col("author_revs") * F.col("author_revs")).alias("s"), F.first("total_revs").alias("total_revs"))
    exact = "signum(total_revs * total_revs - s) * ((200 * abs(total_revs * total_revs - s) + total_revs * total_revs) div (2 * total_revs * total_revs)) / 100.0D"
    return sums.select("entity", F.expr(exact).alias("fractal_value"), "total_revs")
