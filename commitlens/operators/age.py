"""Age of entities in calendar months."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_days(commits: DataFrame) -> DataFrame:
    """entity, its last date (the largest as text) and that as a day, null where it isn't one."""
    last = commits.groupBy("entity").agg(F.max("date").alias("last"))
    return last.withColumn("day", F.try_to_date("last", "yyyy-MM-dd"))


def age(commits: DataFrame, now: date | None = None) -> DataFrame:
    """Months from each entity's last date to ``now``, days aside, at least 0.

    An entity whose last date isn't one is left out, whatever its earlier dates; ``undated`` has these.
    """
    now = now or date.today()
    months = (F.lit(now.year) - F.year("day")) * 12 + (F.lit(now.month) - F.month("day"))
    return last_days(commits).filter("day is not null").select("entity", F.greatest(F.lit(0), months).cast("bigint").alias("age_months"))


def undated(commits: DataFrame) -> DataFrame:
    """entity and last date where that isn't a day."""
    return last_days(commits).filter("day is null").select("entity", "last")
