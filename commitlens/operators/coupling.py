"""Temporal coupling: entities that change in the same revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.model import Options


def changesets(commits: DataFrame, most: int) -> DataFrame:
    """rev and its sorted distinct entities, for revisions of at most ``most`` of them.

    Sizes are counted before anything is collected, so a revision of millions
    of entities costs a counter rather than an array in one task.
    """
    pairs = commits.select("rev", "entity").distinct()
    small = pairs.groupBy("rev").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("rev")
    return pairs.join(small, "rev", "left_semi").groupBy("rev").agg(F.sort_array(F.collect_list("entity")).alias("entities"))


def coupling(commits: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Pairs with their degree (shared / average revisions, in percent) within the options' thresholds.

    ``min_revs`` holds against the pair's average; ``min_coupling`` against the
    exact degree, ``max_coupling`` against its floor. Revisions are counted over kept changesets.
    """
    sets = changesets(commits, options.max_changeset_size)
    revs = sets.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("revs"))
    after = lambda a, i: F.transform(F.slice("entities", i + 2, F.size("entities")), lambda b: F.struct(a.alias("a"), b.alias("b")))
    pairs = sets.select(F.explode(F.flatten(F.transform("entities", after))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
    pairs = pairs.filter(F.col("shared") >= options.min_shared_revs)  # before the joins: a rejected pair meets nothing
    of = lambda side: revs.select(F.col("entity").alias(side), F.col("revs").alias(f"{side}_revs"))
    average = (F.col("a_revs") + F.col("b_revs")) / F.lit(2.0)
    counted = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("average", average)
    counted = counted.withColumn("exact", F.col("shared") / F.col("average") * F.lit(100.0))
    kept = counted.filter((F.col("average") >= options.min_revs) & (F.col("exact") >= options.min_coupling) & (F.floor("exact") <= options.max_coupling))
    columns = [F.col("a").alias("entity"), F.col("b").alias("coupled"), F.col("exact").cast("bigint").alias("degree"), F.ceil("average").alias("average_revs")]
    if options.verbose:
        columns += [F.col("a_revs").alias("first_entity_revisions"), F.col("b_revs").alias("second_entity_revisions"), F.col("shared").alias("shared_revisions")]
    return kept.select(*columns)


def sum_of_coupling(commits: DataFrame, options: Options = Options()) -> DataFrame:  # noqa: B008
    """Each entity's others, over its kept changesets; only the changeset limit counts, and zeros stay."""
    pairs = commits.select("rev", "entity").distinct()
    sizes = pairs.groupBy("rev").agg(F.count("*").alias("n")).filter(F.col("n") <= options.max_changeset_size)
    return pairs.join(sizes, "rev").groupBy("entity").agg(F.sum(F.col("n") - 1).alias("soc"))
