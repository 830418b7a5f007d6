"""Communication needs: authors who work on the same entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def communication(commits: DataFrame) -> DataFrame:
    """Ordered pairs of authors with the entities they share, against the (rounded up) average of what each works on.

    Each pair is met once, by name, counted before anything is shuffled by pair, and mirrored at the
    end. An entity with k authors gives k^2 / 2 meetings, which is what is counted; Spark splits such an entity's join.
    """
    works = commits.select("entity", "author").distinct()
    totals = works.groupBy("author").agg(F.count("*").alias("n"))
    peers = works.select("entity", F.col("author").alias("peer"))
    met = works.join(peers, "entity").filter("author < peer").groupBy("author", "peer").agg(F.count("*").alias("shared"))
    both = F.array(F.struct("author", "peer"), F.struct(F.col("peer").alias("author"), F.col("author").alias("peer")))
    counted = met.join(totals, "author").join(totals.select(F.col("author").alias("peer"), F.col("n").alias("peer_n")), "peer")
    counted = counted.withColumn("average", F.ceil((F.col("n") + F.col("peer_n")) / F.lit(2.0)))
    strength = (F.col("shared").cast("double") / F.col("average").cast("double") * F.lit(100.0)).cast("bigint")
    return counted.select(F.explode(both).alias("pair"), "shared", "average", strength.alias("strength")).select("pair.author", "pair.peer", "shared", "average", "strength")
