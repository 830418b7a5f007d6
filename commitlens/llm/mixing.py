"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of all words, at most ``max_epochs``
times what it has; what that cuts off goes to the other sources by weight, until
none is above. Sorted by how soon they fill, the capped sources are a prefix, so
window sums over the sources (one row each) find it at once.

A document is taken in whole repetitions: floor(target / size) times each, and
once more if its seeded uniform number lies under its source's threshold. The
threshold comes from a histogram of the words by those numbers, so no source is
sorted and a hot one is pre-aggregated like all; in the bin where the target
falls the documents take a fractional repetition, so each source meets its target
to within a word per document of that one bin.

The sources' targets are found in one task, with a row of some 50 bytes a source.

Edge cases: a null text has size 0 and takes nothing; a null source is a source of
its own, last; null doc_ids draw one number; rows that repeat, and all with one id, draw the same number
and are taken alike; sources that fill alike are capped in the order of their names; a very long text counts
like others, and moves its source's target by a share of it at most; an empty table gives no rows. Columns other than ``doc_id``,
``text`` and ``source`` are ignored by ``mix`` and kept by ``repeat``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commitlens.llm.common import cut

SEED = "mix-1"
WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
BINS = 4096
#: With at most so many sources their table (about 50 bytes each) is broadcast; beyond, it is joined.
BROADCAST_SOURCES = 5000


def words_in(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bin_of(doc_id: str | Column) -> Column:
    """A seeded uniform number in BINS steps."""
    draw = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(draw, 1, 3), 16, 10).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size and target, from a row per source (source, source_size)."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights)).cast("double")
    named = sizes.select("source", "source_size", weight.alias("weight"), (max_epochs * F.col("source_size")).cast("double").alias("cap"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before, every = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    none = F.lit(0.0)
    level = (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), none)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none))
    # the first source, by fill, whose cap is not under its level sets the level for all after it; levels only sink from there
    leveled = named.withColumn("level", level).withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every))
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, whole (repetitions of each document), bin and part (repetition of the documents in that bin).

    Documents in lower bins have one repetition more than ``whole``.
    """
    rows = docs.select("source", bin_of("doc_id").alias("bin"), words_in("text").alias("size"))
    histogram = cut(rows.groupBy("source", "bin").agg(F.sum("size").alias("words")))  # two uses, one pass over the texts
    running = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = histogram.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    sizes = targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    wanted = placed.withColumnRenamed("source", "_source").join(sizes, F.col("_source").eqNullSafe(F.col("source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole * F.col("source_size")
    part = F.when(F.col("words") > 0, (rest - F.col("before")) / F.col("words")).otherwise(0.0)
    crossing = F.when((F.col("before") <= rest) & (F.col("words") > 0), F.struct("bin", F.least(F.lit(1.0), part).alias("part")))
    found = wanted.groupBy("source", "source_size", "target").agg(F.max(crossing).alias("crossing"), F.max(whole).alias("whole"))
    return found.select("source", "source_size", "target", "whole", F.coalesce("crossing.bin", F.lit(-1)).alias("bin"), F.coalesce("crossing.part", F.lit(0.0)).alias("part"))


def with_plan(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (with ``source``) with their source's plan, in columns that begin with ``plan_``."""
    found = found.select([F.col(c).alias("plan_" + c) for c in found.columns])
    small = found.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(found) if small else found, F.col("source").eqNullSafe(F.col("plan_source")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repetitions counted) of each document."""
    rows = docs.select("doc_id", "source", words_in("text").alias("size"), bin_of("doc_id").alias("bin"))
    part = F.round(F.col("size") * F.col("plan_part")).cast("long")
    more = F.when(F.col("bin") < F.col("plan_bin"), F.col("size")).when(F.col("bin") == F.col("plan_bin"), part).otherwise(0)
    taken = (F.col("plan_whole") * F.col("size") + more).cast("long")
    out = with_plan(rows, plan(docs, weights, max_epochs))
    return out.select("doc_id", "size", F.col("plan_source_size").alias("source_size"), F.col("plan_target").alias("target"), taken.alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; fractional repetitions are rounded to whole texts."""
    rows = docs.select(F.struct("*").alias("row"), "source", bin_of("doc_id").alias("bin"))
    once_more = (F.col("bin") < F.col("plan_bin")) | ((F.col("bin") == F.col("plan_bin")) & (F.col("plan_part") >= 0.5))
    times = F.col("plan_whole").cast("int") + once_more.cast("int")
    out = with_plan(rows, plan(docs, weights, max_epochs)).withColumn("times", times).filter("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select("row.*")


def sql() -> str:
    """The query over ``documents`` in DuckDB's SQL."""
    weights = ", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)
    return f"""
    WITH sized AS (
      SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
             CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS bin
      FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
    named AS (
      SELECT source, source_size, [{weights}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS weight,
             CAST({MAX_EPOCHS} * source_size AS DOUBLE) AS cap FROM sizes),
    leveled AS (
      SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER fills, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER fills, 0.0)) AS level
      FROM named WINDOW fills AS (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    targets AS (
      SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM leveled WHERE cap >= level * weight) * weight, cap)) AS target FROM leveled),
    histogram AS (SELECT source, bin, sum(size) AS words FROM sized GROUP BY source, bin),
    placed AS (
      SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM histogram),
    wanted AS (
      SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole
      FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source),
    crossing AS (
      SELECT source, max(whole) AS whole, any_value(source_size) AS source_size, any_value(target) AS target,
             coalesce(max(bin) FILTER (words > 0 AND before <= target - whole * source_size), -1) AS bin,
             coalesce(max_by(least(1.0, (target - whole * source_size - before) / words), bin) FILTER (words > 0 AND before <= target - whole * source_size), 0.0) AS part
      FROM wanted GROUP BY source)
    SELECT s.doc_id, s.size, c.source_size, c.target,
           CAST(c.whole * s.size + CASE WHEN s.bin < c.bin THEN s.size WHEN s.bin = c.bin THEN round(s.size * c.part) ELSE 0 END AS BIGINT) AS taken
    FROM sized s JOIN crossing c ON s.source IS NOT DISTINCT FROM c.source"""
