"""Scan of a commit log: ``--rev--date--author`` headers, each followed by added, deleted and path, tab-separated.

The text source splits at ``\\n--``, so a record is a commit and a large log is
read by many tasks. A header that isn't one leaves its lines to the header before
it, which each task carries along as it reads; nothing is shuffled. What stands at a block's
start before any header of its own belongs to an earlier block's last: these lines alone, and one row
a block, meet by file. Order is kept by file, block, record and line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORDS = "file string, block long, record long, head string, body string"


def trimmed(text: str | Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def numstat(text: str | Column) -> Column:
    """A whole number, at most what 64 bits hold, or 0 for anything else (binary files have ``-``)."""
    bare = trimmed(text)
    beyond = F.when(bare.rlike(r"^\+?[0-9]+$"), F.lit((1 << 63) - 1)).when(bare.rlike("^-[0-9]+$"), F.lit(-(1 << 63)))
    return F.coalesce(bare.try_cast("bigint"), beyond, F.lit(0).cast("bigint"))


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits with ``ord``; commits without file lines have no rows."""
    value = F.col("value")
    cut = F.instr(value, "\n")
    records = spark.read.option("lineSep", "\n--").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("record"),
        F.regexp_replace(F.substring_index(value, "\n", 1), r"\r$", "").alias("head"),
        F.when(cut > 0, F.substring(value, cut + 1, F.length(value))).alias("body"),
    )
    return file_lines(headed(records))


def headed(records: DataFrame) -> DataFrame:
    """``records`` (as RECORDS, in log order) with the header that each one's lines belong to, without those before any."""

    def carry(rest: bool) -> DataFrame:
        """The records with a header from their own block; or, as the ``rest``, those without, and each block's last header with no body."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, last, record = None, None, 0

            def tail() -> tuple:
                return (*place, record, last, None)

            for batch in batches:
                heads, chosen, tails = [], [], []
                files, blocks, numbers, found = (batch.column(c).to_pylist() for c in ("file", "block", "record", "head"))
                for at, head in enumerate(found):
                    if (files[at], blocks[at]) != place:
                        tails += [tail()] if place else []
                        place, last = (files[at], blocks[at]), None
                        if not blocks[at]:  # a file's first record still has its dashes, or is no header
                            head = head[2:] if head.startswith("--") else ""
                    record = numbers[at]
                    if head.count("--") >= 2:
                        last = head
                    heads.append(last)
                    chosen.append(last is None and blocks[at] > 0 if rest else last is not None)
                out = batch.set_column(3, batch.schema.field(3), pa.array(heads, batch.schema.field(3).type)).filter(pa.array(chosen, pa.bool_()))
                yield out
                if rest and tails:
                    yield rows(tails, batch.schema)
            if rest and place:
                yield rows([tail()], batch.schema)

        def rows(some: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

        return records.mapInArrow(run, RECORDS)

    # an earlier block's last header: a block's own row comes after its records and so counts for later ones only
    earlier = Window.partitionBy("file").orderBy("block", "record", F.col("head").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    rest = carry(rest=True).withColumn("head", F.when(F.col("body").isNotNull(), F.last("head", ignorenulls=True).over(earlier)))
    return carry(rest=False).unionByName(rest.filter("head is not null"))


def file_lines(records: DataFrame) -> DataFrame:
    """Commits of records whose ``head`` is a header: a row for each line of ``body`` with three fields."""
    parts = records.withColumn("head", F.split("head", "--", 3)).filter(F.get("head", F.lit(0)) != "")
    rows = parts.select("file", "block", "record", "head", F.posexplode(F.split("body", "\n")).alias("line", "text"))
    rows = rows.withColumn("fields", F.split(F.regexp_replace("text", r"\r$", ""), "\t", 3)).filter(F.size("fields") == 3)
    return rows.select(
        *(F.get("head", F.lit(i)).alias(name) for i, name in enumerate(("rev", "date", "author"))),
        trimmed(F.get("fields", F.lit(2))).alias("entity"),
        numstat(F.get("fields", F.lit(0))).alias("loc_added"),
        numstat(F.get("fields", F.lit(1))).alias("loc_deleted"),
        F.struct("file", "block", "record", "line").alias("ord"),
    )


def log_lines(commits: DataFrame) -> DataFrame:
    """The log text (``value``) of commits, a record per revision: what ``read_git_log`` reads back."""
    line = F.concat_ws("\t", F.col("loc_added").cast("string"), F.col("loc_deleted").cast("string"), "entity")
    records = commits.groupBy("rev", "date", "author").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("body"))
    return records.select(F.concat(F.lit("--"), F.concat_ws("--", "rev", "date", "author"), F.lit("\n"), "body", F.lit("\n")).alias("value"))
