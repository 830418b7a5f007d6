"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes
as Parquet to the shared folder and rereads as the next one's ``docs``. All but the
last return the columns of ``documents``, and whatever others the table has, as they are (also where
their names are those of an operator's own columns). Null texts count as empty; null ids pass as the
operators state; of repeated rows one stays (near-duplicates), of rows that tie the one with the smaller id;
very long texts pass whole; an empty table, or one without labels of both classes, loses nothing for it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from commitlens.llm import mixing, packing, pii, simhash, toxicity
from commitlens.llm.common import only, release, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score a half and more go; the model learns from the stage's own documents that have labels."""
    model = toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels")))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document stays."""
    return simhash.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kinds' names."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight has it."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: pieces of power-of-two length, with their ids' digest and place."""
    return packing.decompose(docs, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no XXH64 fingerprints, trained weights, or tokenizer: the tests hold the stages against plain models of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, only(partial(stage, spark, docs, sf_dir))
        if number:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
