"""The thin queries over the operators, as the driver's contract has them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commitlens.llm import ann, licenses, media, mixing, packing, pii, secrets, simhash, toxicity, urlfilter
from commitlens.llm.common import table


def op1_pii_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents")).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans")


def op2_secrets_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.decompose(table(spark, sf_dir, "documents"), keep_ids=False)


def op4_media_tar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.described(media.store(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_simhash_covering_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, urlfilter.listed_addresses(pages))


def op7_mix_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_nearest_hilbert_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(toxicity.sample(docs, table(spark, sf_dir, "labels"))))
    held_out = F.coalesce(toxicity.fold_of("doc_id") == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op10_license_rare_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_skip_chain_crf": op1_pii_skip_chain_crf,
    "op2_secrets_entropy": op2_secrets_entropy,
    "op3_pack_power_of_two": op3_pack_power_of_two,
    "op4_media_tar_shards": op4_media_tar_shards,
    "op5_simhash_covering_lsh": op5_simhash_covering_lsh,
    "op6_url_bloom_cascade": op6_url_bloom_cascade,
    "op7_mix_water_filling": op7_mix_water_filling,
    "op8_nearest_hilbert_curves": op8_nearest_hilbert_curves,
    "op9_toxicity_noisy_or": op9_toxicity_noisy_or,
    "op10_license_rare_tokens": op10_license_rare_tokens,
}

ORACLE_SQL: dict[str, str] = {
    "op6_url_bloom_cascade": urlfilter.sql(),
    "op7_mix_water_filling": mixing.sql(),
    "op10_license_rare_tokens": licenses.sql(),
}
