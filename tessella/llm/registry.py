"""Queries over the test tables, one for each operator, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, licenses, matroska, mixing, pii, quality, simhash, token_frames, toxicity, unigram_counts
from tessella.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_frames.token_frames(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).selectExpr("doc_id", "source", "text", "cast(copy as int) copy", "cast(n_copies as int) n_copies", "shuffle_key")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_frames,
        op2_unigram_token_counts,
        op3_simhash_golay,
        op4_factorization_toxicity,
        op5_minhash_containment,
        op6_quadratic_quality,
        op7_license_digests,
        op8_poisson_mixing,
        op9_matroska,
        op10_boosted_pii,
        pipeline,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_minhash_containment": decontaminate.ORACLE,
    "op7_license_digests": licenses.oracle(),
    "op8_poisson_mixing": mixing.ORACLE,
}
