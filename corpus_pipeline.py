"""A training-data pipeline: quality rules, near-dedup, mixing and tokenisation.

Each stage is written as Parquet in the folder that the cluster shares and read back
as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackroom.llm import minhash, mixing, quality, queries
from stackroom.shared import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    stats = materialize(quality.rule_statistics(docs), "statistics")
    return quality.keep_good(docs, quality.fit_quality(stats, _labels(spark, sf_dir)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash groups, held against five-word shingles of similarity 0.8; MinHash adds near copies that differ by more bits.

    Of each group of near copies the document with the least id stays.
    """
    return minhash.deduplicate(docs, cfg=minhash.NearCopies(shingle_words=5, similarity=0.8, max_bits=2))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their fitted rates say; toxic ones have the target 0."""
    return mixing.mix_rows(docs, _labels(spark, sf_dir))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the texts decoded from them."""
    return queries.bpe_digests(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("mix_to_targets", mix_to_targets), ("byte_bpe", byte_bpe)]

#: SQL can't express the forest or the fitted rates; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
