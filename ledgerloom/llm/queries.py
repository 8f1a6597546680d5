"""The operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    line_dedup, mixing, nearest, pieces, rarity, sharding, simhash, substring_dedup, suffix_dedup, toxicity,
)
from ledgerloom.llm.common import ship

#: The tokenizer's file; a parameter, never copied into the repository.
PIECES = "piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles, and the component of those within two bits."""
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines each document has and loses to chunks that occur earlier, and a digest of what is left."""
    return line_dedup.digest(_documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to strings of 400 bytes that also start elsewhere."""
    return suffix_dedup.digest(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to windows of 50 words that a smaller document has."""
    return substring_dedup.digest(_documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.digest(_documents(spark, sf_dir))


def op4_multiprobe_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth."""
    ship(spark)
    return nearest.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_rarity_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how alike they and the next document's are."""
    return rarity.digest(_documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return pieces.digest(_documents(spark, sf_dir), model_path())


def op8_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 16, equal counts, equal texts together."""
    return sharding.shards(_documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score, learned outside the held-out third."""
    return toxicity.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def model_path(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_line_dedup, op3_mix_sources, op4_multiprobe_nearest, op5_suffix_array_dedup,
        op6_rarity_fingerprints, op7_sentencepiece, op8_label_propagation_shards, op9_toxicity, op10_substring_dedup,
    )
}

#: The others are tested against brute force, round trips or held-out labels.
ORACLE: dict[str, str] = {"op3_mix_sources": mixing.ORACLE}
