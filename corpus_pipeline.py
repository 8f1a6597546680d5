"""A corpus pipeline: each stage works on what its predecessor kept.

All stages take nulls in any column, empty and very long texts, rows that repeat, and empty tables; columns that
they don't know stay as they are, whatever their names, up to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, pieces, similar, toxicity
from ledgerloom.llm.common import ensure_checkpoint_dir, ship
from ledgerloom.llm.queries import model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7. Null and empty texts score like a text without hits and stay; rows that repeat share
    their fate."""
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines that an earlier document has. ``n_chars`` follows the text. Null texts stay
    null, with a null ``n_chars``; a null ``doc_id`` counts as the last."""
    return line_dedup.without_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of five-word shingles of 0.8 or more: the smallest ``doc_id``, null
    last. Null texts and texts without words are one group; of rows that repeat one stays."""
    return similar.one_of_each(docs, shingle=5, least=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. A null source is a source; null and empty texts have no words and are
    taken at their source's rate; rows that repeat are taken alike."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to. Null texts have no ids and decode to ''."""
    return pieces.tokenized(docs, model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: SQL expresses neither the similarity nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet in the shared folder and read again.

    A stage's input is deleted once its output is written. The input of the last stage has to stay, since the result reads it.
    """
    ship(spark)
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{base}/{k}-{name}")
            docs = spark.read.parquet(path)
            if old is not None:
                _delete(spark, old)
            old = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
