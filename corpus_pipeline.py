"""Corpus preparation: toxicity, near-duplicates, personal data, mixture, tokens.

``STAGES`` are (name, function) in order; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next one's docs.
Stages before the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe, mixing, pii, simhash, toxicity
from colloquy.llm.common import shared_dir
from colloquy.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of ``docs``."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, similarity 0.8."""
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the text."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by source in the target weights, in the order of their slots. No document is
    dropped: sources that run out before the largest is through are repeated, so their rows
    may occur in several epochs."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.mix(docs).repartitionByRange(parts, "mix_slot", "doc_id").sortWithinPartitions("mix_slot", "doc_id").select(*COLUMNS)


def _as_written(docs: DataFrame) -> DataFrame:
    """Rows of a table of files in the order they were written in: Spark reads files by size."""
    if docs.inputFiles():
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        at = docs.select(*docs.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return at.repartitionByRange(parts, "_file", "_row").sortWithinPartitions("_file", "_row").drop("_file", "_row")
    return docs


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of the mixture: token ids of every text, their number and digest, the digest of the decoded text and
    whether it is that of the source."""
    return bpe.encode_and_check(_as_written(docs), tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("bpe", encode)]

#: No SQL expresses the classifier, the fingerprints or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; the tables between them lie in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
