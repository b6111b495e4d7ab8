"""The corpus pipeline: each stage works on all that the one before it kept.

quality keeps the documents whose score reaches the classifier's threshold; near_duplicates keeps the smallest doc_id of
each SimHash component; decontaminate drops documents that hold a passage of a benchmark item; secrets replaces found
secrets in the texts by their kinds (and brings n_chars into line); tokenize encodes what is left and decodes it again.
All but the last return the columns of documents. A row with a null doc_id passes the near-duplicate and benchmark stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, quality, secrets, simhash
from tessera.llm.common import materialize, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps; nulls, ties, repeated rows and empty tables as ``quality.good`` has them."""
    return quality.good(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; nulls, ties, repeated rows and empty tables as ``simhash.one_of_each`` has them."""
    return simhash.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item; nulls, repeated rows and empty tables as ``decontaminate.clean`` has them."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, n_chars the new length (null for a null text), as ``secrets.redact`` has it."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row of counts and digests for each document; nulls, repeated rows and empty tables as ``bpe.digests`` has them."""
    return bpe.digests(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secret_stage),
    ("tokenize", tokenize_stage),
]
#: The classifier, the alignment and the merges have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
