"""From raw documents to packed training sequences, a stage at a time.

Every stage but the last returns the columns of ``documents``; each is written as
Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sumlattice.llm import bpe, classifier, jaccard, packing, pii, substrings
from sumlattice.llm.common import Stage, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return classifier.keep_good(spark, docs, classifier.trained(spark, docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are alike by 0.8 or more."""
    return jaccard.one_of_each(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without windows of 20 words that start earlier too."""
    return substrings.without_repeats(spark, docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact_column(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and places."""
    return packing.pack(spark, docs, public_tokenizers.path(bpe.VOCABULARY))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", sequences),
]
#: Stages that learn and encode have no SQL; a test holds run() against a plain version whose quality scores are the classifier's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's tables and its input go once its output is written."""
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        with scratch():
            made = stage.write(f(spark, docs, sf_dir), name.replace(" ", "-"))
        stage.drop(docs)
        docs = made
    return docs
