"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder
and reads it back as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prismgrid.llm import classifier, decontam, secrets, simhash, tokens
from prismgrid.storage import importable, materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among its own input.

    Null and empty texts are judged by the learned bias, repeated rows each; without usable labels all stay.
    """
    importable(spark)
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the least doc_id.

    Null, empty and word-less texts are copies of each other; of repeated rows one stays; a null doc_id stays only where
    its component has no other.
    """
    importable(spark)
    return simhash.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated.

    Null and word-less texts stay; repeated rows are judged each; an empty benchmark clears all.
    """
    importable(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, and ``n_chars`` with them.

    Null texts stay null; overlapping and touching secrets become one mark; repeated rows are changed each.
    """
    importable(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in fixed windows.

    Null and empty texts are an end id alone; repeated rows and null keys are packed each.
    """
    importable(spark)
    return tokens.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Trained embeddings, XXH64 and byte-pair ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
