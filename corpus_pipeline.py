"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next. All but the
last keep the columns of documents. Every stage works on all rows of the one before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sibyl.llm import mixing, near_copies, packing, paragraphs, quality
from sibyl.llm.common import fold, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine scores at 0.7 or more; it learns from the labels outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels.filter(fold("doc_id", 4) != 2), metadata=("n_chars",))
    return quality.accepted(docs, model, metadata=("n_chars",))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 or more of their five-word shingles."""
    return near_copies.keep_one(docs)


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of paragraphs that an earlier document, or place, already has; documents of which nothing is left go."""
    return paragraphs.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target words."""
    return mixing.mix(docs, (3, 1, 2))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, packing.public_encoder())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_paragraphs),
    ("mixing to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL can't express the learned classifier, the fingerprints' links or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
