"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept. All but the last return the columns of
``documents``. Nulls: a null text is an empty one to every stage, so the rules of stage two reject it; documents with a null id are
judged like others, and in stage three they give way to a linked document with an id. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandmix.llm import ngram_join, packing, pii, quality_fm, quality_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: fitted on labelled documents of the input, it rejects those with a score under 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.keep_good(docs, quality_fm.train(docs, labels))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejects documents that fail a rule by themselves, or keep too little beside lines frequent on their host; of others these lines go."""
    return quality_rules.clean(docs, chars_col="n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents, the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets: every find is replaced by its kind in brackets; n_chars follows the new text."""
    return pii.mask_pii(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", classify), ("quality rules", apply_rules), ("n-gram join", deduplicate), ("personal data", mask), ("packing", pack)]

#: The classifier is fitted on the input, and personal data and tokens are beyond SQL; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
