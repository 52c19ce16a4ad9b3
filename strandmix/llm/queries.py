"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmix.llm import licenses, negatives, ngram_join, pii, quality_rules, suffixes, tiff, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.ngram_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.url_rules import filter_urls

    return filter_urls(spark, _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.pii import find_pii

    return find_pii(_table(spark, sf_dir, "documents"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op3's base kinds alone, which SQL can express."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmix.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmix.llm.packing import pack_conversations

    return pack_conversations(_table(spark, sf_dir, "conversations"), public_tokenizers.path("word_bpe_49k.json"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.tiff import media_digests

    return media_digests(_table(spark, sf_dir, "documents"))


def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's file, page by page: what op5 stores, through the reader of pages."""
    from strandmix.llm.tiff import read_pages, store_texts

    pages = read_pages(store_texts(_table(spark, sf_dir, "documents")), "doc_id", "media")
    return pages.select("doc_id", "page", "width", "length", "channels", "feature", F.xxhash64("samples").alias("samples_hash"), "error")


def tiff_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 says of a text's bytes before and after padding, which SQL can express."""
    return op5_tiff(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmix.llm.bpe import encode_decode

    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.quality_rules import judge

    return judge(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 says of the base phrases alone, which SQL can express."""
    return op7_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandmix.llm.langid import identify, train

    docs, path = _table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return identify(docs, train(docs, path), path)


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.quality_fm import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op11_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandmix.llm.suffixes import cut_repeats

    return cut_repeats(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th row's label is moved by one first; anchors are the rows whose id is divisible by 100."""
    from strandmix.llm.negatives import mine, scaled

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), scaled(F.col("embedding"), 256).alias("vector"))
    return mine(rows, F.col("id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_url_rules": op2_url_rules,
    "op3_pii": op3_pii,
    "op4_packing": op4_packing,
    "op5_tiff": op5_tiff,
    "op6_quality_rules": op6_quality_rules,
    "op7_licenses": op7_licenses,
    "op8_langid": op8_langid,
    "op9_bpe": op9_bpe,
    "op10_quality_fm": op10_quality_fm,
    "op11_suffixes": op11_suffixes,
    "op12_hard_negatives": op12_hard_negatives,
    "packing_conversations": packing_conversations,
    "pii_counts": pii_counts,
    "tiff_pages": tiff_pages,
    "tiff_sizes": tiff_sizes,
    "license_phrases": license_phrases,
}

#: DuckDB SQL for the rows of a query, where SQL can express it.
ORACLE: dict[str, str] = {"op1_ngram_join": ngram_join.ORACLE, "op2_url_rules": url_rules.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "license_phrases": licenses.ORACLE, "pii_counts": pii.ORACLE, "tiff_sizes": tiff.ORACLE, "op11_suffixes": suffixes.ORACLE, "op12_hard_negatives": negatives.ORACLE}
