"""Registered queries of the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import alignment, ann, fingerprints, html, line_rules, mixing, packing, passages, quality, sharding, simhash, suffix_tree, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file() -> str:
    """The public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_ranks() -> tuple[str, str]:
    """The same vocabulary as merge ranks, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, at most 3 differing bits."""
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 by source, at most 3 times over."""
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, among all vectors."""
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the suffix tree, beside those of word counts."""
    return suffix_tree.score_texts(_docs(spark, sf_dir))


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of at most 2048."""
    return packing.pack(_docs(spark, sf_dir), tokenizer_file(), tokenizer_ranks())


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document by labelled lines."""
    return line_rules.quality_rules(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("content_share")


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the marginals of its lines."""
    return quality.score_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that an earlier document has, at similarity 0.8 or more."""
    return passages.near_duplicate_passages(_docs(spark, sf_dir))


def op10_shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    return sharding.shard(_docs(spark, sf_dir)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a byte-level and a piece tokenizer end tokens together, in all documents."""
    import public_tokenizers

    return alignment.align_tokenizers(_docs(spark, sf_dir), tokenizer_file(), public_tokenizers.path("piece_bpe_32k.model"), tokenizer_ranks())


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how near they are."""
    return fingerprints.document_fingerprints(_docs(spark, sf_dir))


def op13_whitened_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on the 16 whitened components of the distinct ones."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_nearest_vectors": op3_nearest_vectors,
    "op4_html_main_text": op4_html_main_text,
    "op5_suffix_tree_score": op5_suffix_tree_score,
    "op6_pack_sequences": op6_pack_sequences,
    "op7_line_rules": op7_line_rules,
    "op8_line_quality": op8_line_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_shard_groups": op10_shard_groups,
    "op11_align_tokenizers": op11_align_tokenizers,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_whitened_vectors": op13_whitened_vectors,
}
ORACLES: dict[str, str] = {}
