"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_quality import line_quality

    return line_quality(documents(spark, sf_dir))


def line_quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 measures inside each document, for SQL; its verdict on lines has none."""
    return op3_line_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .nearest import nearest_neighbours

    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_crf import quality_scores

    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private_data import find_private_data

    return find_private_data(documents(spark, sf_dir))


def private_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 finds by the fixed patterns, for SQL; the spans of its contexts have none."""
    return op6_private_data(spark, sf_dir).drop("spans")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import piece_report

    return piece_report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir))


def op9_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations

    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=4)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress_vectors

    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import rebuilt_trie

    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_report

    return shard_report(documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_token_counts": op2_token_counts,
        "op3_line_quality": op3_line_quality,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_line_crf": op5_line_crf,
        "op6_private_data": op6_private_data,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_remove_repeats": op8_remove_repeats,
        "op9_format_conversations": op9_format_conversations,
        "op10_near_duplicates": op10_near_duplicates,
        "op11_vector_codes": op11_vector_codes,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_rendezvous_shards": op13_rendezvous_shards,
        "line_quality_base": line_quality_base,
        "private_data_base": private_data_base,
    }


def oracle_sql() -> dict[str, str]:
    from . import sql

    return {
        "op1_mix_sources": sql.MIX,
        "op8_remove_repeats": sql.REPEATS,
        "op9_format_conversations": sql.CHAT,
        "op10_near_duplicates": sql.NEAR,
        "op11_vector_codes": sql.CODES,
        "op12_prefix_trie": sql.TRIE,
        "op13_rendezvous_shards": sql.SHARDS,
        "line_quality_base": sql.LINE_BASE,
        "private_data_base": sql.PRIVATE_BASE,
    }
