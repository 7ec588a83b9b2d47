"""The corpus pipeline: five stages over ``documents``, each on all that the stage before kept.

The driver writes each stage's result as Parquet and reads it again; ``run`` does the same in the shared checkpoint
folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordweave.llm.common import cut
from recordweave.llm.line_quality import clean_documents
from recordweave.llm.mixing import mixed_documents
from recordweave.llm.near_duplicates import without_near_duplicates
from recordweave.llm.pieces import encode
from recordweave.llm.private_data import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limit go from the others."""
    return clean_documents(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id (five-word shingles, similarity 0.8)."""
    return without_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0 to 3 times); null and empty texts have nothing to take and go."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the piece ids of their texts, and whether decoding the ids gives the text back.

    Null text has null ids, an empty one none.  Columns named ids and round_trip are replaced; others stay.
    """
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), round_trip="round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("minhash near-duplicates", near_duplicate_removal),
    ("private data", private_data),
    ("source mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: SQL can't express signatures, the shingle components and the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
