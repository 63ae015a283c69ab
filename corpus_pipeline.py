"""Documents from raw to packed: the stages, in order.

Each stage takes what its predecessor kept. All but the last return the columns of
documents; ``run`` writes every stage's rows to the shared folder and reads them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placebook.llm import chunk_dedup, decontaminate, language, order_minhash, packing
from placebook.session import fresh_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the languages learned from the labelled rows."""
    return language.known(docs, language.learn_from(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return order_minhash.one_per_class(docs, order_minhash.classified(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each repeated passage only where it comes first."""
    return chunk_dedup.remove_repeats(docs, chunk_dedup.repeated_spans(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, decontaminate.matches(docs, benchmark))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of token ids."""
    return packing.packed_pieces(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", pack_windows),
]
# SQL can express neither the trained language filters nor chunking and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
