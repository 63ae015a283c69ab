"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from placebook.llm import (
    chat,
    chunk_dedup,
    conversation_repair,
    decontaminate,
    divergence,
    html_text,
    language,
    multi_index,
    order_minhash,
    packing,
    perplexity,
    token_store,
    url_rules,
)
from placebook.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op2_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    return chat.formatted_digest(chat.with_control_case(table(spark, folder, "conversations")))


@query
def op3_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.stored_digest(table(spark, folder, "documents"))


@query
def op4_simhash_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("version")


@query
def op5_chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.repeated_spans(table(spark, folder, "documents")).drop("version")


@query
def op6_perplexity_bands(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.quality(table(spark, folder, "documents"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_pieces(table(spark, folder, "documents"))


@query
def op8_language_filters(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"))


@query
def op9_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"))


@query
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query
def op11_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return multi_index.near_copies(table(spark, folder, "embeddings"))


@query
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_repair.repaired(table(spark, folder, "conversations"))


ORACLES["op9_url_rules"] = url_rules.judge_sql()
ORACLES["op12_source_divergence"] = divergence.AUDIT_SQL
