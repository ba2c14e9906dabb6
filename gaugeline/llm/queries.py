"""Registered queries of the numbered operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm import (
    ann, chat, decontaminate, exact_dedup, html_text, langid, licenses, minhash, mixing, ranked_search, token_alignment,
    token_files, toxicity,
)
from gaugeline.sources.files import materialized

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


@query
def op2_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return langid.identify(table(spark, directory, "documents"))


@query
def op8_minhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, directory, "documents"))


@query
def op9_token_files(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers

    return token_files.encode_documents(table(spark, directory, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, directory, "documents"))


ORACLES["op6_source_mixing"] = mixing.ORACLE


@query
def op10_chat_formatting(spark: SparkSession, directory: str) -> DataFrame:
    turns = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(chat.CHALLENGE).alias("text"),
    )
    turns = turns.unionByName(added)
    return chat.digests(materialized(chat.examples(turns, apart=False), "chat-examples"))


ORACLES["op10_chat_formatting"] = chat.ORACLE


@query
def op3_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return licenses.licenses(table(spark, directory, "documents"))


ORACLES["op3_license_scan"] = licenses.ORACLE


@query
def op4_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.drop("text_hash")


@query
def op5_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    return html_text.extract(table(spark, directory, "pages"))


@query
def op7_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return ann.search(table(spark, directory, "embeddings"))


@query
def op1_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.grade_documents(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query
def op11_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, directory, "documents"))


ORACLES["op11_exact_dedup"] = exact_dedup.ORACLE


@query
def op12_ranked_search(spark: SparkSession, directory: str) -> DataFrame:
    return ranked_search.search(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


ORACLES["op12_ranked_search"] = ranked_search.ORACLE


@query
def op13_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers

    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return token_alignment.alignment(table(spark, directory, "documents"), a, b)
