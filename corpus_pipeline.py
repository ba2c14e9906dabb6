"""Corpus preparation: STAGES over documents, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before it
has kept; all but the last return the columns of documents.  As a stage's result is written
before the next one starts, each stage deletes what the one before it wrote on its way.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm.decontaminate import without_leaks
from gaugeline.llm.langid import keep_identified
from gaugeline.llm.minhash import keep_one_of_each
from gaugeline.llm.mixing import mixed_documents
from gaugeline.llm.token_files import encode_documents
from gaugeline.sources.files import drop_paths, materialized, take_work, work_mark

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


#: Rows of a batch that goes to Python: texts are long, and a batch is held on both sides.
BATCH_ROWS = 1000
_left: list[str] = []


def stage(f):
    """Folders that ``f`` writes are kept until the next stage, or the same one again, starts."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_paths(spark, _left)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        mark = work_mark()
        try:
            return f(spark, docs, sf_dir)
        finally:
            _left.extend(take_work(mark))

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: shingles of five words, similarity 0.8."""
    return keep_one_of_each(docs, width=5, percent=80)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of the mix, as (doc_id, start, n_tokens, ids_crc32) read from them."""
    return encode_documents(docs, TOKENIZER)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]
#: Naive Bayes, components of near copies and a tokenizer are beyond SQL; tests/llm compare
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
