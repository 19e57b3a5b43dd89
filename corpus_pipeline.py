"""Corpus pipeline: the stages of a training-data run over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result
as Parquet to the shared folder and reads it again as the next stage's input. All stages but the last
return the columns of ``documents``; the last returns (doc_id, n_tokens, ids_sha256,
decoded_sha256).

Defined cases are those of the operators: documents without a letter are rejected by the
language stage; documents whose lines are all repeats stay with an empty text; a null
doc_id passes the joins of every stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm.bpe import round_trip
from tabvet.llm.common import cut, documents, small_batches
from tabvet.llm.decontaminate import keep_clean
from tabvet.llm.jaccard import keep_one
from tabvet.llm.language import keep_identified
from tabvet.llm.lines import dedup_lines


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return round_trip(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokenization),
]

#: Language mixtures, sketches and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
