"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) with all documents its predecessor kept and returns a frame. All but the last
return the columns of ``docs`` unchanged, extra ones too, whatever their names. Nulls, empty and long texts, repeated rows
and empty tables have the results that each operator's docstring defines; of the stages:

* language ID drops null texts, texts without a letter and those in a script unknown to training;
* exact dedup and the n-gram join keep, of each group, the first row by doc_id;
* decontamination drops documents with a passage of the benchmark;
* encoding returns (doc_id, n_tokens, ids, exact) for what is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, exact_dedup, language_id, ngram_join, sentencepiece_codec
from tessera.llm.common import shared_folder, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model accepts."""
    return language_id.keep_accepted(docs, language_id.fit(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents, and whether they decode to the text."""
    return sentencepiece_codec.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding and decoding", encode_stage),
]

#: Trained language models and token ids can't be put in SQL; the tests hold run()'s rows against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them lies in the cluster's shared folder until the next stage is written.

    What is left there is the last stage's table, which the result reads.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}"), True)
    return docs
