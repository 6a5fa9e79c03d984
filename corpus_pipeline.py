"""A training-data pipeline of five stages over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes what a
stage returns as Parquet into the shared folder and reads it again as the next
stage's input. All stages but the last return the columns of ``documents``.

1. toxicity: documents scored 0.5 or more go
2. exact_dedup: of equal texts the one with the largest id stays
3. near_dedup: of each group of near copies the one with the smallest id stays
4. mixing: each document is dropped, kept or repeated, so that sources meet their
   target weights
5. bpe: one row per document left, with its number of tokens and digests

*Defined cases.* A null text counts as empty; rows with a null id take part. A document is
a row: rows that repeat an id with different texts are judged one by one. Empty tables
pass through all stages. Further columns of any name come through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from seqloom.llm.common import checkpoint_dir, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of documents that are still here and drops what scores
    0.5 or more."""
    model = toxicity.train(docs.select("doc_id", "text"), toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.harmless(docs, model)


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_texts(docs, keep="largest")


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shingles of two words and a similarity of 0.8, as operator 3 has them by contract."""
    return near_dedup.distinct_texts(docs, shingle=2)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(docs, bpe.default_vocabulary())


STAGES = [("toxicity", toxic_out), ("exact_dedup", copies_out), ("near_dedup", near_copies_out),
          ("mixing", mixed), ("bpe", encoded)]

#: SQL can't express the classifier and the encoder; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
