"""Corpus pipeline: the stages from raw documents to token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from monthmark.llm.common import table, written
from monthmark.llm.decontaminate import without_benchmark
from monthmark.llm.mixing import mixed_documents
from monthmark.llm.near_dedup import without_near_duplicates
from monthmark.llm.queries import bpe_file
from monthmark.llm.token_binary import token_files
from monthmark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is read back from the token files."""
    return token_files(docs, bpe_file(), end_id=2)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mixing), ("token_output", token_output)]

#: Trained scores, signatures and encoded ids are no SQL; the tests hold brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
