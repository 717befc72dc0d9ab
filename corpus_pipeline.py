"""Toxicity filter, near-duplicate removal, benchmark decontamination and tokenisation of ``documents``.

Each stage reads what the stage before it wrote as Parquet and works on all of it; the first three keep
whole rows with the columns of ``documents``, the last adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe, decontaminate, near_dedup, toxicity
from tarn.llm.common import scratch, shared_dir, stage, table  # noqa: F401  # shared_dir: for the tests
from tarn.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids, in place of the text; all other columns stay, ids and n_tokens are those made here."""
    return bpe.with_ids(docs, tokenizer_path(), decoded=None).drop("text")


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Learned scores and edit distances have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        with scratch(docs) as keep:  # what a stage and its operator staged goes, once the next table is there
            docs = keep(stage(step(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
