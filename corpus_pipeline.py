"""A training corpus from documents: five stages, each the whole of one operator, written between stages.

Language ID drops what it rejects; near-dedup keeps one document of each group of near copies; decontamination drops
documents that hold a benchmark item; mixing repeats and leaves out documents to meet its sources' targets; the last
stage writes token ids as wavelet shards and returns what they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from peakforge.llm.common import written
from peakforge.llm.decontaminate import drop_contaminated
from peakforge.llm.jaccard import drop_near_copies
from peakforge.llm.langid import confident, fit
from peakforge.llm.mixing import mix
from peakforge.llm.tokens import read_shards, write_shards


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told with enough confidence."""
    return confident(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: a trie self-join of SimHashes finds pairs, linked at a five-word Jaccard similarity of 0.8 or more."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights; documents that it takes twice stand twice."""
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the shards."""
    return read_shards(write_shards(docs))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language ID, near-dedup and the tokenizer have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
