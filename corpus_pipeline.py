"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
reread as the next stage's docs. All but the last return the columns of ``documents``.

Defined results, for every stage: a null text is empty, and no stage fails on it (the quality rules reject it, as it has too few
words); a null or shared doc_id is kept, since rows are followed by numbers of their own and not by doc_id; repeated rows are alike,
so near-dedup leaves one of them and mixing may write a row several times; an empty table gives an empty table with the same
columns; further columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import bpe, lines, minhash, mixing, quality
from llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; of lines that are alike, the first occurrence is left."""
    return lines.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs, size=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, repeated as its rate asks, so that expected domain tokens match the targets."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), budget="repeat")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of ids and decoded text."""
    return bpe.encode(docs).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The fitted mixing rates and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
