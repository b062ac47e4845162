"""The corpus pipeline: documents through quality, near-dedup, decontamination, mixing and tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and gives a DataFrame, which
is written as Parquet and read again as the next stage's docs.  All but the last return the columns
of docs.  SQL expresses none of discriminant, minima and tokenizer, so ORACLE_SQL is None and the
tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import classifier, common, decontaminate, mixing, neardup, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that the discriminant predicts to be of low quality."""
    return classifier.accept(docs, common.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that hold an item of the benchmark."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts each source to its target weight."""
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and gives a row for each document read back from them."""
    return tokens.encode_and_load(docs)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("token output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
