"""A corpus from raw documents to token files, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the shared folder and
reads it again as the next stage's documents. All stages but the last return the columns of ``documents``. What a
stage stored on its way, and its input once it is read, is deleted; the token files of the last stage stay.

Cases (empty tables, nulls, repeated rows) are those of the operators that the stages call.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, mixing, simhash, token_files, toxicity
from tideline.llm.shared import new_path, remove, scratch

#: Shares of the tokens after mixing, by the quality that the labelled table teaches.
TARGETS = {"good": 0.9, "poor": 0.1}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity of five-word shingles 0.8 or more) the smallest id stays."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents recur by their fitted rates until the tokens of each domain have their share; none goes."""
    label = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label, TARGETS)


def to_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; returns each document's place in them, read back."""
    return token_files.file_report(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_files", to_token_files),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}", keep=True)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
