"""Training-data pipeline over documents: each stage's rows are written as Parquet and read back for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, crf_quality, decontaminate, line_dedup, near_copies
from tidemark.llm.columns import spare
from tidemark.session import drop, keep, ship, tidy

#: Least quality score that stays.
QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field finds good."""
    ship(spark)
    model = crf_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = spare(docs.columns, "quality")
    return crf_quality.score(docs, model, name).where(F.col(name) >= QUALITY).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated lines; those of which nothing stays go."""
    n_lines, n_deleted = (spare(docs.columns, c) for c in ("n_lines", "n_deleted"))
    out = line_dedup.dedup_lines(docs, counts=(n_lines, n_deleted))
    return out.where((F.col(n_deleted) == 0) | (F.col(n_deleted) < F.col(n_lines))).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    ship(spark)
    return near_copies.without_near_copies(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship(spark)
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    ship(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("line dedup", lines), ("near copies", near), ("decontamination", benchmarks), ("byte-level BPE", tokens)]
#: No SQL for these stages: tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of a stage that is done its rows stay, until the next one has read them, and none of its own tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with tidy(spark) as stay:
            docs = keep(stage(spark, before, sf_dir), name.replace(" ", "_"))
            stay.append(docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
