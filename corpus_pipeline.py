"""The corpus pipeline: quality, exact duplicates, near-duplicates, benchmark passages, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. Results of stages are written to the shared folder and read again, so a lost executor repeats one stage.

Defined cases, as its operators define them: a null text counts as empty (an empty text is judged by its score like any other, and
of equal ones the first stays); very long texts are read whole; a null doc_id keeps its row until quality, equal text or a
benchmark item removes it (it takes no part in near-duplicates); rows that repeat doc_id and text become one in the exact
stage; ties go to the smallest doc_id; extra columns, whatever their names, stay until the mix; empty tables of documents,
labels or benchmark give empty results, keep all, and contaminate nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidefeed.llm import common, decontaminate, exact_dedup, mixing, quality, similar


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is at least a half."""
    return quality.select(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of at least 0.8 (SimHash search, exact verification)."""
    return similar.distinct_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words that the mix takes of each document."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: Fitted models, hashing and seeded rounding aren't expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; what a stage writes on its way goes as soon as its result is written."""
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with common.scope() as keep:
            docs = keep(common.written(stage(spark, docs, sf_dir), f"stage{i}"))
    return STAGES[-1][1](spark, docs, sf_dir)
