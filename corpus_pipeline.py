"""A corpus pipeline over documents: each stage applies one training-data operator to all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import decontam, fertility, jaccard, mixing, token_orc
from ledgerspark.llm.common import materialize, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the fertility bands keep; null, empty and wordless texts go, repeated rows
    are judged alike. An empty table stays empty in every stage, and columns may have any further names.

    Arrow batches stay small from here on: what one stage takes of an executor's memory is still held in the next ones."""
    small_batches(spark)
    return fertility.rate(docs, only_kept=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked by 5-word Jaccard similarity of 0.8 or more, the document with the smallest id.

    Rows that repeat id and text are one; a row without id stays only where its whole group has none."""
    return jaccard.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts hold none, repeated rows are judged alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; rows that share id, source and text are one. Null text has no words and
    comes once or not at all, a null source is a source of its own."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as ORC and read back: a row for each copy of each document, those without id first."""
    return token_orc.token_report(docs)


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("tokens", tokenize)]

#: SQL cannot express the stages; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
