"""The corpus pipeline: five stages, each over all that the one before it kept, written and read between stages.

Defined cases are those of each stage's operator; an empty table gives no rows. Columns other than doc_id, text,
lang, source and n_chars end at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import mixing, near_dup, packing, quality, repeats
from inkveil.llm.common import drop_written, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dup.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are cut out of the texts."""
    return repeats.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often, or as far, as the mix takes it."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_dup", near_dup_stage), ("repeats", repeats_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: No SQL: signatures, fitted models and tokenizers aren't expressible; tests/llm/test_pipeline.py holds stages and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are a Parquet table in the shared folder, deleted once the next is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(last)
    return STAGES[-1][1](spark, docs, sf_dir)
