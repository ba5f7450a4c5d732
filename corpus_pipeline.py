"""A corpus pipeline: from raw documents to packed training windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, mixing, near_dup, packing, quality_rules
from textloom.llm.common import written
from textloom.storage import drop_since, mark

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that diverge from their language's references go."""
    return quality_rules.quality_filter(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of exact copies stays."""
    return exact_dedup.dedup_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.near_dup_filter(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their target weights."""
    return mixing.mix_filter(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into windows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("near duplicates", near_copies),
    ("source mix", source_mix),
    ("packing", windows),
]

#: Packing can't be written in SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's tables go once its own is written, and a stage's own once the next one's is."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        drop_since(spark, since, docs)
    out = STAGES[-1][1](spark, docs, sf_dir)
    drop_since(spark, since, out)
    return out
