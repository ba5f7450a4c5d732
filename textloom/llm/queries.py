"""Queries of the operators over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import chat_format, exact_dedup, gam, licenses, lm_scoring, mixing, near_dup, packing, quality_rules, site_tree
from textloom.llm.common import table_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": table_query(licenses.scan_licenses, "documents"),
    "op2_packing": table_query(packing.pack, "documents"),
    "op3_quality_rules": table_query(quality_rules.judge, "documents"),
    "op4_ngram_jaccard_join": table_query(near_dup.near_classes, "documents"),
    "op5_chat_format": table_query(chat_format.format_chats, "conversations"),
    "op6_html_extract": table_query(site_tree.extract, "pages"),
    "op7_source_mix": table_query(mixing.mix, "documents"),
    "op8_quality_gam": lambda spark, sf_dir: gam.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
    "op9_lm_score": table_query(lm_scoring.score, "documents"),
    "op10_exact_dedup": table_query(exact_dedup.dedup, "documents"),
}

SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.rules_sql(),
    "op4_ngram_jaccard_join": near_dup.near_sql(),
    "op5_chat_format": chat_format.CHAT_SQL,
    "op7_source_mix": mixing.mix_sql(),
    "op10_exact_dedup": exact_dedup.DEDUP_SQL,
}
