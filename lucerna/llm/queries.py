"""The queries of this subpackage, by name; each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.llm import sql
from lucerna.llm.common import table
from lucerna.llm.fingerprints import edited_fingerprints
from lucerna.llm.html_text import html_extraction
from lucerna.llm.language_id import language_id
from lucerna.llm.line_dedup import line_dedup
from lucerna.llm.mixing import mixing
from lucerna.llm.near_dedup import near_dedup
from lucerna.llm.packing import best_fit_packing
from lucerna.llm.quality_rules import quality_rules
from lucerna.llm.substring_dedup import repeated_passages
from lucerna.llm.url_filter import url_filter


def vocabulary() -> str:
    """The tokenizers file of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"), F.array_join("keep_runs", ",").alias("keep_runs"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary())


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("host_rate")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "source", "size", "block", "slot", "release", "deadline", "position")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_html_extraction": op2_html_extraction,
        "op3_line_dedup": op3_line_dedup,
        "op4_language_id": op4_language_id,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_minhash_near_dedup": op6_minhash_near_dedup,
        "op7_quality_rules": op7_quality_rules,
        "op8_mixing": op8_mixing,
        "op9_document_fingerprints": op9_document_fingerprints,
        "op10_url_filters": op10_url_filters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": sql.OP3,
        "op7_quality_rules": sql.OP7,
    }
