"""Rows as a viewer shows them: one projection per section, all text made safe for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions.paths import plain_text
from lucerna.operators.canonical import shown

_DOT = " · "


def _caps(column: Column, default: str, limit: int) -> Column:
    return plain_text(F.upper(F.coalesce(F.nullif(column, F.lit("")), F.lit(default))), limit)


def location(evidence: Column) -> Column:
    """``path:line`` or ``path:first–last``; a fixed text where there is no path."""
    path, start, end = plain_text(evidence["path"], 240), F.coalesce(evidence["line_start"], F.lit(0)), F.coalesce(evidence["line_end"], F.lit(0))
    lines = F.when(start > 0, F.concat(F.lit(":"), start, F.when(end > start, F.concat(F.lit("–"), end)).otherwise(""))).otherwise("")
    return F.when(path == "", "No source location").otherwise(F.concat(path, lines))


def _graded(evidence: Column) -> Column:
    return F.concat(location(evidence), F.lit(_DOT), plain_text(F.col("scope"), 40), F.lit(_DOT + "confidence "), plain_text(F.col("confidence"), 40))


def _source(evidence: Column) -> Column:
    return plain_text(F.coalesce(F.nullif(evidence["operation"], F.lit("")), evidence["excerpt"]), 800)


def findings(rows: DataFrame) -> DataFrame:
    first = F.get("evidence", F.lit(0))
    title = F.concat_ws(_DOT, _caps(F.col("severity"), "informational", 32), _caps(F.col("claim"), "unknown", 32), plain_text(F.col("title"), 240))
    return shown(rows, "findings").select("target_id", "position", title.alias("title"), plain_text(F.col("explanation"), 1200).alias("body"), _graded(first).alias("meta"), _source(first).alias("evidence"))


def resources(rows: DataFrame) -> DataFrame:
    title = F.concat_ws(_DOT, _caps(F.col("kind"), "resource", 40), _caps(F.col("access"), "access", 40), F.when(F.col("sensitive"), "SENSITIVE"))
    return shown(rows, "resources").select("target_id", "position", title.alias("title"), plain_text(F.col("value"), 1200).alias("body"), _graded(F.col("evidence")).alias("meta"), _source(F.col("evidence")).alias("evidence"))


def limitations(rows: DataFrame) -> DataFrame:
    code = plain_text(F.coalesce(F.nullif("code", F.lit("")), F.lit("analysis-limitation")), 160)
    where = F.concat_ws(_DOT, plain_text(F.coalesce(F.nullif("path", F.lit("")), F.lit("Whole scan")), 240), F.when(F.coalesce("scope", F.lit("")) != "", plain_text(F.col("scope"), 40)))
    return shown(rows, "limitations").select("target_id", "position", F.concat(F.lit("UNKNOWN" + _DOT), code).alias("title"), plain_text(F.col("description"), 1200).alias("body"), where.alias("meta"), F.lit("").alias("evidence"))
