"""Coverage: the disposition of each file, and what a target's dispositions add up to."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lucerna.functions import paths as P
from lucerna.functions.texts import text_of
from lucerna.schemas import DISPOSITIONS

#: Fixed value: what coverage percentages are of.
DENOMINATOR = "retained supported executable, configuration, archive, and binary artifact files"
REASONS = {
    "not-applicable": "not a retained artifact class with semantic behavior analysis",
    "unread": "content was not retained for analysis",
    "language": "the retained source language has no semantic analyzer",
    "partial": "retained metadata or an explicit limitation leaves behavior unresolved",
}


def relevant(path: Column, shell: Column, language: Column, is_elf: Column) -> Column:
    """Manifest, ELF, QML, shell, or a language that is recognised. Suffixes count without content, too."""
    service = F.lower(P.extension(path)).isin(".desktop", ".service", ".socket", ".timer")
    return (path == "manifest.json") | is_elf | P.is_qml(path) | shell | language.isNotNull() | service


def dispositions(inventory: DataFrame, contents: DataFrame, limitations: DataFrame, errors: DataFrame) -> DataFrame:
    """``inventory`` with ``analysis`` and ``analysis_reason``; the first rung that fits decides. ``contents``
    are files with their content, or with what ``extract.sources`` says of it."""
    flag = lambda rows, name: rows.where("path is not null and path <> ''").select("target_id", "path").distinct().withColumn(name, F.lit(True))
    if "language" not in contents.columns:
        text = text_of(F.col("content"))
        contents = contents.select("target_id", "path", P.is_shell(F.col("path"), text).alias("shell"), P.unsupported_language(F.col("path"), text).alias("language"))
    heads = contents.select("target_id", "path", F.col("shell").alias("_shell"), F.col("language").alias("_language"))
    joined = inventory.join(heads, ["target_id", "path"], "left").join(flag(limitations, "_limited"), ["target_id", "path"], "left").join(flag(errors, "_failed"), ["target_id", "path"], "left")
    path, unread = F.col("path"), F.lit(None).cast("string")
    # a file without content is known by its suffix
    shell = F.coalesce("_shell", P.is_shell(path, unread))
    language = F.coalesce("_language", P.unsupported_language(path, unread))
    elf = F.col("binary").isNotNull() | F.coalesce(F.col("content_type") == "application/x-elf", F.lit(False))
    service = F.lower(P.extension(path)).isin(".desktop", ".service", ".socket", ".timer")
    rung = (
        F.when((F.col("kind") != "regular") | ~relevant(path, shell, language, elf), "not-applicable")
        .when(F.col("_failed") | ~F.col("inspected"), "unread")
        .when(service & ~elf, "language")
        .when(language.isNotNull(), "language")
        .when(elf | F.col("_limited"), "partial")
        .otherwise("analyzed")
    )
    named = joined.withColumn("_rung", rung)
    analysis = F.when(F.col("_rung").isin("unread", "language"), "unanalyzed").otherwise(F.col("_rung"))
    reason = F.coalesce(*[F.when(F.col("_rung") == k, v) for k, v in REASONS.items()], F.lit(""))
    return named.withColumn("analysis", analysis).withColumn("analysis_reason", reason).drop("_shell", "_language", "_limited", "_failed", "_rung")


def _percentage(analyzed: Column, total: Column) -> Column:
    return F.call_function("div", analyzed * 100, total)


def level(analyzed: Column, total: Column) -> Column:
    percentage = _percentage(analyzed, total)
    return F.when(total == 0, "not-applicable").when(analyzed == total, "complete").when(percentage >= 80, "substantial").when(percentage > 0, "partial").otherwise("limited")


def summary(files: DataFrame) -> DataFrame:
    """One row per target: units by disposition, percentage (null without units) and level."""
    counts = files.groupBy("target_id").agg(*[F.count_if(F.col("analysis") == d).cast("int").alias(f"_{d}") for d in DISPOSITIONS])
    analyzed, partial, unanalyzed, excluded = (F.col(f"`_{d}`") for d in ("analyzed", "partial", "unanalyzed", "not-applicable"))
    total = analyzed + partial + unanalyzed
    return counts.select(
        "target_id",
        level(analyzed, total).alias("level"),
        F.lit(DENOMINATOR).alias("denominator"),
        analyzed.alias("analyzed_units"),
        partial.alias("partial_units"),
        unanalyzed.alias("unanalyzed_units"),
        excluded.alias("excluded_units"),
        total.alias("total_units"),
        (total + excluded).alias("retained_units"),
        F.when(total > 0, _percentage(analyzed, total)).cast("int").alias("percentage"),
    )


def byte_totals(inventory: DataFrame) -> DataFrame:
    """Bytes read per target, ELF apart from the rest."""
    elf = F.coalesce(F.col("content_type") == "application/x-elf", F.lit(False))
    read = F.col("inspected")
    return inventory.groupBy("target_id").agg(
        F.count("*").cast("int").alias("file_count"), F.coalesce(F.sum(F.when(read & ~elf, F.col("size"))), F.lit(0)).alias("read_bytes"), F.coalesce(F.sum(F.when(read & elf, F.col("size"))), F.lit(0)).alias("binary_bytes")
    )


def budget_fold(files: DataFrame, budget: int, order: list[Column], group: str = "target_id", size: str = "size") -> DataFrame:
    """``files`` with ``kept``: in order, a file that would overrun the budget is passed over and the
    next ones are still tried. What is kept depends on all files before, so a group is one stream in one
    task; it is sorted by Spark, which spills, and only a running total is held."""
    parts = [F.col(group), *order, F.col(size)]
    ranged = files.repartition(F.col(group)).sortWithinPartitions(*parts)
    names = files.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used = None, 0
        for b in batches:
            kept = []
            for key, bytes_ in zip(b.column(names.index(group)).to_pylist(), b.column(names.index(size)).to_pylist(), strict=True):
                if (key,) != at:
                    at, used = (key,), 0
                fits = bytes_ is not None and used + bytes_ <= budget
                used += bytes_ if fits else 0
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kept, pa.bool_())], [*names, "kept"])

    return ranged.mapInArrow(fold, StructType([*files.schema.fields, StructField("kept", BooleanType())]))


def count_budget(listing: DataFrame, limit: int) -> DataFrame:
    """Directories in walk order: one that holds more entries than are left of ``limit`` gives nothing.

    ``listing``: (target_id, directory, entries). Returns it with ``kept``."""
    return budget_fold(listing.withColumn("size", F.col("entries").cast("long")), limit, [F.split("directory", "/")]).drop("size")
