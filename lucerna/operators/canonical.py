"""Canonical order, the root digest, and report JSON in and out."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions.jsonx import ReportError, decode, encode
from lucerna.schemas import LIMITS

#: Order of each table within a target: by these columns, bytewise.
ORDER = {
    "inventory": ["path"],
    "operations": ["id"],
    "resources": ["id"],
    "findings": ["id"],
    "unknowns": ["id"],
    "inputs": ["id"],
    "relationships": ["type", "from_kind", "from", "to_kind", "to"],
    "limitations": ["code", "path", "scope", "description"],
    "errors": ["code", "path", "message"],
}
#: Arrays that are sets and sorted on output. Arguments, origins and archive entries keep their order.
SETS = {"findings": ["related"], "unknowns": ["affected", "suppressed"]}


def sort_evidence(column: str) -> Column:
    """By input, path, lines as numbers, operation, excerpt; what is missing sorts as empty or 0."""
    key = lambda e: F.struct(
        F.coalesce(e["input_id"], F.lit("")).alias("a"),
        F.coalesce(e["path"], F.lit("")).alias("b"),
        F.coalesce(e["line_start"], F.lit(0)).alias("c"),
        F.coalesce(e["line_end"], F.lit(0)).alias("d"),
        F.coalesce(e["operation"], F.lit("")).alias("e"),
        F.coalesce(e["excerpt"], F.lit("")).alias("f"),
        e.alias("value"),
    )
    return F.transform(F.array_sort(F.transform(column, key)), lambda x: x["value"])


def canonical(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with its sets sorted and ``position``, the row's place within its target from 1."""
    from pyspark.sql import Window as W

    for column in SETS.get(name, []):
        rows = rows.withColumn(column, F.array_sort(column))
    if name in ("findings", "unknowns"):
        rows = rows.withColumn("evidence", sort_evidence("evidence"))
    if name == "inventory" and "binary" in rows.columns and rows.schema["binary"].dataType.typeName() == "struct":
        for field in ("libraries", "imported_symbols", "extracted_strings", "embedded_urls", "file_capabilities"):
            rows = rows.withColumn("binary", F.when(F.col("binary").isNotNull(), F.col("binary").withField(field, F.array_sort(f"binary.{field}"))))
    order = [F.coalesce(c, F.lit("")) for c in ORDER[name]]
    return rows.withColumn("position", F.row_number().over(W.partitionBy("target_id").orderBy(*order)))


def root_digest(inventory: DataFrame, domain: str = D.DIGEST_DOMAIN) -> DataFrame:
    """(target_id, root_digest): SHA-256 over the length-prefixed inventory records in path order."""
    text = lambda c: F.coalesce(c, F.lit(""))
    record = D.inventory_record(F.col("path"), F.col("kind"), F.col("mode"), F.col("size"), text("sha256"), text("link_target"), text("skip_reason"))
    listed = inventory.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("path", record.alias("record")))).alias("records"))
    return listed.select("target_id", D.inventory_digest(F.col("records"), domain).alias("root_digest"))


def walk_order(path: Column) -> Column:
    """The order in which a walk meets paths: part by part, unlike the bytewise order of whole paths."""
    return F.split(path, "/")


def reports(bundle: dict[str, DataFrame], head: DataFrame) -> DataFrame:
    """(target_id, report, error): one canonical JSON line per target, all or nothing.

    ``head``: (target_id, head_json), the scalar part; ``bundle``: tables by section. A report over the
    size limit, or with text that cannot be encoded, is an error and no report."""
    sections = head.select("target_id", F.lit("").alias("section"), F.lit(0).alias("position"), F.col("head_json").alias("row"))
    for name, rows in bundle.items():
        placed = canonical(rows, name) if name in ORDER else rows.withColumn("position", F.lit(1))
        body = F.to_json(F.struct(*[c for c in placed.columns if c not in ("target_id", "position")]), {"ignoreNullFields": "false"})
        sections = sections.unionByName(placed.select("target_id", F.lit(name).alias("section"), "position", body.alias("row")))
    grouped = sections.groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("section", "position", "row"))).alias("rows"))
    names = sorted(bundle)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, errors = [], []
            for rows in b.column(1).to_pylist():
                doc = {n: [] for n in names}
                for r in rows:
                    value = json.loads(r["row"])
                    if r["section"]:
                        doc[r["section"]].append(value)
                    else:
                        doc |= value
                try:
                    out.append(encode(doc, LIMITS.report_bytes))
                    errors.append(None)
                except ReportError as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(errors, pa.string())], ["target_id", "report", "error"])

    return grouped.mapInArrow(assemble, "target_id string, report string, error string")


def write_reports(encoded: DataFrame, path: str) -> None:
    """All reports or none: Spark's committer publishes the folder only when every task is done."""
    failed = encoded.where("error is not null").limit(1).collect()
    if failed:
        raise ReportError(f"target {failed[0]['target_id']}: {failed[0]['error']}")
    encoded.select("target_id", "report").write.mode("error").parquet(path)


def read_reports(texts: DataFrame, members: dict | None = None) -> DataFrame:
    """(target_id, valid, error, report): strict decoding of (target_id, content binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    rows.append((True, None, encode(decode(bytes(data or b""), members), LIMITS.report_bytes)))
                except ReportError as e:
                    rows.append((False, str(e), None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string())))], ["target_id", "valid", "error", "report"])

    return texts.select("target_id", "content").mapInArrow(read, "target_id string, valid boolean, error string, report string")


def plugin_list(targets: DataFrame) -> DataFrame:
    """One JSON document with all target ids, sorted; refused (no row) where there are too many."""
    listed = targets.select("target_id").distinct().agg(F.array_sort(F.collect_list("target_id")).alias("plugins"))
    return listed.where(F.size("plugins") <= LIMITS.plugins).select(F.to_json(F.struct(F.lit("1.0.0").alias("schemaVersion"), "plugins")).alias("document"))


def shown(rows: DataFrame, name: str) -> DataFrame:
    """The first rows of a section per target, as a viewer lists them."""
    return canonical(rows, name).where(F.col("position") <= LIMITS.rows_shown)
