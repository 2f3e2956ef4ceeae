"""Conformance checks: each is a query that returns violations (target_id, check_id, detail).

A bundle of tables is valid where the union is empty. ``ORDINALS`` keeps a fixed order of checks, so
that "the first violation" is a minimum and not a matter of execution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions import paths as P
from lucerna.functions.jsonx import encoded_size
from lucerna.operators import coverage, graph, rollup
from lucerna.operators.canonical import root_digest
from lucerna.schemas import (
    ANALYZER,
    ANALYZER_VERSION,
    ARCHIVE_FORMATS,
    BASE_EDGES,
    CLAIMS,
    COMPARISON_EDGES,
    CONFIDENCES,
    DISPOSITIONS,
    EVIDENCE_SOURCES,
    LIMITS,
    ORIGIN_KINDS,
    SCHEMA_VERSION,
    SCOPES,
    SEVERITIES,
    STATUSES,
    TARGET_INPUT,
    UNKNOWN_REASONS,
)

Bundle = dict[str, DataFrame]
#: How external observations and conclusions about them are labelled.
EXTERNAL_FORMAT, EXTERNAL_VERSION = "audit-json", "1"
TARGET_FORMAT, TARGET_VERSION = "inventory-root-sha256", "1"
COVERAGE_RULE, COVERAGE_CATEGORY = "coverage-comparison/v1", "coverage-difference"
BINDING_RULE, BINDING_CATEGORY, BUDGET_RULE = "external-binding-assessment/v1", "external-evidence-binding", "comparison-budget/v1"
EXTERNAL_ANALYZER, EXTERNAL_RULE = "external-audit", "external-observation/v1"
_HEX = "\\A[0-9a-f]{64}\\z"
_CHECKS: dict[str, Callable[[Bundle], DataFrame]] = {}


def check(name: str):
    def add(f):
        _CHECKS[name] = f
        return f

    return add


def bad(rows: DataFrame, wrong: Column, detail: Column | str = "id") -> DataFrame:
    """Rows where ``wrong`` holds or can't be told."""
    detail = F.col(detail) if isinstance(detail, str) else detail
    return rows.where(F.coalesce(wrong, F.lit(True))).select("target_id", detail.cast("string").alias("detail"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("target_id", *keys).count().where("count > 1").select("target_id", F.concat_ws(" ", *[F.col(k) for k in keys]).alias("detail"))


def missing(rows: DataFrame, key: str, into: DataFrame, other: str) -> DataFrame:
    """Foreign keys without a row to point to."""
    held = into.select("target_id", F.col(other).alias(key)).distinct()
    return rows.where(F.col(key).isNotNull()).join(held, ["target_id", key], "left_anti").select("target_id", F.col(key).alias("detail"))


def _every(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


@check("V1")
def bounds(b: Bundle) -> DataFrame:
    most = {"inventory": LIMITS.files, "errors": LIMITS.errors, "relationships": LIMITS.edges_accepted}
    parts = [bad(b["scan"], F.col("schema_version") != SCHEMA_VERSION, "schema_version")]
    for name in ("inventory", "operations", "resources", "findings", "unknowns", "relationships", "limitations", "errors"):
        over = b[name].groupBy("target_id").count().where(F.col("count") > most.get(name, LIMITS.records))
        parts.append(over.select("target_id", F.lit(name).alias("detail")))
    return _every(parts)


@check("V2")
def strings(b: Bundle) -> DataFrame:
    """Every string of every table, keys of maps included: bounded in its encoded form."""

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(value) -> bool:
            if isinstance(value, str):
                return encoded_size(value) > LIMITS.string_bytes or any(0xD800 <= ord(c) <= 0xDFFF for c in value)
            if isinstance(value, dict):
                return any(walk(k) or walk(v) for k, v in value.items())
            return isinstance(value, (list, tuple)) and any(map(walk, value))

        for batch in batches:
            targets, *columns = (c.to_pylist() for c in batch.columns)
            at = [i for i in range(len(targets)) if any(walk(c[i]) for c in columns)]
            yield pa.RecordBatch.from_arrays([pa.array([targets[i] for i in at], pa.string()), pa.array(["string"] * len(at), pa.string())], ["target_id", "detail"])

    return _every([b[n].select("target_id", *[c for c in b[n].columns if c != "target_id"]).mapInArrow(long, "target_id string, detail string") for n in ("inventory", "operations", "resources", "findings", "unknowns", "limitations", "errors")])


@check("V3")
def scan(b: Bundle) -> DataFrame:
    s = b["scan"]
    limits = F.col("resource_limits")
    ranges = (limits["memory_max_bytes"] > 0) & (limits["memory_swap_bytes"] >= 0) & (limits["tasks_max"] > 0) & limits["cpu_quota_percent"].between(1, 100) & (limits["wall_time_seconds"] > 0)
    return _every(
        [
            bad(s, ~F.col("status").isin(*STATUSES), "status"),
            bad(s, blank("scanner_version") | blank("policy_version"), F.lit("versions")),
            bad(s, F.col("started_at").isNull() | F.col("completed_at").isNull() | (F.col("completed_at") < F.col("started_at")), F.lit("timestamps")),
            bad(s, F.col("sandboxed") != limits.isNotNull(), F.lit("sandbox")),
            bad(s, limits.isNotNull() & ~F.coalesce(ranges, F.lit(False)), F.lit("limits")),
        ]
    )


@check("V4")
def target(b: Bundle) -> DataFrame:
    t = b["target"].join(b["inventory"].groupBy("target_id").agg(F.count("*").alias("_n")), "target_id", "left")
    return _every([bad(t, blank("display_name") | (F.col("file_count") < 0) | (F.col("read_bytes") < 0) | (F.col("binary_bytes") < 0), F.lit("metadata")), bad(t, ~F.col("root_digest").rlike(_HEX), "root_digest"), bad(t, F.col("file_count") != F.coalesce("_n", F.lit(0)), "file_count")])


@check("V5")
def inputs(b: Bundle) -> DataFrame:
    i = b["inputs"].join(b["target"].select("target_id", F.col("root_digest").alias("_root")), "target_id", "left")
    own, outside = F.col("type") == "target-inventory", F.col("type") == "external-audit"
    subject, document = F.coalesce("subject_root_digest", F.lit("")), F.coalesce("document_sha256", F.lit(""))
    counts = b["target"].select("target_id").join(i.groupBy("target_id").agg(F.count_if(own).alias("own"), F.count("*").alias("n")), "target_id", "left")
    return _every(
        [
            bad(i, blank("id") | blank("label") | blank("format") | blank("version")),
            bad(i, ~own & ~outside, "type"),
            bad(i, own & ((F.col("id") != TARGET_INPUT) | (F.col("format") != TARGET_FORMAT) | (F.col("version") != TARGET_VERSION) | (document != "") | (subject != F.col("_root")))),
            # the one external format that is known is bound to its document and to no snapshot
            bad(i, outside & ((F.col("id") == TARGET_INPUT) | (F.col("format") != EXTERNAL_FORMAT) | (F.col("version") != EXTERNAL_VERSION) | (document == "") | (subject != ""))),
            bad(i, ((document != "") & ~document.rlike(_HEX)) | ((subject != "") & ~subject.rlike(_HEX))),
            repeated(i, "id"),
            bad(counts, (F.coalesce("own", F.lit(0)) != 1) | (F.col("n") > LIMITS.inputs), F.lit("inputs")),
        ]
    )


@check("V6")
def manifest(b: Bundle) -> DataFrame:
    m = b["target"].where("manifest is not null")
    kinds, entries = F.col("manifest.kinds"), F.col("manifest.entry_points")
    return bad(m, kinds.isNull() | entries.isNull() | (F.size(kinds) > LIMITS.manifest_items) | (F.size(entries) > LIMITS.manifest_items), F.lit("manifest"))


def _inventory(b: Bundle) -> tuple[DataFrame, Column, Column]:
    binary = F.col("binary").isNotNull()
    return b["inventory"], binary, binary | F.coalesce(F.col("content_type") == "application/x-elf", F.lit(False))


@check("V7")
def inventory(b: Bundle) -> DataFrame:
    i, binary, _ = _inventory(b)
    hashed = ~blank("sha256")
    wrong = (
        blank("path") | blank("kind") | blank("mode") | (F.col("size") < 0) | ~P.canonical_relative(F.col("path")) | (hashed & ~F.col("sha256").rlike(_HEX)) | (F.col("inspected") != hashed)
        | (F.col("inspected") & ((F.col("kind") != "regular") | blank("content_type"))) | (F.col("inspected") & ~blank("skip_reason")) | (~blank("link_target") & (F.col("kind") != "symlink")) | (binary & (~F.col("inspected") | (F.col("content_type") != "application/x-elf")))
    )
    return _every([bad(i, wrong, "path"), repeated(i, "path")])


@check("V8")
def disposition(b: Bundle) -> DataFrame:
    i, _, _ = _inventory(b)
    why = ~blank("analysis_reason")
    right = F.when(F.col("analysis") == "analyzed", F.col("inspected") & ~why).when(F.col("analysis") == "partial", F.col("inspected") & why).otherwise(why)
    return bad(i, ~F.col("analysis").isin(*DISPOSITIONS) | ~right, "path")


@check("V9")
def metadata(b: Bundle) -> DataFrame:
    i, binary, elf = _inventory(b)
    m, open_ = F.col("binary"), F.col("analysis").isin("partial", "unanalyzed")
    most = {"libraries": LIMITS.libraries, "imported_symbols": LIMITS.symbols, "extracted_strings": LIMITS.strings, "embedded_urls": LIMITS.urls, "file_capabilities": LIMITS.capabilities}
    whole = (m["format"] == "ELF") & (m["class"] != "") & (m["byte_order"] != "") & (m["machine"] != "") & (m["type"] != "")
    for field, limit in most.items():
        whole &= m[field].isNotNull() & (F.size(m[field]) <= limit)
    parts = [bad(i, elf & ~open_, "path"), bad(i, binary & ~F.coalesce(whole, F.lit(False)), "path")]
    if i.schema["archive"].dataType.typeName() == "struct":
        a = F.col("archive")
        entries = F.coalesce(a["entries"], F.array())
        total = F.aggregate(entries, F.lit(0).cast("long"), lambda n, e: n + e["size"])
        fine = a["format"].isin(*ARCHIVE_FORMATS) & a["entries"].isNotNull() & (F.size(entries) <= LIMITS.archive_entries) & (a["retained_uncompressed_bytes"] == total)
        fine &= ~F.exists(entries, lambda e: (e["path"] == "") | (e["kind"] == "") | (e["size"] < 0) | (e["compressed_size"] < 0))
        parts.append(bad(i.where("archive is not null"), ~(fine & open_ & F.col("inspected") & (F.col("kind") == "regular") & ~binary), "path"))
    return _every(parts)


@check("V10")
def excluded(b: Bundle) -> DataFrame:
    i, _, _ = _inventory(b)
    return bad(i, (F.col("kind") == "regular") & (F.col("analysis") == "not-applicable") & P.obviously_analyzable(F.col("path")), "path")


@check("V11")
def totals(b: Bundle) -> DataFrame:
    t = b["target"].select("target_id", "root_digest", "read_bytes", "binary_bytes")
    sums = coverage.byte_totals(b["inventory"]).select("target_id", F.col("read_bytes").alias("_r"), F.col("binary_bytes").alias("_b"))
    joined = t.join(sums, "target_id", "left").join(root_digest(b["inventory"]).withColumnRenamed("root_digest", "_d"), "target_id", "left")
    zero = F.lit(0)
    return _every([bad(joined, (F.col("read_bytes") != F.coalesce("_r", zero)) | (F.col("binary_bytes") != F.coalesce("_b", zero)), F.lit("bytes")), bad(joined.where("_d is not null"), F.col("root_digest") != F.col("_d"), "root_digest")])


def _node(rows: DataFrame, kind: str, wrong: Column) -> list[DataFrame]:
    scope = ~F.col("scope").isin(*SCOPES) | ~F.col("confidence").isin(*CONFIDENCES)
    return [bad(rows, blank("id") | (F.col("reference") != D.node_reference(kind, F.col("id"))) | wrong), bad(rows, scope), repeated(rows, "id")]


@check("V12")
def operations(b: Bundle) -> DataFrame:
    return _every(_node(b["operations"], "operation", blank("category") | blank("command") | (F.size("arguments") > LIMITS.arguments)))


@check("V13")
def resources(b: Bundle) -> DataFrame:
    r = b["resources"]
    return _every([*_node(r, "resource", blank("kind") | blank("access") | blank("value") | blank("operation_id")), missing(r, "operation_id", b["operations"], "id")])


@check("V14")
def findings(b: Bundle) -> DataFrame:
    f = b["findings"]
    related = F.coalesce("related", F.array().cast("array<string>"))
    reserved = (F.col("provenance.rule_id") == COVERAGE_RULE) | (F.col("category") == COVERAGE_CATEGORY)
    shape = (F.col("provenance.rule_id") == COVERAGE_RULE) & (F.col("category") == COVERAGE_CATEGORY) & (F.col("provenance.analyzer") == ANALYZER) & (F.col("claim") == "fact") & (F.col("severity") == "informational") & (F.col("confidence") == "high") & (F.col("scope") == "unknown") & (F.size("evidence") == 1) & (F.size(related) == 0)
    wrong = (
        blank("category") | blank("title") | blank("explanation") | ~F.size("evidence").between(1, LIMITS.finding_evidence) | (F.size(related) > LIMITS.finding_related) | ~F.col("claim").isin(*CLAIMS) | ~F.col("severity").isin(*SEVERITIES)
        | ((F.col("claim") == "inference") & (F.size(related) == 0)) | (F.size(F.array_distinct(related)) != F.size(related)) | (reserved & ~shape)
    )
    links = f.select("target_id", F.explode(related).alias("op"))
    return _every([*_node(f, "finding", wrong), missing(links, "op", b["operations"], "id")])


@check("V15")
def unknowns(b: Bundle) -> DataFrame:
    u = b["unknowns"]
    shape = F.size("evidence").between(1, LIMITS.unknown_evidence) & (F.size("origins") <= LIMITS.unknown_origins) & (F.size("affected") <= LIMITS.unknown_affected) & (F.size("suppressed") <= LIMITS.unknown_suppressed)
    given = F.col("origins").isNotNull() & F.col("affected").isNotNull() & F.col("suppressed").isNotNull()
    binding = (F.col("reason") == "external-input-unbound") | (F.col("category") == BINDING_CATEGORY)
    bound = (F.col("reason") == "external-input-unbound") & (F.col("category") == BINDING_CATEGORY) & (F.col("scope") == "unknown") & (F.col("confidence") == "high") & (F.size("evidence") == 1) & (F.size("origins") == 0) & (F.size("affected") == 0) & (F.size("suppressed") == 1) & (F.col("provenance.rule_id") == BINDING_RULE) & (F.col("provenance.evidence_source") == "external-audit") & (F.col("provenance.analyzer") == ANALYZER)
    wrong = (
        blank("category") | blank("title") | blank("description") | ~F.col("reason").isin(*UNKNOWN_REASONS) | ~given | ~shape | ((F.col("reason") == "native-behavior") & (F.col("scope") == "repository-tooling")) | (F.size(F.array_distinct("affected")) != F.size("affected"))
        | F.exists("origins", lambda o: ~o["kind"].isin(*ORIGIN_KINDS)) | (binding & ~bound)
    )
    links = u.select("target_id", F.explode("affected").alias("op"))
    bindings = u.where(binding).select("target_id", F.get("evidence", F.lit(0))["input_id"].alias("input"))
    external = b["inputs"].where("type = 'external-audit'").select("target_id", F.col("id").alias("input"))
    native = u.where("reason = 'native-behavior' and provenance.evidence_source <> 'external-audit'").select("target_id", F.explode("evidence.path").alias("path"))
    elf = b["inventory"].where("binary is not null or content_type = 'application/x-elf'").select("target_id", "path")
    return _every([*_node(u, "unknown", wrong), missing(links, "op", b["operations"], "id"), repeated(bindings, "input"), missing(bindings, "input", external, "input"), missing(elf, "path", native, "path"), missing(external, "input", bindings, "input")])


def _nodes(b: Bundle) -> DataFrame:
    return graph.nodes(b["operations"], b["resources"], b["findings"], b["unknowns"])


@check("V16")
def relationships(b: Bundle) -> DataFrame:
    e = b["relationships"]
    tuple_ = ["target_id", "type", "from_kind", "from", "to_kind", "to"]
    required = graph.base_edges(b["resources"], b["findings"], b["unknowns"]).select(*tuple_)
    base = e.where(F.col("type").isin(*BASE_EDGES)).select(*tuple_)
    detail = F.concat_ws(" ", "type", F.col("from"), F.col("to"))
    ends = _nodes(b).select("target_id", "kind", "reference")
    from_, to = ends.select("target_id", F.col("kind").alias("from_kind"), F.col("reference").alias("from")), ends.select("target_id", F.col("kind").alias("to_kind"), F.col("reference").alias("to"))
    compared = e.where(F.col("type").isin(*COMPARISON_EDGES))
    reserved = b["findings"].where((F.col("category") == COVERAGE_CATEGORY) | (F.col("provenance.rule_id") == COVERAGE_RULE)).select("target_id", F.col("reference").alias("to"))
    incoming = reserved.join(e.where("type = 'disagrees-with'").select("target_id", "to", F.lit(1).alias("_one")), ["target_id", "to"], "left").groupBy("target_id", "to").agg(F.count("_one").alias("n"))
    over = compared.groupBy("target_id").count().where(F.col("count") > LIMITS.records)
    return _every(
        [
            bad(e, blank("id") | blank("from") | blank("to") | (F.col("from") == F.col("to")) | ~F.col("type").isin(*BASE_EDGES, *COMPARISON_EDGES)),
            bad(e, F.col("id") != D.edge_id(F.col("type"), F.col("from_kind"), F.col("from"), F.col("to_kind"), F.col("to"))),
            repeated(e, "id"),
            required.exceptAll(base).select("target_id", detail.alias("detail")),
            base.exceptAll(required).select("target_id", detail.alias("detail")),
            e.join(from_, ["target_id", "from_kind", "from"], "left_anti").select("target_id", F.col("id").alias("detail")),
            e.join(to, ["target_id", "to_kind", "to"], "left_anti").select("target_id", F.col("id").alias("detail")),
            repeated(compared, "from", "to"),
            bad(incoming, F.col("n") != 1, "to"),
            over.select("target_id", F.lit("comparisons").alias("detail")),
        ]
    )


@check("V17")
def comparisons(b: Bundle) -> DataFrame:
    every = _nodes(b).join(_every([b[n].select("target_id", "reference", F.col("provenance.analyzer").alias("analyzer"), F.col("provenance.analyzer_version").alias("version")) for n in ("operations", "resources", "findings", "unknowns")]), ["target_id", "reference"])
    side = lambda x: every.select("target_id", F.col("reference").alias(x), F.col("subject").alias(f"{x}_subject"), (F.col("evidence_source") == "external-audit").alias(f"{x}_outside"), F.concat_ws(" ", "analyzer", "version").alias(f"{x}_analyzer"), F.col("evidence_source").alias(f"{x}_source"))
    e = b["relationships"].where(F.col("type").isin(*COMPARISON_EDGES)).join(side("from"), ["target_id", "from"]).join(side("to"), ["target_id", "to"])
    one = (F.col("from") < F.col("to")) & (F.col("from_kind") == F.col("to_kind")) & F.col("from_kind").isin("operation", "resource") & (F.col("from_subject") == F.col("to_subject")) & (F.col("basis.kind") == F.col("from_kind")) & (F.col("basis.subject") == F.col("from_subject"))
    same = F.col("from_analyzer") == F.col("to_analyzer")
    right = (
        F.when(F.col("type") == "corroborates", one & (F.col("from_outside") != F.col("to_outside")) & ~same)
        .when(F.col("type") == "duplicates", one & (F.col("from_source") == F.col("to_source")) & same)
        .otherwise(F.col("from_kind").isin("operation", "resource") & (F.col("to_kind") == "finding") & (F.col("basis.kind") == "coverage") & (F.col("basis.subject") == F.col("from_subject")))
    )
    payload = _every([b[n].select("target_id", "reference", F.to_json(F.struct(*graph.PAYLOAD[k])).alias("payload")) for n, k in (("operations", "operation"), ("resources", "resource"))])
    twins = b["relationships"].where("type = 'duplicates'").select("target_id", "id", "from", "to").join(payload.select("target_id", F.col("reference").alias("from"), F.col("payload").alias("a")), ["target_id", "from"]).join(payload.select("target_id", F.col("reference").alias("to"), F.col("payload").alias("b")), ["target_id", "to"])
    # a disagreement's observation has no counterpart of the opposite source
    alone = graph.coverage_differences(_nodes(b)).select("target_id", F.col("reference").alias("from"))
    differing = b["relationships"].where("type = 'disagrees-with'").select("target_id", "from")
    return _every([bad(e, ~right), bad(twins, F.col("a") != F.col("b")), missing(differing, "from", alone, "from")])


@check("V18")
def provenances(b: Bundle) -> DataFrame:
    p = F.col("provenance")
    local = p["evidence_source"].isin("target-source", "inventory-metadata") & (p["analyzer"] == ANALYZER) & (p["analyzer_version"] == ANALYZER_VERSION)
    raw = (p["evidence_source"] == "external-audit") & (p["analyzer"] == EXTERNAL_ANALYZER) & (p["rule_id"] == EXTERNAL_RULE)
    about = (p["evidence_source"] == "external-audit") & (p["analyzer"] == ANALYZER) & (p["analyzer_version"] == ANALYZER_VERSION)
    given = p["evidence_source"].isin(*EVIDENCE_SOURCES) & (p["rule_id"] != "") & (p["analyzer"] != "") & (p["analyzer_version"] != "")
    allowed = {"operations": local | raw, "resources": local | raw, "findings": local | raw | (about & (p["rule_id"] == COVERAGE_RULE)), "unknowns": local | (about & p["rule_id"].isin(BINDING_RULE, BUDGET_RULE))}
    return _every([bad(b[n], ~(given & ok)) for n, ok in allowed.items()])


def _evidence(b: Bundle) -> DataFrame:
    source = F.col("provenance.evidence_source").alias("source")
    one = [b[n].select("target_id", "id", "evidence", source) for n in ("operations", "resources")]
    many = [b[n].select("target_id", "id", F.explode("evidence").alias("evidence"), source) for n in ("findings", "unknowns")]
    origins = b["unknowns"].select("target_id", "id", F.explode("origins.evidence").alias("evidence"), source)
    return _every([*one, *many, origins])


@check("V19")
def anchors(b: Bundle) -> DataFrame:
    e = _evidence(b).select("target_id", "id", "source", "evidence.*")
    start, end = F.coalesce("line_start", F.lit(0)), F.coalesce("line_end", F.lit(0))
    lines = (start < 0) | (end < 0) | ((start == 0) & (end != 0)) | ((end != 0) & (end < start))
    inside = e.where("source <> 'external-audit'")
    kinds = b["inputs"].select("target_id", F.col("id").alias("input_id"), F.col("type").alias("_type"))
    typed = e.join(kinds, ["target_id", "input_id"], "left")
    expected = F.when(F.col("source") == "external-audit", "external-audit").otherwise("target-inventory")
    return _every([bad(e, blank("input_id") | blank("path") | ~P.canonical_relative(F.col("path")) | lines), bad(typed, F.col("_type") != expected), missing(inside, "path", b["inventory"], "path")])


@check("V21")
def notes(b: Bundle) -> DataFrame:
    rel = F.col("path").isNotNull() & (F.col("path") != "") & (F.col("path") != ".") & ~P.canonical_relative(F.col("path"))
    scope = F.col("scope").isNotNull() & ~F.col("scope").isin("", *SCOPES)
    return _every([bad(b["limitations"], blank("code") | blank("description") | rel | scope, "code"), bad(b["errors"], blank("code") | blank("message") | rel, "code")])


def recomputed_review(b: Bundle) -> DataFrame:
    return rollup.review(b["target"], coverage.summary(b["inventory"]), b["operations"], b["resources"], b["findings"], b["unknowns"], b["limitations"], b["errors"])


@check("V22")
def reviews(b: Bundle) -> DataFrame:
    """The review equals what the rows give, column by column; nulls equal nulls."""
    fresh = recomputed_review(b)
    columns = [c for c in fresh.columns if c != "target_id"]
    both = b["target"].select("target_id").join(b["review"].select("target_id", F.to_json(F.struct(*columns)).alias("_a")), "target_id", "left").join(fresh.select("target_id", F.to_json(F.struct(*columns)).alias("_b")), "target_id", "left")
    return bad(both, ~F.col("_a").eqNullSafe(F.col("_b")), F.lit("review"))


@check("V23")
def status(b: Bundle) -> DataFrame:
    r = b["review"].select("target_id", (F.col("unknowns") + F.col("limitations") + F.col("errors")).alias("_said"), F.col("errors").alias("_errors"), F.col("coverage.level").alias("_level"), F.col("coverage.excluded_units").alias("_out"))
    s = b["scan"].join(r, "target_id", "left")
    covered = F.coalesce(F.col("_level"), F.lit("not-applicable")).isin("complete", "not-applicable") & (F.coalesce("_out", F.lit(0)) == 0)
    right = F.when(F.col("status") == "complete", (F.col("_said") == 0) & covered).when(F.col("status") == "incomplete", F.col("_said") > 0).otherwise(F.col("_errors") > 0)
    return bad(s, ~right, "status")


def policy(b: Bundle, expected: dict[str, int]) -> DataFrame:
    """V24: resource limits equal the policy exactly."""
    limits = F.col("resource_limits")
    return bad(b["scan"], ~F.coalesce(F.lit(True) if not expected else _all([limits[k] == v for k, v in expected.items()]), F.lit(False)), F.lit("policy"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


ORDINALS = {name: i for i, name in enumerate(_CHECKS, 1)}


def violations(bundle: Bundle, only: tuple[str, ...] | None = None) -> DataFrame:
    """(target_id, check_id, ordinal, detail) of all checks, or of those named in ``only``.

    V20, scopes and confidences, is part of the node checks V12 to V15."""
    parts = [f(bundle).select("target_id", F.lit(n).alias("check_id"), F.lit(ORDINALS[n]).alias("ordinal"), "detail") for n, f in _CHECKS.items() if only is None or n in only]
    return _every(parts)


def first_violation(found: DataFrame) -> DataFrame:
    return found.groupBy("target_id").agg(F.min_by(F.struct("check_id", "detail"), F.struct("ordinal", "detail")).alias("first")).select("target_id", "first.*")
