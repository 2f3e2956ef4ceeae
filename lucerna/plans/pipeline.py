"""The whole analysis as one plan: tables of many targets in, tables of evidence out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions.shared import settle
from lucerna.operators import canonical, checks, coverage, extract, graph, reach, rollup, rules
from lucerna.schemas import SCHEMA_VERSION, TARGET_INPUT


@dataclass(frozen=True)
class Analysis:
    """The tables of an analysis; each has ``target_id``."""

    inventory: DataFrame
    manifests: DataFrame
    operations: DataFrame
    resources: DataFrame
    findings: DataFrame
    unknowns: DataFrame
    limitations: DataFrame
    errors: DataFrame
    relationships: DataFrame
    review: DataFrame
    status: DataFrame


def extracted(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, operations with what they use), parsed, numbered and judged once."""
    files = extract.sources(contents)
    found = settle(extract.held_facts(files, rules.text_uses(extract.parsed(files))), "facts")
    return found.drop("used"), settle(extract.operations(found), "used")


def analyze(contents: DataFrame, inventory: DataFrame, limitations: DataFrame | None = None, errors: DataFrame | None = None, targets: DataFrame | None = None) -> Analysis:
    """``contents`` (target_id, path, content) and ``inventory`` to all evidence tables.

    What several branches need is settled once: parsed facts, reachability, and scoped rows."""
    return _analyzed(contents, inventory, limitations, errors, targets, True)


def reviewed(contents: DataFrame, inventory: DataFrame, limitations: DataFrame | None = None, errors: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """The review of ``analyze`` with each target's ``status``; of the evidence, only what it reads is kept."""
    return _analyzed(contents, inventory, limitations, errors, targets, False)


def _analyzed(contents: DataFrame, inventory: DataFrame, limitations: DataFrame | None, errors: DataFrame | None, targets: DataFrame | None, whole: bool) -> Analysis | DataFrame:
    kept = lambda df, name, *columns: settle(df if whole else df.select(*columns), name)
    spark = contents.sparkSession
    inventory = settle(inventory, "listing")
    targets = (inventory.select("target_id") if targets is None else targets.select("target_id")).distinct()
    sources = extract.sources(contents)
    texts = rules.text_uses(extract.parsed(sources))
    manifests = settle(extract.manifests(contents), "manifests")
    problems = extract.manifest_problems(manifests, contents)
    unknown, native = rules.native_unknowns(inventory)

    links = settle(reach.references(contents, reach.candidates(contents, inventory)), "references")
    reached = settle(reach.reachable(reach.seeds(contents, manifests), links), "reached")
    # files get their scope first, and what is found in them has it from there
    placed = settle(reach.with_scope(sources.drop("content"), reached), "placed")
    found = extract.held_facts(placed, texts)
    operations = kept(extract.operations(found), "operations", "target_id", "id", "path", "command", "arguments", "dynamic", "confidence", "evidence", "seq", "fact", "inline_pipe", "scope", "used")
    resources = rules.resources(operations)
    resources = settle(resources, "resources") if whole else resources
    by_manifest = reach.with_scope(rules.manifest_findings(manifests, problems), reached, F.lit("manifest.json"))
    every = rules.operation_findings(operations).unionByName(rules.pipe_findings(found, operations)).unionByName(by_manifest)
    shown = ("target_id", "id", "claim", "severity", "confidence", "title", "scope")
    findings = settle((every if whole else every.select(*shown)).dropDuplicates(["target_id", "id"]), "findings")
    unknowns = settle(reach.with_scope(unknown, reached, F.get("evidence", F.lit(0))["path"]), "unknowns")

    none = F.lit(None).cast("string")
    noted = rules.manifest_limitations(targets, manifests).unionByName(native)
    if limitations is not None:
        noted = noted.unionByName(limitations)
    errors = spark.createDataFrame([], "target_id string, code string, message string, path string") if errors is None else errors
    by_path = reach.with_scope(noted.where("scope is null and path is not null").drop("scope"), reached)
    scoped = extract.source_limitations(found).unionByName(rules.language_limitations(placed)).unionByName(noted.where("scope is not null or path is null")).unionByName(by_path)
    scoped = settle(scoped, "limitations")

    files = coverage.dispositions(inventory, placed, scoped, errors)
    files = settle(files, "inventory") if whole else files
    summary = coverage.summary(files)
    review = rollup.with_gap(rollup.review(targets, summary, operations, resources, findings, unknowns, scoped, errors))
    if not whole:
        return review
    review = settle(review, "review")
    gap = review.where("gap").select("target_id", F.lit(rollup.GAP_CODE).alias("code"), F.lit("Some retained artifacts could be analyzed in part only, or not at all.").alias("description"), none.alias("path"), F.lit("unknown").alias("scope"))
    return Analysis(
        files,
        manifests,
        graph.referenced(operations.drop("used"), "operation"),
        graph.referenced(resources, "resource"),
        graph.referenced(findings, "finding"),
        graph.referenced(unknowns, "unknown"),
        scoped.unionByName(gap),
        errors,
        graph.base_edges(resources, findings, unknowns),
        review.drop("status", "gap"),
        review.select("target_id", "status"),
    )


def bundle(a: Analysis, domain: str = D.DIGEST_DOMAIN) -> dict[str, DataFrame]:
    """The tables that the checks read, with scan and target rows and the target's own input."""
    now = F.current_timestamp()
    digests = canonical.root_digest(a.inventory, domain)
    sums = coverage.byte_totals(a.inventory)
    manifest = a.manifests.where("parsed").select("target_id", "manifest")
    ids = a.status.select("target_id")
    target = ids.join(sums, "target_id", "left").join(digests, "target_id", "left").join(manifest, "target_id", "left").withColumn("display_name", F.col("target_id")).na.fill(0, ["file_count", "read_bytes", "binary_bytes"])
    limits = "struct<memory_max_bytes:long,memory_swap_bytes:long,tasks_max:int,cpu_quota_percent:int,wall_time_seconds:int>"
    scan = a.status.select("target_id", F.lit(SCHEMA_VERSION).alias("schema_version"), "status", F.lit("development").alias("scanner_version"), F.lit("1").alias("policy_version"), now.alias("started_at"), now.alias("completed_at"), F.lit(False).alias("sandboxed"), F.lit(None).cast(limits).alias("resource_limits"))
    inputs = digests.select("target_id", F.lit(TARGET_INPUT).alias("id"), F.lit("target-inventory").alias("type"), F.lit("scanned target").alias("label"), F.lit("").alias("document_sha256"), F.col("root_digest").alias("subject_root_digest"), F.lit(checks.TARGET_FORMAT).alias("format"), F.lit(checks.TARGET_VERSION).alias("version"))
    return {
        "scan": scan,
        "target": target,
        "inputs": inputs,
        "inventory": a.inventory,
        "operations": a.operations,
        "resources": a.resources,
        "findings": a.findings,
        "unknowns": a.unknowns,
        "relationships": a.relationships,
        "limitations": a.limitations,
        "errors": a.errors,
        "review": a.review,
    }


def report_json(a: Analysis) -> DataFrame:
    """(target_id, report, error): canonical JSON of every target."""
    b = bundle(a)
    head = b["scan"].join(b["target"], "target_id").join(b["review"].select("target_id", F.struct(*[c for c in b["review"].columns if c != "target_id"]).alias("review")), "target_id")
    scalar = ["schema_version", "status", "scanner_version", "policy_version", "sandboxed", "display_name", "root_digest", "file_count", "read_bytes", "binary_bytes", "manifest", "review"]
    sections = {n: b[n] for n in ("inputs", "inventory", "operations", "resources", "findings", "unknowns", "relationships", "limitations", "errors")}
    return canonical.reports(sections, head.select("target_id", F.to_json(F.struct(*scalar), {"ignoreNullFields": "false"}).alias("head_json")))
