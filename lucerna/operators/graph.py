"""The evidence graph: references, typed edges, and comparisons between observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions import paths as P
from lucerna.schemas import TARGET_INPUT

_BASIS = "struct<kind:string,subject:string>"


def referenced(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("reference", D.node_reference(kind, F.col("id")))


def nodes(operations: DataFrame, resources: DataFrame, findings: DataFrame, unknowns: DataFrame) -> DataFrame:
    """(target_id, kind, id, reference, subject, evidence_source) of all nodes; ``subject`` of operations and resources."""
    none = F.lit(None).cast("string")
    source = F.col("provenance.evidence_source").alias("evidence_source")
    parts = [
        (operations, "operation", D.operation_subject(P.base_name(F.col("command")))),
        (resources, "resource", D.resource_subject(F.col("kind"), F.col("access"), F.col("value"))),
        (findings, "finding", none),
        (unknowns, "unknown", none),
    ]
    every = [referenced(rows, kind).select("target_id", F.lit(kind).alias("kind"), "id", "reference", subject.alias("subject"), source) for rows, kind, subject in parts]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


def _edges(rows: DataFrame, basis: Column | None = None) -> DataFrame:
    """``rows`` (target_id, type, from_kind, from, to_kind, to) with ids."""
    id_ = D.edge_id(F.col("type"), F.col("from_kind"), F.col("from"), F.col("to_kind"), F.col("to"))
    return rows.select("target_id", id_.alias("id"), "type", "from_kind", "from", "to_kind", "to", (F.lit(None).cast(_BASIS) if basis is None else basis).alias("basis"))


def base_edges(resources: DataFrame, findings: DataFrame, unknowns: DataFrame) -> DataFrame:
    """Every resource to its operation; findings and unknowns to each of theirs.

    Both ends' references are functions of kind and id, so no join is needed; dangling ids are for
    the checks to find."""
    operation = lambda c: D.node_reference("operation", c)
    rows = resources.select("target_id", F.lit("derived-from").alias("type"), F.lit("resource").alias("from_kind"), D.node_reference("resource", F.col("id")).alias("from"), F.lit("operation").alias("to_kind"), operation(F.col("operation_id")).alias("to"))
    by_claim = F.when(F.col("claim") == "inference", "inferred-from").otherwise("established-by")
    found = findings.select("target_id", by_claim.alias("type"), F.lit("finding").alias("from_kind"), D.node_reference("finding", F.col("id")).alias("from"), F.lit("operation").alias("to_kind"), F.explode("related").alias("_op"))
    unknown = unknowns.select("target_id", F.lit("unknown-because").alias("type"), F.lit("unknown").alias("from_kind"), D.node_reference("unknown", F.col("id")).alias("from"), F.lit("operation").alias("to_kind"), F.explode("affected").alias("_op"))
    linked = found.unionByName(unknown).withColumn("to", operation(F.col("_op"))).drop("_op")
    return _edges(rows.unionByName(linked))


def over_production(edges: DataFrame, limit: int) -> DataFrame:
    """Targets whose graph is larger than may be produced."""
    return edges.groupBy("target_id").count().where(F.col("count") > limit)


def collisions(rows: DataFrame, reference: str, identity: Column) -> DataFrame:
    """References that stand for more than one identity within a target."""
    return rows.groupBy("target_id", F.col(reference).alias("reference")).agg(F.count_distinct(identity).alias("identities")).where("identities > 1")


def smallest_external(inputs: DataFrame) -> DataFrame:
    return inputs.where("type = 'external-audit'").groupBy("target_id").agg(F.min("id").alias("external"))


def bind_inputs(rows: DataFrame, inputs: DataFrame, column: str = "evidence") -> DataFrame:
    """Blank evidence inputs: the target, or for external observations the smallest external input."""
    tagged = rows.join(smallest_external(inputs), "target_id", "left")
    outside = F.col("provenance.evidence_source") == "external-audit"
    bound = F.when(outside, F.coalesce("external", F.lit(""))).otherwise(TARGET_INPUT)
    fill = lambda e: e.withField("input_id", F.when(F.coalesce(e["input_id"], F.lit("")) == "", bound).otherwise(e["input_id"]))
    kind = rows.schema[column].dataType.typeName()
    value = F.transform(column, fill) if kind == "array" else fill(F.col(column))
    return tagged.withColumn(column, value).drop("external")


def compare(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """Comparison edges from ``wanted`` (target_id, type, from_kind, from_id, to_kind, to_id, basis).

    The two ends are looked up by kind and id. Corroboration and duplication need one kind and one
    subject, and put the smaller reference first; disagreement goes from an observation to a finding
    and keeps its basis. Equal requests give one edge."""
    ends = every.select("target_id", "kind", "id", "reference", "subject")
    a = ends.select("target_id", F.col("kind").alias("from_kind"), F.col("id").alias("from_id"), F.col("reference").alias("_from"), F.col("subject").alias("_a"))
    b = ends.select("target_id", F.col("kind").alias("to_kind"), F.col("id").alias("to_id"), F.col("reference").alias("_to"), F.col("subject").alias("_b"))
    met = wanted.join(a, ["target_id", "from_kind", "from_id"]).join(b, ["target_id", "to_kind", "to_id"])
    alike = F.col("type").isin("corroborates", "duplicates") & (F.col("from_kind") == F.col("to_kind")) & F.col("from_kind").isin("operation", "resource") & (F.col("_a") == F.col("_b")) & (F.col("_from") != F.col("_to"))
    apart = (F.col("type") == "disagrees-with") & (F.col("to_kind") == "finding") & (F.col("basis.kind") == "coverage") & (F.col("basis.subject") == F.col("_a"))
    kept = met.where(alike | apart)
    swap = alike & (F.col("_from") > F.col("_to"))
    basis = F.when(alike, F.struct(F.col("from_kind").alias("kind"), F.col("_a").alias("subject"))).otherwise(F.col("basis")).cast(_BASIS)
    ordered = kept.select("target_id", "type", "from_kind", F.when(swap, F.col("_to")).otherwise(F.col("_from")).alias("from"), "to_kind", F.when(swap, F.col("_from")).otherwise(F.col("_to")).alias("to"), basis.alias("basis"))
    return _edges(ordered, F.col("basis")).dropDuplicates(["target_id", "id"])


#: Payload columns that duplicates must share.
PAYLOAD = {"operation": ["category", "scope", "command", "arguments", "dynamic", "confidence"], "resource": ["kind", "access", "value", "sensitive", "dynamic", "scope", "confidence"]}


def duplicate_pairs(rows: DataFrame, kind: str) -> DataFrame:
    """(target_id, from_id, to_id): rows of one payload, each with the least id of its payload.

    Pairs within a group are not all listed: every row is paired with the group's first."""
    payload = PAYLOAD[kind]
    first = rows.groupBy("target_id", *payload).agg(F.min("id").alias("from_id"))
    return rows.join(first, ["target_id", *payload]).where("id <> from_id").select("target_id", "from_id", F.col("id").alias("to_id"))


def coverage_differences(observations: DataFrame) -> DataFrame:
    """Observations whose subject no observation of the opposite source has, within a target.

    ``observations``: (target_id, kind, id, reference, subject, evidence_source)."""
    seen = observations.where("subject is not null").withColumn("outside", F.col("evidence_source") == "external-audit")
    other = seen.select("target_id", "subject", (~F.col("outside")).alias("outside")).distinct()
    return seen.join(other, ["target_id", "subject", "outside"], "left_anti").drop("outside")
