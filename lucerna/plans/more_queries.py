"""Queries for single operators on synthetic rows that are derived from the driver's tables by rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions import paths as P
from lucerna.operators import canonical, checks, graph, reach, rollup, rules, view
from lucerna.sources import tree
from lucerna.sources.maps import inventory_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ARGUMENTS = "CASE c_custkey % 8 WHEN 0 THEN '/' WHEN 1 THEN '-rf' WHEN 2 THEN 'https://Host.example.com/x' WHEN 3 THEN '~/.ssh/id_rsa' WHEN 4 THEN '/home/u' WHEN 5 THEN '' WHEN 6 THEN 'a/.bashrc' ELSE 'plain' END"


def path_operands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operands among arguments, their marks, and how severe their deletion is."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.array(F.expr(_ARGUMENTS), F.concat(F.lit("dir/f"), F.col("c_custkey"))).alias("args"))
    ops = P.path_operands(F.col("args"))
    return rows.select("c_custkey", F.array_join(ops, " ").alias("operands"), F.exists(ops, P.is_sensitive).alias("sensitive"), F.exists(ops, P.is_persistent).alias("persistent"), P.removes_recursively(F.col("args")).alias("recursive"), rules.deletion_severity(ops, F.col("args"), F.lit(False)).alias("severity"))


_SHAPES = "CASE o_orderkey % 9 WHEN 0 THEN 'a/b' WHEN 1 THEN '../a' WHEN 2 THEN '/a' WHEN 3 THEN 'a//b' WHEN 4 THEN './a' WHEN 5 THEN 'a/../b' WHEN 6 THEN '' WHEN 7 THEN 'a/' ELSE 'a..b' END"


def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SHAPES).alias("path"))
    return rows.select("o_orderkey", P.canonical_relative(F.col("path")).alias("canonical"), P.safe_entry_point(F.col("path")).alias("safe"), P.valid_plugin_id(F.col("path")).alias("plugin"), P.valid_display_name(F.col("path")).alias("display"))


def display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document heads as a viewer shows them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", P.plain_text(F.col("text"), 80).alias("shown"), P.safe_diagnostic(F.col("text")).alias("diagnostic"))
    return docs.select("doc_id", "shown", F.length("diagnostic").cast("long").alias("diagnostic_chars"))


def external_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("text").alias("text"))
    named = docs.select(F.concat(F.lit("c"), F.col("conv_id")).alias("target_id"), F.lit("audit-1").alias("id"), F.lit("audit").alias("label"), F.col("text").cast("binary").alias("document"))
    return tree.external_input(named)


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of customers as targets: orders of even keys are observed locally, odd ones outside."""
    o = _table(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderkey") % 2 == 0, "target-source").otherwise("external-audit")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("target_id"), F.concat(F.lit("op"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("/bin/cmd"), F.col("o_orderkey") % 399).alias("command"), F.struct(source.alias("evidence_source")).alias("provenance"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "target_id string, id string, kind string, access string, value string, provenance struct<evidence_source:string>")
    return graph.nodes(_observations(spark, sf_dir), none, none, none)


def coverage_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coverage_differences(_nodes(spark, sf_dir)).select("target_id", "id", "subject")


def comparison_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each external observation against the first local one of its subject."""
    nodes = _nodes(spark, sf_dir)
    local = nodes.where("evidence_source = 'target-source'").groupBy("target_id", "subject").agg(F.min("id").alias("from_id"))
    outside = nodes.where("evidence_source = 'external-audit'").select("target_id", "subject", F.col("id").alias("to_id"))
    kind = F.lit("operation")
    wanted = local.join(outside, ["target_id", "subject"]).select("target_id", F.lit("corroborates").alias("type"), kind.alias("from_kind"), "from_id", kind.alias("to_kind"), "to_id", F.lit(None).cast("struct<kind:string,subject:string>").alias("basis"))
    made = graph.compare(nodes, wanted)
    return made.select("target_id", "id", "from", "to", "basis.subject")


def bound_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _observations(spark, sf_dir).withColumn("evidence", F.struct(F.when(F.col("id").endswith("7"), "given").otherwise("").alias("input_id"), F.col("id").alias("path")))
    inputs = rows.select("target_id").distinct().select("target_id", F.explode(F.array(F.lit("audit-b"), F.lit("audit-a"))).alias("id"), F.lit("external-audit").alias("type"))
    return graph.bind_inputs(rows, inputs).select("id", "evidence.input_id")


def plugin_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.plugin_list(_table(spark, sf_dir, "nation").select(F.concat(F.lit("plug."), F.col("n_nationkey")).alias("target_id")))


def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as documents, some with a fault; only well-formed ones decode."""
    k = F.col("event_id") % 6
    text = F.when(k == 1, F.concat("props", F.lit("{}"))).when(k == 2, F.lit('{"k":1,"k":2}')).when(k == 3, F.lit('{"K":1}')).when(k == 4, F.lit('{"k":"\\ud800"}')).otherwise(F.col("props"))
    docs = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("target_id"), text.cast("binary").alias("content"))
    return canonical.read_reports(docs, {"k": None}).select("target_id", "valid")


def related_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope of each customer's orders if they agree; orders of a multiple of 17 don't exist."""
    o = _table(spark, sf_dir, "orders")
    ops = o.where("o_orderkey % 17 <> 0").select(F.lit("t").alias("target_id"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_custkey") % 3 == 0, "runtime").when(F.col("o_orderkey") % 2 == 0, "runtime").otherwise("repository-tooling").alias("scope"))
    rows = o.groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("related")).select(F.lit("t").alias("target_id"), F.col("o_custkey").cast("string").alias("id"), "related")
    return reach.related_scope(rows, ops, "related").select("id", "scope")


def elf_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier ships a file with an ELF magic; each gets an unknown."""
    s = _table(spark, sf_dir, "supplier")
    content = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.unhex(F.lit("7F454C46")), F.col("s_name").cast("binary"))).otherwise(F.col("s_name").cast("binary"))
    files = s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("target_id"), F.lit("lib/tool").alias("path"), content.alias("content"))
    inventory = inventory_of(files)
    unknowns, _ = rules.native_unknowns(inventory)
    return inventory.join(unknowns.select("target_id", "reason"), "target_id", "left").select("target_id", "size", "content_type", "reason")


def listing_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    listed = lambda rows, size: rows.select(F.lit("t").alias("target_id"), F.col("o_orderkey").cast("string").alias("path"), F.lit("regular").alias("kind"), F.lit("-").alias("mode"), size.cast("long").alias("size"), F.lit("").alias("sha256"), F.lit("").alias("link_target"))
    before = listed(o.where("o_orderkey % 5 <> 1"), F.col("o_custkey"))
    after = listed(o.where("o_orderkey % 7 <> 2"), F.when(F.col("o_orderkey") % 11 == 3, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return tree.differences(before, after).select("path", "change")


def _notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Unknowns, limitations and errors of users as targets, by event type."""
    e = _table(spark, sf_dir, "events").withColumn("target_id", F.concat(F.lit("u"), F.col("user_id") % 300))
    unknowns = e.where("event_type = 'click'").select("target_id", F.concat(F.lit("k"), F.col("event_id")).alias("id"), F.lit("dynamic-value").alias("reason"), F.when(F.col("event_id") % 2 == 0, "runtime").otherwise("unknown").alias("scope"), F.when(F.col("event_id") % 10 == 4, F.array(F.lit("op"))).otherwise(F.array().cast("array<string>")).alias("affected"), F.lit("medium").alias("confidence"))
    limits = e.where("event_type = 'view'").select("target_id", F.when(F.col("event_id") % 40 == 0, "max-depth").otherwise("note").alias("code"), F.when(F.col("event_id") % 4 == 1, "runtime").alias("scope"))
    errors = e.where("event_type = 'error' and event_id % 25 = 0").select("target_id")
    return unknowns, limits, errors


def unknown_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.unknown_level(*_notes(spark, sf_dir))


def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences and claims over several record types."""
    unknowns, _, _ = _notes(spark, sf_dir)
    o = _table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey") % 300).alias("target_id"), F.when(F.col("o_orderkey") % 5 == 0, "low").otherwise("high").alias("confidence"), F.when(F.col("o_orderkey") % 3 == 0, "inference").otherwise("fact").alias("claim"))
    every = rollup.counted({"findings": o, "unknowns": unknowns})
    return every.select("target_id", *[f"confidence_{c}" for c in ("low", "medium", "high")], "facts", "inferences", "unknown_behaviors")


def viewer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each target's limitations, formatted."""
    e = _table(spark, sf_dir, "events")
    notes = e.select(F.concat(F.lit("u"), F.col("user_id") % 10).alias("target_id"), F.col("event_type").alias("code"), F.format_string("p/%08d", "event_id").alias("path"), F.when(F.col("event_id") % 2 == 0, "runtime").alias("scope"), F.col("props").alias("description"))
    return view.limitations(notes)


def reference_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References cut to two characters, so that some stand for several identities."""
    rows = _table(spark, sf_dir, "part").select(F.lit("t").alias("target_id"), F.col("p_partkey").cast("string").alias("id"), F.substring(D.node_reference("operation", F.col("p_partkey").cast("string")), 4, 2).alias("reference"))
    return graph.collisions(rows, "reference", F.col("id")).select("reference", "identities")


def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("target_id"), F.concat(F.lit("V"), F.col("l_linenumber")).alias("check_id"), F.col("l_linenumber").alias("ordinal"), F.format_string("%010d", "l_orderkey").alias("detail"))
    return checks.first_violation(found)


_SSH = "'~/.ssh/id_rsa'"


def oracle_sql() -> dict[str, str]:
    return {
        "path_operands": f"""
WITH a AS (SELECT c_custkey, c_custkey % 8 AS k, {_ARGUMENTS} AS a, 'dir/f' || c_custkey AS b FROM customer)
SELECT c_custkey, CASE WHEN k IN (0, 3, 4, 6) THEN a || ' ' || b ELSE b END AS operands, k = 3 AS sensitive, k = 6 AS persistent, k = 1 AS recursive,
  CASE k WHEN 0 THEN 'critical' WHEN 3 THEN 'high' WHEN 4 THEN 'high' WHEN 6 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity FROM a""",
        "relative_paths": "SELECT o_orderkey, o_orderkey % 9 IN (0, 8) AS canonical, o_orderkey % 9 = 0 AS safe, false AS plugin, false AS display FROM orders",
        "display_text": r"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{202A}-\x{202E}\x{2066}-\x{2069}]', chr(65533), 'g') AS safe FROM documents)
SELECT doc_id, CASE WHEN length(safe) > 80 THEN left(safe, 80) || '…' ELSE safe END AS shown, length(text) AS diagnostic_chars FROM d""",
        "external_inputs": "SELECT 'c' || conv_id AS target_id, 'audit-1' AS id, 'external-audit' AS type, 'audit' AS label, sha256(max(text)) AS document_sha256, '' AS subject_root_digest, 'audit-json' AS format, '1' AS version FROM conversations GROUP BY conv_id",
        "coverage_differences": """
WITH o AS (SELECT 'c' || o_custkey % 50 AS target_id, 'op' || o_orderkey AS id, 'command' || chr(0) || 'cmd' || o_orderkey % 399 AS subject, o_orderkey % 2 AS outside FROM orders)
SELECT target_id, id, subject FROM o WHERE NOT EXISTS (SELECT 1 FROM o p WHERE p.target_id = o.target_id AND p.subject = o.subject AND p.outside <> o.outside)""",
        "comparison_edges": """
WITH o AS (
  SELECT 'c' || o_custkey % 50 AS target_id, 'op' || o_orderkey AS op, 'command' || chr(0) || 'cmd' || o_orderkey % 399 AS subject, o_orderkey % 2 AS outside FROM orders),
p AS (
  SELECT a.target_id, a.subject, a.op AS x, b.op AS y FROM (SELECT target_id, subject, min(op) AS op FROM o WHERE outside = 0 GROUP BY ALL) a JOIN o b ON a.target_id = b.target_id AND a.subject = b.subject AND b.outside = 1),
r AS (
  SELECT *, 'PP-' || upper(substr(sha256('operation' || chr(0) || x), 1, 32)) AS rx, 'PP-' || upper(substr(sha256('operation' || chr(0) || y), 1, 32)) AS ry FROM p)
SELECT target_id, 'PE-' || upper(substr(sha256('corroborates' || chr(0) || 'operation' || chr(0) || least(rx, ry) || chr(0) || 'operation' || chr(0) || greatest(rx, ry)), 1, 32)) AS id, least(rx, ry) AS "from", greatest(rx, ry) AS "to", subject FROM r""",
        "bound_inputs": "SELECT 'op' || o_orderkey AS id, CASE WHEN o_orderkey % 10 = 7 THEN 'given' WHEN o_orderkey % 2 = 1 THEN 'audit-a' ELSE 'target' END AS input_id FROM orders",
        "plugin_list": """SELECT '{"schemaVersion":"1.0.0","plugins":[' || string_agg('"plug.' || n_nationkey || '"', ',' ORDER BY 'plug.' || n_nationkey) || ']}' AS document FROM nation""",
        "strict_json": "SELECT event_id::VARCHAR AS target_id, event_id % 6 IN (0, 5) AS valid FROM events",
        "related_scopes": """
WITH s AS (
  SELECT o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_custkey % 3 = 0 OR o_orderkey % 2 = 0 THEN 'runtime' ELSE 'repository-tooling' END AS scope FROM orders)
SELECT o_custkey::VARCHAR AS id, CASE WHEN count(*) = count(scope) AND min(scope) = max(scope) THEN min(scope) ELSE 'unknown' END AS scope FROM s GROUP BY o_custkey""",
        "elf_inventory": """
SELECT 's' || s_suppkey AS target_id, strlen(s_name) + CASE WHEN s_suppkey % 3 = 0 THEN 4 ELSE 0 END AS size, CASE WHEN s_suppkey % 3 = 0 THEN 'application/x-elf' ELSE 'text/plain; charset=utf-8' END AS content_type,
  CASE WHEN s_suppkey % 3 = 0 THEN 'native-behavior' END AS reason FROM supplier""",
        "listing_differences": """
SELECT o_orderkey::VARCHAR AS path, CASE WHEN o_orderkey % 5 = 1 THEN 'added' WHEN o_orderkey % 7 = 2 THEN 'removed' ELSE 'changed' END AS change FROM orders
WHERE (o_orderkey % 5 = 1) <> (o_orderkey % 7 = 2) OR (o_orderkey % 5 <> 1 AND o_orderkey % 7 <> 2 AND o_orderkey % 11 = 3)""",
        "unknown_levels": """
WITH r AS (
  SELECT 'u' || user_id % 300 AS target_id,
    CASE WHEN event_type = 'click' THEN CASE WHEN event_id % 10 = 4 THEN 3 WHEN event_id % 2 = 0 THEN 2 ELSE 1 END
      WHEN event_type = 'view' THEN CASE WHEN event_id % 40 = 0 THEN 3 WHEN event_id % 4 = 1 THEN 2 ELSE 1 END
      WHEN event_type = 'error' AND event_id % 25 = 0 THEN 3 END AS rung FROM events)
SELECT target_id, list_extract(['low', 'moderate', 'high'], max(rung)) AS unknown_level FROM r WHERE rung IS NOT NULL GROUP BY 1""",
        "confidence_histogram": """
WITH r AS (
  SELECT 'u' || user_id % 300 AS target_id, 'medium' AS confidence, 'unknown' AS claim FROM events WHERE event_type = 'click'
  UNION ALL SELECT 'u' || o_custkey % 300, CASE WHEN o_orderkey % 5 = 0 THEN 'low' ELSE 'high' END, CASE WHEN o_orderkey % 3 = 0 THEN 'inference' ELSE 'fact' END FROM orders)
SELECT target_id, count(*) FILTER (confidence = 'low')::INT AS confidence_low, count(*) FILTER (confidence = 'medium')::INT AS confidence_medium, count(*) FILTER (confidence = 'high')::INT AS confidence_high,
  count(*) FILTER (claim = 'fact')::INT AS facts, count(*) FILTER (claim = 'inference')::INT AS inferences, count(*) FILTER (claim = 'unknown')::INT AS unknown_behaviors FROM r GROUP BY 1""",
        "viewer_rows": """
WITH e AS (SELECT 'u' || user_id % 10 AS target_id, event_type AS code, printf('p/%08d', event_id) AS path, CASE WHEN event_id % 2 = 0 THEN 'runtime' END AS scope, props FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY code, path) AS position FROM e)
SELECT target_id, position::INT AS position, 'UNKNOWN · ' || code AS title, props AS body, path || coalesce(' · ' || scope, '') AS meta, '' AS evidence FROM n WHERE position <= 500""",
        "reference_collisions": """
WITH r AS (SELECT upper(substr(sha256('operation' || chr(0) || p_partkey), 1, 2)) AS reference FROM part)
SELECT reference, count(*) AS identities FROM r GROUP BY 1 HAVING count(*) > 1""",
        "first_violations": """
WITH v AS (SELECT 's' || l_suppkey AS target_id, l_linenumber AS o, printf('%010d', l_orderkey) AS detail FROM lineitem WHERE l_quantity > 45)
SELECT target_id, 'V' || min(o) AS check_id, arg_min(detail, (o, detail)) AS detail FROM v GROUP BY 1""",
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            path_operands, relative_paths, display_text, external_inputs, coverage_differences, comparison_edges, bound_inputs, plugin_list, strict_json, related_scopes, elf_inventory, listing_differences, unknown_levels,
            confidence_histogram, viewer_rows, reference_collisions, first_violations,
        )
    }
