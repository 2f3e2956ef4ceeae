"""Source text to rows: operations, pipes, limitations and manifests.

Files are chosen by Column predicates; only shell, QML and manifest files reach the Python parsers,
in Arrow batches. The parsers emit plain facts; ids, rules and scopes are relational."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.functions import paths as P
from lucerna.functions import qml, shell
from lucerna.functions.shared import settle
from lucerna.functions.texts import Lines, flat, text_of
from lucerna.schemas import ANALYZER, ANALYZER_VERSION, DYNAMIC, EVIDENCE, LIMITS, PROVENANCE, TARGET_INPUT

FACTS = (
    "target_id string, path string, fact string, seq int, line_start int, line_end int, operation string, excerpt string, command string, arguments array<string>, "
    "dynamic boolean, inline_pipe boolean, left_seq int, right_seq int, message string"
)
_COLUMNS = [c.split()[0] for c in FACTS.split(", ")]
#: What a text gives, whoever holds it.
PARSED = FACTS.replace("target_id string, path string", "kind string, sha256 string")
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]


def provenance(rule: str | Column, source: str = "target-source") -> Column:
    return F.struct((F.lit(rule) if isinstance(rule, str) else rule).alias("rule_id"), F.lit(ANALYZER).alias("analyzer"), F.lit(ANALYZER_VERSION).alias("analyzer_version"), F.lit(source).alias("evidence_source")).cast(PROVENANCE)


def _excerpt(lines: Lines, line: int) -> str:
    return P.cut_bytes(lines.line(line, LIMITS.excerpt_bytes + 1), LIMITS.excerpt_bytes)


def _printed(text: str, start: int, end: int) -> str:
    most = LIMITS.string_bytes // 2
    return P.cut_bytes(flat(text, start, end, most), most)


def shell_facts(text: str) -> Iterator[dict]:
    """One fact per command and per pipe; of a text that does not parse, its limitation only."""
    try:
        nodes = shell.parse(text)
    except shell.ShellSyntaxError as e:
        yield {"fact": "limitation", "seq": 0, "command": "shell-parse-error", "message": str(e)}
        return
    except RecursionError:
        yield {"fact": "limitation", "seq": 0, "command": "shell-parse-error", "message": "nested too deeply"}
        return
    lines, number = Lines(text), {}
    for node in nodes:
        for call in node.calls():
            seq = number[id(call)] = len(number)
            start = lines.at(call.start)
            yield {
                "fact": "shell",
                "seq": seq,
                "line_start": start,
                "line_end": lines.at(max(call.start, call.end - 1)),
                "operation": _printed(text, call.start, call.end),
                "excerpt": _excerpt(lines, start),
                "command": call.words[0][0],
                "arguments": [w for w, _ in call.words[1:]],
                "dynamic": any(d for _, d in call.words),
            }
    seq = 0
    for node in nodes:
        for pipe in node.pipes():
            left, right = shell.first_call(pipe.left), shell.first_call([pipe.right])
            if left and right:
                start = lines.at(pipe.start)
                yield {
                    "fact": "pipe",
                    "seq": seq,
                    "line_start": start,
                    "line_end": lines.at(max(pipe.start, pipe.end - 1)),
                    "operation": _printed(text, pipe.start, pipe.end),
                    "excerpt": _excerpt(lines, start),
                    "left_seq": number[id(left)],
                    "right_seq": number[id(right)],
                }
                seq += 1


def qml_facts(text: str) -> Iterator[dict]:
    lines = Lines(text)
    for seq, c in enumerate(qml.commands(text)):
        start = lines.at(c.start)
        words = c.words or [""]
        name = words[0].rstrip("/").rpartition("/")[2]
        inline = name in P.INTERPRETERS and len(words) > 2 and words[1] == "-c"
        yield {
            "fact": "qml",
            "seq": seq,
            "line_start": start,
            "line_end": lines.at(c.end),
            "operation": P.cut_bytes(c.text.strip(), LIMITS.string_bytes // 2),
            "excerpt": _excerpt(lines, start),
            "command": words[0],
            "arguments": words[1:],
            "dynamic": c.dynamic,
            "inline_pipe": shell.pipes_into_interpreter(words[2], P.DOWNLOADERS, P.INTERPRETERS) if inline else None,
        }
    if qml.assigns_command(text):
        yield {"fact": "limitation", "seq": 0, "command": "qml-imperative-command-analysis-unavailable", "message": "A Process command is assigned imperatively. Assignments are not resolved, so the executable and its arguments remain unknown."}


def sources(contents: DataFrame) -> DataFrame:
    """``contents`` (target_id, path, content) with what their text says of them: ``kind``, shell or qml, of files
    that are parsed, ``shell``, ``language`` without an analyser, and ``sha256``; the content itself, never null, is last."""
    path, text = F.col("path"), text_of(F.col("content"))
    shell_ = P.is_shell(path, text)
    kind = F.when(~P.is_inert_git(path), F.when(shell_, "shell").when(P.is_qml(path), "qml"))
    body = F.coalesce("content", F.lit(b""))
    return contents.select("target_id", "path", kind.alias("kind"), shell_.alias("shell"), P.unsupported_language(path, text).alias("language"), F.sha2(body, 256).alias("sha256"), body.alias("content"))


def parsed(files: DataFrame) -> DataFrame:
    """The facts of the distinct texts of ``files``, by kind and hash: copies are parsed once."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for kind, sha256, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                source = content.decode("utf-8", "replace")
                rows += [{"kind": kind, "sha256": sha256} | f for f in (shell_facts if kind == "shell" else qml_facts)(source)]
            names = ["kind", "sha256", *_COLUMNS[2:]]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in zip(names, _KINDS, strict=True)], names)

    once = files.where("kind is not null").select("kind", "sha256", "content").distinct()
    # dealt by number: what is small would be merged, but parsing it is not
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(once.repartition(parts).mapInArrow(parse, PARSED), "parsed")


def held_facts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """The facts of every file, with its ``scope`` if ``files`` have one, from those of its text; what else is
    known of a text's operations (``used``) goes along."""
    scope = [c for c in files.columns if c == "scope"]
    more = [c for c in texts.columns if c == "used"]
    return files.select("target_id", "path", "kind", "sha256", *scope).join(texts, ["kind", "sha256"]).select(*_COLUMNS, *scope, *more)


def facts(contents: DataFrame) -> DataFrame:
    """All facts of the shell and QML files of ``contents`` (target_id, path, content)."""
    files = sources(contents)
    return held_facts(files, parsed(files))


def evidence(path: Column, line_start: Column, line_end: Column, operation: Column, excerpt: Column) -> Column:
    return F.struct(F.lit(TARGET_INPUT).alias("input_id"), path.alias("path"), line_start.alias("line_start"), line_end.alias("line_end"), operation.alias("operation"), excerpt.alias("excerpt")).cast(EVIDENCE)


def invoked() -> tuple[Column, Column, Column]:
    """(command, arguments, dynamic) of the operations among facts."""
    unnamed = F.col("command") == ""
    return F.when(unnamed, DYNAMIC).otherwise(F.col("command")), F.coalesce("arguments", F.array().cast("array<string>")), F.col("dynamic") | (unnamed & (F.col("fact") == "qml"))


def operations(found: DataFrame) -> DataFrame:
    """Operations with ids; ordinals run over a target's files in path order, in each as it numbers them.
    A ``scope`` of the facts and what they are known to use are kept."""
    ops = found.where(F.col("fact").isin("shell", "qml"))
    ordinal = F.row_number().over(W.partitionBy("target_id").orderBy("path", "seq"))
    unnamed = F.col("command") == ""
    command, arguments, dynamic = invoked()
    rule = F.when(F.col("fact") == "shell", "shell-operation-extraction/v1").otherwise("qml-operation-extraction/v1")
    return ops.withColumn("ordinal", ordinal).select(
        "target_id",
        F.concat(F.lit("op-"), P.slug(F.col("path")), F.lit("-"), F.col("line_start"), F.lit("-"), F.col("ordinal")).alias("id"),
        F.lit("process-execution").alias("category"),
        command.alias("command"),
        arguments.alias("arguments"),
        dynamic.alias("dynamic"),
        F.when(unnamed, "medium").otherwise("high").alias("confidence"),
        evidence(F.col("path"), F.col("line_start"), F.col("line_end"), F.col("operation"), F.col("excerpt")).alias("evidence"),
        provenance(rule).alias("provenance"),
        "path",
        "ordinal",
        "seq",
        "fact",
        "inline_pipe",
        *[c for c in found.columns if c in ("scope", "used")],
    )


def source_limitations(found: DataFrame) -> DataFrame:
    return found.where("fact = 'limitation'").select("target_id", F.col("command").alias("code"), F.col("message").alias("description"), "path", *[c for c in found.columns if c == "scope"])


# manifests

MANIFEST_FACTS = "target_id string, parsed boolean, message string, schema_version int, manifest struct<id:string,name:string,version:string,description:string,kinds:array<string>,entry_points:map<string,string>>"


def read_manifest(data: bytes) -> dict:
    """The manifest's fields; JSON of another shape is an error. Keys match whatever their case, as
    the platform reads them; unknown keys and nulls are passed over."""
    try:
        doc = json.loads(data.decode("utf-8", "replace"))
        if not isinstance(doc, dict):
            raise ValueError("the document is not an object")
        fields = {}
        for k, v in doc.items():
            if v is not None:
                fields[k.lower()] = v
        out = {}
        for key, name, kind in (("schemaversion", "schema_version", int), ("id", "id", str), ("name", "name", str), ("version", "version", str), ("description", "description", str), ("kinds", "kinds", list), ("entrypoints", "entry_points", dict)):
            value = fields.get(key, kind())
            if not isinstance(value, kind) or isinstance(value, bool):
                raise ValueError(f"{key} is not of the expected type")
            out[name] = value
        if any(not isinstance(x, str) for x in [*out["kinds"], *out["entry_points"].values()]):
            raise ValueError("kinds and entryPoints hold strings only")
    except (ValueError, RecursionError) as e:
        return {"parsed": False, "message": str(e)}
    return {"parsed": True, "schema_version": out.pop("schema_version"), "manifest": out | {"entry_points": list(out["entry_points"].items())}}


def manifests(contents: DataFrame) -> DataFrame:
    """One row per target with a ``manifest.json`` at its root."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, kinds = pa.string(), pa.list_(pa.string())
        shape = pa.struct([("id", text), ("name", text), ("version", text), ("description", text), ("kinds", kinds), ("entry_points", pa.map_(text, text))])
        for b in batches:
            rows = [read_manifest(c or b"") for c in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r["parsed"] for r in rows]), pa.array([r.get("message") for r in rows], text), pa.array([r.get("schema_version") for r in rows], pa.int32()), pa.array([r.get("manifest") for r in rows], shape)], ["target_id", "parsed", "message", "schema_version", "manifest"])

    return contents.where("path = 'manifest.json'").select("target_id", "content").mapInArrow(parse, MANIFEST_FACTS)


#: Which entry point a kind needs. Other kinds need none.
REQUIRED_ENTRIES = {"bar": "bar", "bar-widget": "barWidget", "menu": "menu", "overlay": "overlay", "panel": "panel", "service": "service"}


def manifest_problems(found: DataFrame, contents: DataFrame) -> DataFrame:
    """(target_id, position, problem): every clause of the contract that a manifest violates, sorted."""
    m = F.col("manifest")
    clauses = F.array(
        F.when(F.col("schema_version") != 1, "schemaVersion must be the JSON number 1."),
        F.when(~P.valid_manifest_id(m["id"]), "id is empty, malformed, contains '..', or uses a reserved namespace."),
        F.when((m["name"] == "") | (m["version"] == ""), "name and version are required non-empty manifest fields."),
        F.when(F.size(m["kinds"]) == 0, "kinds must be a non-empty array."),
    )
    good = found.where("parsed")
    fixed = good.select("target_id", F.explode(F.array_compact(clauses)).alias("problem"))
    needs = F.create_map(*[F.lit(x) for pair in REQUIRED_ENTRIES.items() for x in pair])
    kinds = good.select("target_id", m["entry_points"].alias("entries"), F.explode(m["kinds"]).alias("kind")).withColumn("key", F.element_at(needs, F.col("kind"))).where("key is not null")
    entries = kinds.select("target_id", "kind", "key", F.element_at("entries", F.col("key")).alias("entry"))
    # only what a manifest names is looked up: entries are few, files are not
    held = contents.select("target_id", F.col("path").alias("entry")).join(entries.select("target_id", "entry"), ["target_id", "entry"], "left_semi").withColumn("held", F.lit(True))
    quoted = lambda c: F.to_json(F.struct(c.alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")))) - 6)
    missing = F.concat(F.lit("kind "), quoted(F.col("kind")), F.lit(" requires entryPoints."), F.col("key"), F.lit("."))
    unsafe = F.concat(F.lit("entry point "), quoted(F.col("entry")), F.lit(" must be a safe relative path without '..'."))
    absent = F.concat(F.lit("declared entry point "), quoted(F.col("entry")), F.lit(" is absent or was not inspectable."))
    problem = F.when(F.col("entry").isNull(), missing).when(~P.safe_entry_point(F.col("entry")), unsafe).when(F.col("held").isNull(), absent)
    by_kind = entries.join(held, ["target_id", "entry"], "left").select("target_id", problem.alias("problem")).where("problem is not null")
    every = fixed.unionByName(by_kind).groupBy("target_id").agg(F.array_sort(F.collect_list("problem")).alias("problems"))
    return every.select("target_id", F.posexplode("problems").alias("at", "problem")).select("target_id", (F.col("at") + 1).alias("position"), "problem")
