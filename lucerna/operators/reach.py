"""Which files run: references between files, reachability, and scopes.

References are computed once per target as an edge table; reachability then iterates on edges alone,
from the frontier only, and stops when nothing is new, cycles included."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.functions import paths as P
from lucerna.functions.shared import settle
from lucerna.functions.texts import text_of


def candidates(contents: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """(target_id, path) of what a reference can point to: files read or listed, outside tooling and Git."""
    every = contents.select("target_id", "path")
    if inventory is not None:
        every = every.unionByName(inventory.where("kind = 'regular'").select("target_id", "path"))
    return every.where(~P.is_git_metadata(F.col("path")) & ~P.is_tooling(F.col("path"))).distinct()


#: Up to so many distinct base names of all targets together are searched for in each distinct text.
SHARED_NAMES = 4_096


#: One stream of a target's texts is so many texts long.
TEXTS_PER_STREAM = 2_000


def references(contents: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, src, dst): ``src``'s text holds the path or the base name of ``dst``.

    A text is read once for all names of its target, by one automaton, so that work grows with the
    texts and not with texts times names. A target's texts are dealt into streams, each led by the
    target's distinct base names; names that were found become files by an equi-join.

    Where all targets together have few base names (copies of the same trees), one automaton of these reads
    each distinct text once instead, and what is found holds for every file with that text."""
    named = targets.select("target_id", F.col("path").alias("dst"), P.base_name(F.col("path")).alias("base"))
    names = [r["base"] for r in named.select("base").distinct().limit(SHARED_NAMES + 1).collect()]
    if len(names) <= SHARED_NAMES:
        return _by_text(contents, named, names)
    return _by_target(contents, named)


def _by_text(contents: DataFrame, named: DataFrame, names: list[str]) -> DataFrame:
    content = F.col("content")
    once = contents.where(F.octet_length(content) > 0).select("content").distinct().select(F.sha2(content, 256).alias("sha256"), text_of(content).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in names:
            automaton.add_word(name, name)
        automaton.make_automaton()
        for b in batches:
            out = [(sha256, base) for sha256, text in zip(*(c.to_pylist() for c in b.columns), strict=True) for base in ({value for _, value in automaton.iter(text)} if names else ())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(2)], ["sha256", "base"])

    found = settle(once.mapInArrow(search, "sha256 string, base string"), "named")
    none = contents.sparkSession.createDataFrame([], "target_id string, src string, dst string")
    if found.isEmpty():
        return none
    texts = contents.select("target_id", F.col("path").alias("src"), F.sha2(content, 256).alias("sha256"))
    return texts.join(found, "sha256").join(named, ["target_id", "base"]).where("src <> dst").select("target_id", "src", "dst").distinct()


def _by_target(contents: DataFrame, named: DataFrame) -> DataFrame:
    texts = contents.select("target_id", F.col("path").alias("src"), text_of(F.col("content")).alias("text")).where(F.length("text") > 0)
    sizes = texts.groupBy("target_id").agg(F.ceil(F.count("*") / TEXTS_PER_STREAM).cast("int").alias("streams"))
    none = F.lit(None).cast("string")
    # a name leads each stream of its target: few streams, as many as the target has texts to fill
    lead = named.select("target_id", "base").distinct().join(sizes, "target_id").select("target_id", F.explode(F.sequence(F.lit(0), F.col("streams") - 1)).alias("stream"), "base", none.alias("src"), none.alias("text"))
    body = texts.join(sizes, "target_id").select("target_id", F.pmod(F.xxhash64("src"), F.col("streams")).cast("int").alias("stream"), none.alias("base"), "src", "text")
    rows = lead.unionByName(body).repartition("target_id", "stream").sortWithinPartitions("target_id", "stream", F.col("text").isNotNull())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        at, automaton, ready = None, None, False
        for whole in batches:
            out: list[tuple[str, str, str]] = []
            for target, stream, base, src, text in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                if (target, stream) != at:
                    at, automaton, ready = (target, stream), ahocorasick.Automaton(), False
                if text is None:
                    automaton.add_word(base, base)
                    continue
                if not ready:
                    automaton.make_automaton()
                    ready = True
                if len(automaton):
                    out += [(target, src, found) for found in {value for _, value in automaton.iter(text)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(3)], ["target_id", "src", "base"])

    found = rows.mapInArrow(search, "target_id string, src string, base string")
    # a text with the whole path has the base name too
    return found.join(named, ["target_id", "base"]).where("src <> dst").select("target_id", "src", "dst")


def seeds(contents: DataFrame, manifests: DataFrame) -> DataFrame:
    """Manifest entry points, and QML outside tooling."""
    entry = manifests.where("parsed").select("target_id", F.explode(F.map_values("manifest.entry_points")).alias("path"))
    clean = F.regexp_replace(F.col("path"), "\\A(\\./)+", "")
    qml = contents.where(P.is_qml(F.col("path")) & ~P.is_tooling(F.col("path"))).select("target_id", "path")
    return entry.select("target_id", clean.alias("path")).unionByName(qml).distinct()


def reachable(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(target_id, path) that ``start`` reaches over ``edges``, itself included.

    One round for each step of distance; a round joins the frontier only and keeps what is new."""
    reached = settle(start.select("target_id", "path").distinct(), "reach")
    frontier, steps = reached, edges.select("target_id", F.col("src").alias("path"), F.col("dst"))
    while not frontier.isEmpty():
        found = frontier.join(steps, ["target_id", "path"]).select("target_id", F.col("dst").alias("path")).distinct()
        frontier = settle(found.join(reached, ["target_id", "path"], "left_anti"), "frontier")
        reached = reached.unionByName(frontier)
    return reached


def with_scope(rows: DataFrame, reached: DataFrame, path: Column | str = "path") -> DataFrame:
    """``rows`` with ``scope`` by their path."""
    path = F.col(path) if isinstance(path, str) else path
    live = reached.select("target_id", F.col("path").alias("_path"), F.lit(True).alias("_live"))
    tagged = rows.withColumn("_path", path).join(live, ["target_id", "_path"], "left")
    scope = F.when(P.is_tooling(F.col("_path")), "repository-tooling").when(F.col("_live"), "runtime").otherwise("unknown")
    return tagged.withColumn("scope", scope).drop("_path", "_live")


def related_scope(rows: DataFrame, operations: DataFrame, related: str) -> DataFrame:
    """``rows`` (target_id, id, ...) with the scope that all their operations share, else unknown.

    An operation that does not exist makes it unknown; rows without operations get null."""
    scopes = operations.select("target_id", F.col("id").alias("_op"), F.col("scope").alias("_scope"))
    links = rows.select("target_id", "id", F.explode(related).alias("_op")).join(scopes, ["target_id", "_op"], "left")
    shared = links.groupBy("target_id", "id").agg(F.when((F.count("*") == F.count("_scope")) & (F.min("_scope") == F.max("_scope")), F.min("_scope")).otherwise("unknown").alias("scope"))
    return rows.join(shared, ["target_id", "id"], "left")


def scoped(rows: DataFrame, operations: DataFrame, reached: DataFrame, related: str) -> DataFrame:
    """Scope of findings and unknowns: of their operations, else of their first evidence's path."""
    by_op = related_scope(rows, operations, related).withColumnRenamed("scope", "_by_op")
    by_path = with_scope(by_op, reached, F.coalesce(F.get("evidence", F.lit(0))["path"], F.lit("")))
    return by_path.withColumn("scope", F.coalesce("_by_op", F.when(F.size("evidence") > 0, F.col("scope")), F.lit("unknown"))).drop("_by_op")
