"""One review row per target: impact, confidence, unknown behavior, counts, reasons and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.functions import digests as D
from lucerna.schemas import CONFIDENCES, LIMITS, SEVERITIES

_REASON = "struct<reference:string,title:string,scope:string>"


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Position in ``order``; -1 for anything else."""
    return F.coalesce(*[F.when(value == v, F.lit(i)) for i, v in enumerate(order)], F.lit(-1))


def severity_rank(value: Column) -> Column:
    return rank(value, SEVERITIES)


def urgent(reason: Column, scope: Column, affected: Column) -> Column:
    return reason.isin("budget-exhaustion", "parser-failure") | ((scope == "runtime") & (F.size(affected) > 0))


_LEVELS = ("none", "low", "moderate", "high")
#: What the tables of a target are counted by, one short row for each of their rows.
_COUNTED = "target_id string, kind string, claim string, confidence string, rung int, top int"
#: What may be a reason: the first of each key, ordered by (first, place), within (section, grade).
_SHOWN = "target_id string, section string, grade int, first int, place string, key string, reference string, title string, scope string"


def _rows(df: DataFrame, schema: str, **columns: Column | str | int | None) -> DataFrame:
    """``df`` with the columns of ``schema``, those that aren't given null."""
    named = [f.split(" ", 1) for f in schema.split(", ")]
    value = lambda c: c if isinstance(c, Column) else F.lit(c)
    return df.select("target_id", *[value(columns.get(n)).cast(t).alias(n) for n, t in named[1:]])


def _held(confidence: Column) -> Column:
    """Anything that is neither low nor medium counts as high."""
    return F.when(confidence == "low", 0).when(confidence == "medium", 1).otherwise(2)


def _top(severity: Column, held: Column) -> Column:
    """The severity's rank, then the least confidence, as one number: a maximum that is no struct lets Spark
    aggregate by hashing. Null for severities that aren't in the vocabulary."""
    grade = severity_rank(severity)
    return F.when(grade >= 0, grade * len(CONFIDENCES) + len(CONFIDENCES) - 1 - held)


def _counted(table: str, rows: DataFrame) -> DataFrame:
    runtime = F.coalesce(F.col("scope") == "runtime", F.lit(False)) if "scope" in rows.columns else F.lit(False)
    if table == "errors":
        return _rows(rows, _COUNTED, kind=table, rung=3)
    if table == "limitations":
        code = F.col("code")
        budget = code.contains("budget") | code.startswith("max-") | (code == "result-production-limit")
        return _rows(rows, _COUNTED, kind=table, rung=F.when(budget, 3).when(runtime, 2).otherwise(1))
    confidence = F.col("confidence") if "confidence" in rows.columns else F.lit(None)
    if table == "unknowns":
        rung = F.when(urgent(F.col("reason"), F.col("scope"), F.col("affected")), 3).when(runtime, 2).otherwise(1) if "reason" in rows.columns else None
        return _rows(rows, _COUNTED, kind=table, claim="unknown", confidence=confidence, rung=rung)
    if table == "findings":
        # of the findings with the highest severity the least confidence counts
        top = _top(F.col("severity"), _held(confidence)) if "severity" in rows.columns else None
        return _rows(rows, _COUNTED, kind=table, claim=F.col("claim"), confidence=confidence, top=top)
    return _rows(rows, _COUNTED, kind=table, claim="fact", confidence=confidence)


def _shown(table: str, rows: DataFrame) -> DataFrame:
    scope = F.col("scope")
    if table == "findings":
        return _rows(rows, _SHOWN, section="impact", grade=severity_rank(F.col("severity")), first=0, place=F.col("id"), key=F.col("id"), reference=D.node_reference("finding", F.col("id")), title=F.col("title"), scope=scope)
    if table == "unknowns":
        first = F.when(urgent(F.col("reason"), scope, F.col("affected")), 1).otherwise(2)
        return _rows(rows, _SHOWN, section="unknown", grade=0, first=first, place=F.col("id"), key=F.col("id"), reference=D.node_reference("unknown", F.col("id")), title=F.col("title"), scope=scope)
    if table == "limitations":
        title = F.concat(F.lit("Analysis limitation: "), F.col("code"))
        place = F.concat_ws("\x00", "code", "path", "scope", "description")
        return _rows(rows, _SHOWN, section="unknown", grade=0, first=F.when(scope == "runtime", 3).otherwise(4), place=place, key=F.concat(F.lit("title:"), title), title=title, scope=scope)
    title = F.concat(F.lit("Scan error: "), F.col("code"))
    return _rows(rows, _SHOWN, section="unknown", grade=0, first=0, place=F.concat_ws("\x00", "code", "path", "message"), key=F.concat(F.lit("title:"), title), title=title)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def counted(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per target over all ``tables`` (operations, resources, findings, unknowns, limitations,
    errors): their sizes, confidences, claims, the highest severity and the unknown level, by one
    aggregation that combines on the map side."""
    every = _union([_counted(name, rows) for name, rows in tables.items()])
    size = lambda name: F.count_if(F.col("kind") == name).cast("int")
    n = len(CONFIDENCES)
    out = (
        every.groupBy("target_id")
        .agg(
            *[F.count_if(F.col("confidence") == c).cast("int").alias(f"confidence_{c}") for c in CONFIDENCES],
            *[F.count_if(F.col("claim") == c).cast("int").alias(n) for c, n in (("fact", "facts"), ("inference", "inferences"), ("unknown", "unknown_behaviors"))],
            *[size(n).alias(n) for n in ("unknowns", "limitations", "errors")],
            F.element_at(F.array(*map(F.lit, _LEVELS)), F.max("rung") + 1).alias("unknown_level"),
            F.max("top").alias("_top"),
        )
        .withColumn("impact_level", F.get(F.array(*map(F.lit, SEVERITIES)), F.floor(F.col("_top") / n).cast("int")))
        .withColumn("evidence_confidence", F.get(F.array(*map(F.lit, CONFIDENCES)), n - 1 - F.col("_top") % n))
        .drop("_top")
    )
    if "findings" not in tables or "severity" not in tables["findings"].columns:
        return out
    # severities outside the vocabulary count where a target has no other
    odd = tables["findings"].where(severity_rank(F.col("severity")) < 0).groupBy("target_id").agg(F.max(F.struct((-_held(F.col("confidence"))).alias("held"), "severity")).alias("_odd"))
    given = {"impact_level": F.col("_odd.severity"), "evidence_confidence": F.when(F.col("_odd").isNotNull(), F.get(F.array(*map(F.lit, CONFIDENCES)), -F.col("_odd.held")))}
    known = F.col("impact_level").isNotNull()
    return out.join(odd, "target_id", "left").select(*[F.when(known, F.col(c)).otherwise(given[c]).alias(c) if c in given else c for c in out.columns])


def reasons(tables: dict[str, DataFrame]) -> DataFrame:
    """(target_id, impact_reasons, unknown_reasons). Impact: the first eight findings by id of the highest
    severity. Unknown: the first eight of errors, urgent unknowns, other unknowns, runtime limitations
    and other limitations; a reference, or a title without reference, counts once.

    Rows are dealt by target once, for both windows and the aggregation."""
    every = _union([_shown(n, tables[n]) for n in ("findings", "unknowns", "limitations", "errors") if n in tables]).repartition("target_id")
    section = W.partitionBy("target_id", "section", "grade")
    once = every.withColumn("_k", F.row_number().over(W.partitionBy("target_id", "section", "grade", "key").orderBy("first", "place"))).where("_k = 1")
    ranked = once.withColumn("n", F.row_number().over(section.orderBy("first", "place"))).where(F.col("n") <= LIMITS.reasons)
    entry = F.struct((-F.col("grade")).alias("g"), F.col("n"), F.struct("reference", "title", "scope").cast(_REASON).alias("r"))
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("section") == name, entry)))
    grouped = ranked.groupBy("target_id").agg(of("impact").alias("_i"), of("unknown").alias("_u"))
    first = F.get("_i", F.lit(0))["g"]
    return grouped.select("target_id", F.transform(F.filter("_i", lambda x: x["g"] == first), lambda x: x["r"]).alias("impact_reasons"), F.transform("_u", lambda x: x["r"]).alias("unknown_reasons"))


def impact(findings: DataFrame) -> DataFrame:
    """(target_id, impact_level, evidence_confidence, impact_reasons) from findings alone."""
    of = {"findings": findings}
    return counted(of).select("target_id", "impact_level", "evidence_confidence").join(reasons(of).select("target_id", "impact_reasons"), "target_id")


def unknown_level(unknowns: DataFrame, limitations: DataFrame, errors: DataFrame) -> DataFrame:
    """The highest rung of none, low, moderate, high that any row reaches."""
    return counted({"unknowns": unknowns, "limitations": limitations, "errors": errors}).select("target_id", "unknown_level")


def unknown_reasons(unknowns: DataFrame, limitations: DataFrame, errors: DataFrame) -> DataFrame:
    return reasons({"unknowns": unknowns, "limitations": limitations, "errors": errors}).select("target_id", "unknown_reasons")


def _main(first: Column, second: Column) -> Column:
    """Impact reasons, then unknown reasons with another reference, up to the limit."""
    fresh = F.filter(second, lambda r: r["reference"].isNull() | ~F.exists(first, lambda x: F.coalesce(x["reference"] == r["reference"], F.lit(False))))
    return F.slice(F.concat(first, fresh), 1, LIMITS.reasons)


def review(targets: DataFrame, coverage: DataFrame, operations: DataFrame, resources: DataFrame, findings: DataFrame, unknowns: DataFrame, limitations: DataFrame, errors: DataFrame) -> DataFrame:
    """One row for each of ``targets`` (target_id); empty tables give informational, none and zeros."""
    tables = {"operations": operations, "resources": resources, "findings": findings, "unknowns": unknowns, "limitations": limitations, "errors": errors}
    covered = coverage.select("target_id", F.struct(*[c for c in coverage.columns if c != "target_id"]).alias("coverage"))
    out = targets.select("target_id").distinct()
    for part in (counted(tables), reasons(tables), covered):
        out = out.join(part, "target_id", "left")
    none = F.array().cast(f"array<{_REASON}>")
    first, second = F.coalesce("impact_reasons", none), F.coalesce("unknown_reasons", none)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (*[f"confidence_{c}" for c in CONFIDENCES], "facts", "inferences", "unknown_behaviors", "unknowns", "limitations", "errors")]
    return out.select(
        "target_id",
        F.coalesce("impact_level", F.lit("informational")).alias("impact_level"),
        first.alias("impact_reasons"),
        F.coalesce("evidence_confidence", F.lit("not-applicable")).alias("evidence_confidence"),
        "coverage",
        F.coalesce("unknown_level", F.lit("none")).alias("unknown_level"),
        second.alias("unknown_reasons"),
        _main(first, second).alias("main_reasons"),
        *zero,
    )


GAP_CODE = "analysis-coverage-incomplete"


def with_gap(reviews: DataFrame) -> DataFrame:
    """``reviews`` as they are once a target that has nothing but incomplete coverage to say gets its one
    limitation, with ``status`` and ``gap``; nothing is counted again, as such a target has no other
    unknowns, limitations or errors."""
    judged = reviews.withColumn("status", status_of()).withColumn("gap", needs_limitation())
    note = F.array(F.struct(F.lit(None).cast("string").alias("reference"), F.lit(f"Analysis limitation: {GAP_CODE}").alias("title"), F.lit("unknown").alias("scope")).cast(_REASON))
    gap = F.col("gap")
    changed = {
        "unknown_level": F.when(gap, F.lit(_LEVELS[1])).otherwise(F.col("unknown_level")),
        "unknown_reasons": F.when(gap, note).otherwise(F.col("unknown_reasons")),
        "main_reasons": F.when(gap, _main(F.col("impact_reasons"), note)).otherwise(F.col("main_reasons")),
        "limitations": F.when(gap, 1).otherwise(F.col("limitations")),
    }
    return judged.select(*[changed.get(c, F.col(c)).alias(c) for c in judged.columns])


def _said() -> Column:
    return F.col("unknowns") + F.col("limitations") + F.col("errors") > 0


def _covered() -> Column:
    c = F.col("coverage")
    return F.coalesce(c["level"].isin("complete", "not-applicable") & (c["excluded_units"] == 0), F.lit(True))


def status_of() -> Column:
    """Complete only where nothing is unknown, limited, wrong or left out."""
    return F.when(_said() | ~_covered(), "incomplete").otherwise("complete")


def needs_limitation() -> Column:
    """Whether incomplete coverage is all there is to say."""
    return ~_said() & ~_covered()
