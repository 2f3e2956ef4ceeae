"""Quality rules with host verdicts [native].

Base rules judge each document by its words. Their failures are counted by host (the ``source``
column); a host's failure rate is shrunk towards all hosts by a beta prior fitted to the hosts
themselves, and the hosts' verdicts are joined back to documents.

Defined results: a null text has no words and fails the base rules; a null host is a host of its
own; an empty table gives no rows; rows that repeat are judged each by itself and each counts for
its host; extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import SPACES, let, settle, words_of

SYMBOLS = "#*$%&|<>"
#: So many rejected hosts at most are broadcast; more meet the documents in a shuffled join.
BROADCAST_HOSTS = 10_000


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    #: Base failure where over this percentage of the words lies in repeated windows.
    max_repeat_percent: int = 50
    #: A host is rejected where its shrunken failure rate is above this.
    max_host_rate: float = 0.5
    #: Bounds of the prior's weight, in documents.
    prior_weight: tuple[float, float] = (1.0, 1e6)


def repeated_words(words: Column) -> Column:
    """How many words lie in a 3-word window that the text has twice or more.

    Windows are compared by 64-bit hash. Where no hash occurs twice, as in most short texts, the
    answer is 0 without a sort."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda e, j: ((j > 0) & (F.get(pairs, j - 1)["h"] == e["h"])) | (F.get(pairs, j + 1)["h"] == e["h"]))
        # HOF null semantics: a missing neighbour compares as null and is not kept
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    def counted(hashes: Column) -> Column:
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(some, let(pairs, covered)).otherwise(F.lit(0))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, counted)


def base_metrics(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``base``: the counts of each text and ``base_failed``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    solid = F.translate(whole, SPACES, "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    measured = docs.select(
        "*",
        let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("_w"),
        let(solid, lambda s: F.struct(F.length(s).cast("long").alias("chars"), (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("long").alias("symbols"))).alias("_s"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("_d"),
    )
    n, repeated = F.col("_w.n_words"), F.col("_w.n_repeat_words")
    return measured.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.struct(
            n.alias("n_words"),
            F.col("_s.chars").alias("word_chars"),
            F.col("_s.symbols").alias("n_symbols"),
            F.col("_d").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            ((n < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n)).alias("base_failed"),
        ).alias("base"),
    )


def host_verdicts(judged: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(host, n, failed, rate, host_ok) from rows (host, base_failed).

    The prior is the beta distribution whose mean and variance match the hosts' failure rates,
    less what binomial sampling alone would add to the variance."""
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    p = F.col("failed") / F.col("n")
    stats = hosts.agg(F.sum("failed").alias("f"), F.sum("n").alias("n"), F.avg(p).alias("m1"), F.avg(p * p).alias("m2"), F.avg(1 / F.col("n")).alias("inv")).first()  # one row
    mean = (stats["f"] or 0) / (stats["n"] or 1)
    spread = mean * (1 - mean)
    low, high = rules.prior_weight
    variance = (stats["m2"] or 0.0) - (stats["m1"] or 0.0) ** 2 - spread * (stats["inv"] or 0.0)
    weight = min(max(spread / variance - 1, low), high) if variance > 0 else high
    rate = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate <= rules.max_host_rate).alias("host_ok"))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules(), doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(doc_id, the base counts, base_failed, host_rate, kept), one row per input row.

    The texts are read once; what follows works on the settled counts. Failures are pre-aggregated
    before the shuffle by host. The join back is left to the planner: it broadcasts the hosts only
    where their measured size is small, and else splits a hot host's rows at run time."""
    base = settle(base_metrics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(host).alias("host")), rules).select("doc_id", "host", "base.*"), "quality")
    verdicts = host_verdicts(base, rules).select(F.col("host").alias("_host"), "rate", "host_ok")
    joined = base.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rate").alias("host_rate"), (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def kept_rows(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that pass their base rules and whose host does."""
    judged = settle(base_metrics(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"), F.col(host).alias("host")), rules).select("row", "host", F.col("base.base_failed").alias("base_failed")), "quality")
    rejected = settle(host_verdicts(judged.select("host", "base_failed"), rules).where("not host_ok").select(F.col("host").alias("_host")), "rejected")
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    passed = judged.where("not base_failed")
    return passed.join(rejected, F.col("host").eqNullSafe(F.col("_host")), "left_anti").select("row.*")
