"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a seeded random order, form a stream that is cut into blocks of equal
size. One slot emits one block. At any time the sources that are not used up share the slots by their
target weights; ``F(v)``, the blocks that all have emitted by then, is the sum of min(n, q * v) over
sources of n blocks and weight q. The i-th block of a source has the release time floor(F(i / q)) and
the deadline ceil(F((i + 1) / q)), and the released block with the earliest deadline goes first. All
slots up to the last are used, so every block meets its window and each source stays within one block
of its exact share at every slot, also where others run out.

Weights are made whole numbers of the same proportions, so no window goes beyond a whole ``v``, and
what lies between two is one period. Periods of the same sources repeat, so only one of each phase is scheduled, whatever the
corpus: a phase lasts until a source has less than a period's blocks left; a period in which sources
run out follows, and the next phase goes on without them. All documents are kept, each once.

Defined results: a source of weight 0 follows when all others ran out, with others of weight 0 by
their default weights; a negative weight is an error; a null source and an empty one are one source; a null or empty text has size 1; a
null doc_id is ordered like any value; rows that repeat are placed each; an empty table gives no
rows; the number of sources is not limited.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536
#: Default weights are whole parts of so many, or of ``LEAST_PARTS`` a source where that is more.
RESOLUTION = 1_000
LEAST_PARTS = 100
#: Weights that have no common denominator up to this are rounded to whole parts of so many.
MOST_PARTS = 100_000
#: A plan of so many rows at most is broadcast.
BROADCAST_PLAN = 100_000
#: Without target weights, a source weighs its size to this power.
ALPHA = 0.5


def windows(quotas: Mapping[str, int], parts: Mapping[str, int]) -> dict[str, tuple[list[int], list[int]]]:
    """(releases, deadlines) of each source's ``quotas`` blocks in a period; where a source has less
    than its ``parts``, the others share the rest of the period by theirs."""
    ends = sorted((quotas[s] / parts[s], s) for s in quotas)
    until = [v for v, _ in ends]
    done = [0, *accumulate(quotas[s] for _, s in ends)]
    gone = [0, *accumulate(parts[s] for _, s in ends)]

    def emitted(i: int, q: int) -> tuple[int, int]:
        """Floor and ceiling of F(i / q); F is continuous, so a tie may take either side."""
        at = min(bisect_left(until, i / q), len(until) - 1)
        whole, rest = divmod((gone[-1] - gone[at]) * i, q)
        return done[at] + whole, done[at] + whole + (rest > 0)

    out = {}
    for s, n in quotas.items():
        edges = [emitted(i, parts[s]) for i in range(n + 1)]
        out[s] = [x for x, _ in edges[:-1]], [x for _, x in edges[1:]]
    return out


def scheduled(quotas: Mapping[str, int], opens: Mapping[str, tuple[list[int], list[int]]]) -> dict[str, list[int]]:
    """Earliest deadline first within the windows ``opens``: the slots of each source's blocks."""
    slots: dict[str, list[int]] = {s: [] for s in quotas}
    coming = [(0, s) for s in sorted(quotas) if quotas[s]]  # (release, source) of each next block
    heapq.heapify(coming)
    ready: list[tuple[int, str]] = []
    for now in range(sum(quotas.values())):
        while coming and coming[0][0] <= now:
            _, s = heapq.heappop(coming)
            heapq.heappush(ready, (opens[s][1][len(slots[s])], s))
        deadline, s = heapq.heappop(ready)
        if deadline <= now:
            raise AssertionError("a block missed its deadline")
        slots[s].append(now)
        if len(slots[s]) < quotas[s]:
            heapq.heappush(coming, (opens[s][0][len(slots[s])], s))
    return slots


def period(quotas: Mapping[str, int], parts: Mapping[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source's blocks in one period; without ``parts`` no source runs out."""
    return scheduled(quotas, windows(quotas, parts or quotas))


def whole_parts(shares: Mapping[str, Fraction | float], most: int = MOST_PARTS) -> dict[str, int]:
    """The least whole numbers in exactly the proportions of ``shares``, all positive. Where they would
    sum up to more than ``most``, whole parts of ``most`` instead, one at least."""
    exact = {s: w if isinstance(w, Fraction) else Fraction(str(w)) for s, w in shares.items()}
    if not exact:
        return {}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    parts = {s: int(w * scale) for s, w in exact.items()}
    common = math.gcd(*parts.values())
    total = sum(parts.values())
    if total // common <= max(most, LEAST_PARTS * len(parts)):
        return {s: n // common for s, n in parts.items()}
    return {s: max(1, round(Fraction(most * n, total))) for s, n in parts.items()}


def phases(blocks: Mapping[str, int], parts: Mapping[str, int], now: int = 0) -> list[tuple[str, int, int, int, int, int, list[int], list[int], list[int]]]:
    """(source, first block, end block, quota, first slot, period length, slots, releases, deadlines
    in a period) from the slot ``now`` on."""
    left, used, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), []
    while left:
        whole = min(left[s] // parts[s] for s in left)
        for quotas, times in (({s: parts[s] for s in left}, whole), ({s: min(parts[s], left[s] - whole * parts[s]) for s in left}, 1)):
            quotas = {s: q for s, q in quotas.items() if q}
            if not times or not quotas:
                continue
            length = sum(quotas.values())
            opens = windows(quotas, parts)
            for s, slots in scheduled(quotas, opens).items():
                out.append((s, used[s], used[s] + times * quotas[s], quotas[s], now, length, slots, *opens[s]))
                used[s] += times * quotas[s]
            now += times * length
        left = {s: blocks[s] - used[s] for s in left if blocks[s] > used[s]}
    return out


def mixing(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    block: int = BLOCK,
    seed: int = 42,
    salts: int = 64,
    rows_per_salt: int = 20_000,
    resolution: int = RESOLUTION,
    alpha: float = ALPHA,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """(row, source, size, block, slot, release, deadline, position); ``row`` has the input's columns
    (or those to ``carry``; a text that is not carried is not shuffled).

    ``weights`` may leave sources out; those share what their default weights give them. Sorting by
    ``position`` gives the mixture. Where a document starts in its source's stream is a prefix sum:
    running sums within (source, salt) plus the sums of the salts before, so that a source with a
    third of all rows has many tasks."""
    spark = docs.sparkSession
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.greatest(F.coalesce(F.length(text), F.lit(1)), F.lit(1)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id)).alias("draw"),
        F.col(doc_id).alias("id"),
    )
    # one row a source; no number of sources is too many
    summed = whole.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).toArrow().to_pydict()
    totals = {s: (n, size) for s, n, size in zip(summed["source"], summed["n"], summed["size"], strict=True)}
    own = {s: size**alpha for s, (_, size) in totals.items()}
    given = dict(weights or {})
    if any(w < 0 for w in given.values()):
        raise ValueError("weights must not be negative")
    resolution = max(resolution, LEAST_PARTS * len(totals))

    def by_size(sources: list[str]) -> dict[str, Fraction]:
        every = sum(own.values()) or 1.0
        return {s: Fraction(max(1, round(resolution * own[s] / every)), resolution) for s in sources}

    shares = by_size([s for s in totals if s not in given]) | {s: Fraction(str(given[s])) for s in totals if given.get(s)}
    blocks_of = {s: -(-size // block) for s, (_, size) in totals.items()}
    planned = phases({s: blocks_of[s] for s in shares}, whole_parts(shares))
    last = by_size([s for s in totals if s not in shares])  # weight 0
    planned += phases({s: blocks_of[s] for s in last}, whole_parts(last), sum(blocks_of[s] for s in shares))
    # for each source at most two rows a phase, whatever the corpus; a phase ends with a source
    kinds = {"source": pa.string(), "low": pa.int64(), "high": pa.int64(), "quota": pa.int64(), "base": pa.int64(), "length": pa.int64()} | dict.fromkeys(("slots", "releases", "deadlines"), pa.list_(pa.int32()))
    plan = spark.createDataFrame(pa.table([pa.array([r[i] for r in planned], t) for i, t in enumerate(kinds.values())], names=list(kinds))).withColumnRenamed("source", "of")
    if len(planned) <= BROADCAST_PLAN:
        plan = F.broadcast(plan)

    n = max(salts, -(-max((k for k, _ in totals.values()), default=0) // rows_per_salt))
    salted = whole.withColumn("salt", F.floor((F.col("draw").cast("double") / 2.0**64 + 0.5) * n).cast("int"))
    before = salted.groupBy("source", "salt").agg(F.sum("size").alias("sum"))
    before = before.select("source", "salt", (F.sum("sum").over(W.partitionBy("source").orderBy("salt")) - F.col("sum")).alias("before"))
    running = W.partitionBy("source", "salt").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    started = salted.withColumn("within", F.coalesce(F.sum("size").over(running), F.lit(0))).join(before, ["source", "salt"])
    blocks = started.withColumn("start", F.col("before") + F.col("within")).withColumn("block", F.floor(F.col("start") / block))
    placed = blocks.join(plan, (F.col("source") == F.col("of")) & (F.col("block") >= F.col("low")) & (F.col("block") < F.col("high")))
    nth = F.col("block") - F.col("low")
    turn, k = F.floor(nth / F.col("quota")), nth % F.col("quota")
    at = F.col("base") + turn * F.col("length")
    slot = at + F.get("slots", k.cast("int"))
    return placed.select(
        "row",
        "source",
        "size",
        "block",
        slot.alias("slot"),
        (at + F.get("releases", k.cast("int"))).alias("release"),
        (at + F.get("deadlines", k.cast("int"))).alias("deadline"),
        (slot * block + F.col("start") % block).alias("position"),
    )
