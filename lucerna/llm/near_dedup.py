"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Texts are sets of five-word shingles with TF-IDF weights. Improved consistent weighted sampling
draws samples that agree with the probability of the weighted Jaccard similarity; bands of samples
put similar texts into common buckets, and the exact weighted Jaccard similarity decides each link.
Classes are the connected components of the links.

A bucket is never expanded into all its pairs. Its least member leads and is compared with the
others; what is linked to the leader is one class. Buckets that still have several classes get new
leaders in turns, drawn by a hash, which are compared with the members of other classes only, as long
as enough of these comparisons link classes. Left are pairs with a member outside its bucket's largest
class. The members of all buckets with such a one, large or small, go through an exact prefix filter: two texts can reach the threshold only if they share a shingle among the rarest of each that
make up more than the rest of its weight. Most texts that are apart from the others have so much of
their own that they share none.

Defined results: equal texts are one class; a text without words is a class of its own; a text of
fewer than five words has one shingle; a null doc_id is ordered last; an empty table gives no rows;
extra columns are ignored. Texts are told apart by two hashes, never by doc_id, which only chooses
what stands for a class: rows with a null doc_id, or different texts under one doc_id, are documents
of their own, and rows with the same doc_id and text are one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import LAST_ID, SPACES, settle
from lucerna.llm.components import components
from lucerna.llm.shingles import COUNTERS, RARITY, Weighted, Words, chunks, counter_of, mix, shingle_hashes, weighted, word_rarity, words


@dataclass(frozen=True)
class NearDedup:
    similarity: float = 0.8
    width: int = 5
    #: At a similarity of 0.8, 20 bands of 4 samples miss a pair with a probability of 0.00003.
    bands: int = 20
    rows: int = 4
    seed: int = 7
    #: How far rarity spreads the weights: they are counts times a factor from 1 - ``rarity`` to 1.
    rarity: float = RARITY
    #: A bucket's members are counted in so many parts before they are counted as one.
    parts: int = 16
    #: So many shingles before it tell a common shingle that the pair had an earlier one.
    window: int = 8
    #: Buckets get new leaders as long as this share of the comparisons with the last ones were links.
    worth: float = 0.02


@lru_cache(maxsize=2)
def randoms(samples: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), and beta ~ U(0, 1), a row of ``samples``
    each. A shingle takes its three rows by three separate parts of its hash."""
    g = np.random.default_rng(seed)
    shape = (1 << 14, samples)
    return tuple(x.astype(np.float32) for x in (g.gamma(2.0, size=shape), np.log(g.gamma(2.0, size=shape)), g.random(shape)))


def icws(w: Weighted, samples: int, seed: int, block: int = 8192) -> np.ndarray:
    """(texts x samples) hashes of the samples (shingle, level); texts without shingles get 0."""
    gamma, log_c, beta = randoms(samples, seed)
    out = np.zeros((len(w.bounds) - 1, samples), np.uint64)
    part = [((w.hashes >> np.uint64(s)) & np.uint64((1 << 14) - 1)).astype(np.int64) for s in (0, 14, 28)]
    log_w = np.log(w.weights)
    for text in range(len(out)):
        a, b = int(w.bounds[text]), int(w.bounds[text + 1])
        best = np.full(samples, np.inf, np.float32)
        for i in range(a, b, block):
            j = min(i + block, b)
            r, shift = gamma[part[0][i:j]], beta[part[2][i:j]]
            level = np.floor(log_w[i:j, None] / r + shift)
            value = log_c[part[1][i:j]] - r * (level - shift) - r
            at = value.argmin(axis=0)
            low = value[at, np.arange(samples)]
            drawn = mix(w.hashes[i + at] + level[at, np.arange(samples)].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            better = low < best
            out[text, better], best[better] = drawn[better], low[better]
    return out


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.zeros((len(samples), bands), np.uint64)
    for k in range(rows):
        total = mix(total * np.uint64(0x9FB21C651E98DF25) + samples[:, k::rows][:, :bands])
    return mix(total + np.arange(bands, dtype=np.uint64))


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' (sorted hashes, weights)."""
    at = np.searchsorted(a[0], b[0])
    held = at < len(a[0])
    held[held] = a[0][at[held]] == b[0][held]
    both = float(np.minimum(a[1][at[held]], b[1][held]).sum())
    union = float(a[1].sum() + b[1].sum()) - both
    return both / union if union else 0.0


def hashed_counts(docs: DataFrame, hashes, text: str = "text") -> np.ndarray:
    """In how many texts each counter's items are; a fixed number of counters for any corpus.

    ``hashes``: words of some texts -> (texts, item hashes)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, data, offsets in chunks(b.column(0)):
                of, items = hashes(words(data, offsets))
                counter = counter_of(items)
                total += np.bincount((np.unique((of.astype(np.uint64) << np.uint64(20)) | counter) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        held = np.flatnonzero(total)
        for i in range(0, len(held), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(held[i : i + 65_536], pa.int32()), pa.array(total[held[i : i + 65_536]])], ["counter", "n"])

    counted = docs.select(F.col(text)).mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS)
    out[counted["counter"].to_numpy()] = counted["n"].to_numpy()
    return out


def word_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    return hashed_counts(docs, lambda w: (np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds)), w.hashes), text)


def shingle_counts(docs: DataFrame, width: int, text: str = "text") -> np.ndarray:
    def items(w: Words) -> tuple[np.ndarray, np.ndarray]:
        hashes, of, _ = shingle_hashes(w, width)
        return of, hashes

    return hashed_counts(docs, items, text)


def signatures(docs: DataFrame, rarity, p: NearDedup) -> DataFrame:
    """(id, a, b, bands): two hashes of the whole text, and its band hashes (none without words)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, data, offsets in chunks(batch.column(3)):
                w = weighted(words(data, offsets), rarity.value, p.width, p.rarity)
                hashes = band_hashes(icws(w, p.bands * p.rows, p.seed), p.bands, p.rows).view(np.int64)
                full = np.diff(w.bounds) > 0
                sizes = np.where(full, p.bands, 0)
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(hashes[full].ravel())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int64()))], ["id", "a", "b", "bands"])

    return docs.select("id", "a", "b", "text").mapInArrow(sign, "id long, a long, b long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, rarity, p: NearDedup) -> DataFrame:
    """(u, v, s) of candidate pairs: the exact weighted Jaccard similarity of their whole texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            sides: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
            for side, column in zip(sides, (2, 3), strict=True):
                for _, data, offsets in chunks(batch.column(column)):
                    w = weighted(words(data, offsets), rarity.value, p.width, p.rarity)
                    for i in range(len(w.bounds) - 1):
                        part = slice(w.bounds[i], w.bounds[i + 1])
                        order = np.argsort(w.hashes[part])
                        side.append((w.hashes[part][order], w.weights[part][order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([jaccard(x, y) for x, y in zip(*sides, strict=True)], pa.float64())], ["u", "v", "s"])

    of_v = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    of_u = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    return pairs.select("u", "v").join(of_v, "v").join(of_u, "u").select("u", "v", "text_u", "text_v").mapInArrow(compare, "u long, v long, s double")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, a, b, text): the sortable id and two independent hashes of the whole text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("text"), whole).alias("b"), whole.alias("text"))


def prefixes(texts: DataFrame, rarity, p: NearDedup) -> DataFrame:
    """(id, h, before, all, earlier): each text's rarest shingles, by frequency among ``texts``, that weigh together
    just more than what two texts of the threshold's similarity may not share, with the weight of rarer
    ones, the text's whole weight and the nearest shingles before it; those of no other text left out.

    Any order that is one for all texts serves the filter. Hashed counters give it: they can only
    make a shingle look more frequent than it is, which leaves nothing out."""
    counted = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, p.width).astype(np.int32))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, data, offsets in chunks(batch.column(1)):
                w = weighted(words(data, offsets), rarity.value, p.width, p.rarity)
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
                df = counted.value[counter_of(w.hashes).astype(np.int64)]
                order = np.lexsort((w.hashes, df, of))
                weight = w.weights[order].astype(np.float64)
                summed = np.concatenate([[0.0], np.cumsum(weight)])
                before = summed[:-1] - summed[w.bounds[:-1]][of]
                whole = (summed[w.bounds[1:]] - summed[w.bounds[:-1]])[of]
                kept = (before <= (1 - p.similarity) * whole + 1e-6) & (df[order] > 1)
                mine, hashes, row = of[kept], w.hashes[order][kept].view(np.int64), np.arange(int(kept.sum()))
                sizes = np.minimum(row - np.searchsorted(mine, mine), p.window)
                ends = np.cumsum(sizes)
                nearest = hashes[np.repeat(row - ends, sizes) + np.arange(int(sizes.sum()))]
                earlier = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(nearest))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + mine]), pa.array(hashes), pa.array(before[kept]), pa.array(whole[kept]), earlier], ["id", "h", "before", "all", "earlier"])

    return texts.select("id", "text").mapInArrow(pick, "id long, h long, before double, all double, earlier array<long>")


def led_in_turns(live: DataFrame, texts: DataFrame, known: DataFrame, rarity, p: NearDedup) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(known, roots, apart): similarities with all leaders so far, (node, root) by their links, and
    (band, id) of a bucket's members outside its largest class."""
    enough = F.col("s") >= p.similarity - 1e-9
    share = 1.0
    for turn in itertools.count(1):
        roots = components(known.where(enough))
        named = live.select("band", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        rooted = settle(named.withColumn("root", F.coalesce("root", "id")), "rooted")
        drawn = F.min(F.struct(F.xxhash64("id", "band", F.lit(turn)), "id")).alias("lead")
        parts = rooted.groupBy("band", "root", F.pmod(F.spark_partition_id(), F.lit(p.parts))).agg(F.count("*").alias("n"), drawn)
        by_root = parts.groupBy("band", "root").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"))
        several = by_root.groupBy("band").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"), F.min(F.struct("lead", "root")).alias("next")).where("roots > 1")
        several = settle(several.select("band", F.col("most.root").alias("most"), F.col("next.lead.id").alias("lead"), F.col("next.root").alias("lead_root")), "several")
        inside = rooted.join(several, "band")
        if share >= p.worth:
            pairs = inside.where("root <> lead_root").select(F.least("lead", "id").alias("u"), F.greatest("lead", "id").alias("v")).distinct()
            fresh = settle(similarities(pairs.join(known.select("u", "v"), ["u", "v"], "left_anti"), texts, rarity, p), "similar")
            n, near = fresh.agg(F.count("*"), F.count_if(enough)).first()
            known = known.unionByName(fresh)
            share = near / n if n else 0.0
            if near:
                continue
        return known, roots, settle(inside.where("root <> most").select("band", "id"), "apart")


def links(bands: DataFrame, texts: DataFrame, rarity, p: NearDedup) -> DataFrame:
    """(u, v, s) of links between different texts that make up all classes, from (band, id, doc) rows."""
    # settled before it is joined: only a join of two plain shuffles can split a hot bucket's partition
    # counted by groups of map tasks first: a bucket that all tasks hold then gives a few rows, not one a task
    counted = bands.groupBy("band", F.pmod(F.spark_partition_id(), F.lit(p.parts)).alias("part")).agg(F.min("id").alias("lead"), F.count("*").alias("n"))
    sizes = settle(counted.groupBy("band").agg(F.min("lead").alias("lead"), F.sum("n").alias("n")).where("n > 1").select("band", "lead"), "sizes")
    live = settle(bands.join(sizes, "band"), "buckets")  # (band, id, doc, lead)
    # whole texts are shuffled once, by a join that takes any number of candidates; repeated rows then
    # lie side by side
    texts = settle(texts.join(live.select("id", "doc").distinct().hint("shuffle_merge"), ["id", "doc"]).dropDuplicates(["id", "doc"]).drop("doc"), "candidates")
    enough = F.col("s") >= p.similarity - 1e-9
    led = live.where("id <> lead").select(F.least("lead", "id").alias("u"), F.greatest("lead", "id").alias("v")).distinct()
    known = settle(similarities(led, texts, rarity, p), "similar")
    known, roots, apart = led_in_turns(live, texts, known, rarity, p)

    crowd = live.join(apart.select("band").distinct(), "band").select("id").distinct()
    rare = settle(prefixes(settle(texts.join(crowd, "id"), "crowd"), rarity, p), "prefixes")
    named = rare.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    probe = named.join(apart.select("id").distinct(), "id", "left_semi")
    side = lambda rows, x: rows.select("h", F.col("id").alias(x), F.col("root").alias(f"root_{x}"), F.col("earlier").alias(f"earlier_{x}"), F.col("all").alias(f"all_{x}"), (F.col("all") - F.col("before")).alias(f"most_{x}"))
    # texts whose first common shingle stands so far down in either order share less than the threshold
    # takes; further common shingles stand further down, so the test is exact on every one of them. A pair's
    # first common shingle has no other before it and gives the pair; of the rest, most have one in reach
    need = p.similarity / (1 + p.similarity) * (F.col("all_u") + F.col("all_v")) - 1e-6
    u, v = side(probe, "u"), side(named, "v")
    sharing = u.join(v, (u["h"] == v["h"]) & (F.col("root_u") != F.col("root_v")) & (F.least("most_u", "most_v") >= need) & ~F.arrays_overlap("earlier_u", "earlier_v"))
    pairs = sharing.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    root_u = roots.select(F.col("node").alias("u"), F.col("root").alias("root_u"))
    root_v = roots.select(F.col("node").alias("v"), F.col("root").alias("root_v"))
    open_ = pairs.join(root_u, "u", "left").join(root_v, "v", "left").where("root_u is null or root_v is null or root_u <> root_v").select("u", "v").join(known.select("u", "v"), ["u", "v"], "left_anti")
    more = similarities(open_, texts, rarity, p)
    return known.where(enough).unionByName(more.where(enough))


def classes(docs: DataFrame, p: NearDedup = NearDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b, head) of every input row; ``head`` is the least (id, a, b) of the class."""
    spark = docs.sparkSession
    whole = keyed(docs, doc_id, text)
    rarity = spark.sparkContext.broadcast(word_rarity(word_counts(whole), max(docs.count(), 1)))
    signed = settle(signatures(whole, rarity, p), "signatures")
    # one document stands for equal texts; its id is the least
    stands = settle(signed.where(F.size("bands") > 0).groupBy("a", "b").agg(F.min("id").alias("id"), F.first("bands").alias("bands")).withColumn("node", F.col("a")), "texts")
    # nodes are texts, by their hash; ``doc`` finds the row that stands for equal ones
    bands = stands.select(F.col("node").alias("id"), F.col("id").alias("doc"), F.explode("bands").alias("band"))
    texts = whole.select(F.col("a").alias("id"), F.col("id").alias("doc"), "text")
    linked = links(bands, texts, rarity, p)
    roots = settle(components(linked.select("u", "v")), "roots")
    rooted = stands.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = rooted.groupBy("root").agg(F.min(F.struct("id", "a", "b")).alias("head"))
    named = rooted.join(heads, "root").select("a", "b", "head")
    return signed.select("id", "a", "b").join(named, ["a", "b"], "left").withColumn("head", F.coalesce("head", F.struct("id", "a", "b")))


def near_dedup(docs: DataFrame, p: NearDedup = NearDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, keep), one row per input row; one document of each class has ``keep``.

    ``class_id`` is the least doc_id of the class; a class of null ones only has a negative number made
    from its texts."""
    unnamed = -F.shiftrightunsigned("head.a", 1) - 1
    class_id = F.when(F.col("head.id") == LAST_ID, unnamed).otherwise(F.col("head.id"))
    return classes(docs, p, doc_id, text).select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), class_id.alias("class_id"), (F.struct("id", "a", "b") == F.col("head")).alias("keep"))


def keep_one(docs: DataFrame, p: NearDedup = NearDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that stand for their class; of repeated rows, one."""
    gone = classes(docs, p, doc_id, text).where(F.struct("id", "a", "b") != F.col("head")).select("id", "a", "b")
    whole = F.coalesce(F.col(text), F.lit(""))
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(whole).alias("a"), F.xxhash64(F.lit("text"), whole).alias("b"), (F.btrim(whole, F.lit(SPACES)) == "").alias("bare"))
    stay = tagged.join(gone, ["id", "a", "b"], "left_anti")
    once = stay.where("not bare").dropDuplicates(["id", "a", "b"])
    return once.unionByName(stay.where("bare")).select("row.*")
