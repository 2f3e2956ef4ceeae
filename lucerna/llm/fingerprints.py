"""I-Match document fingerprints [native].

A document's terms are its lower-cased runs of letters and digits. The terms within a band of
inverse document frequency form the lexicon; a document keeps its distinct lexicon terms, sorted,
and hashes those that fall into each of several randomised lexicon subsets of falling size. Two
documents are alike by the share of subsets whose hashes agree.

Defined results: a null or empty text has no terms, and its fingerprint is all ``-``; a text without
lexicon terms keeps all its terms; a null doc_id comes first in descending order; rows that share a
doc_id follow one another by text hash; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm.common import LAST_ID, let, settle

#: Sizes of the lexicon subsets: a subset of n bits keeps the terms whose hash is 0 in n bits of its
#: own, a share 2 ** -n. Texts of any length thus have subsets that hold only a few of their terms,
#: which is where a partial edit can leave a hash as it was. The first subset is the whole lexicon.
#: The rows take their bits from independent hashes, no bit twice.
SUBSET_BITS = ((0, 5, 5, 5, 6, 6, 6, 6, 6, 7, 8), (7, 7, 7, 7, 8, 8, 8, 9), (3, 4, 4, 9, 10, 10, 10, 11))


@dataclass(frozen=True)
class IMatch:
    #: Lexicon: terms with this inverse document frequency, ln(documents / documents with the term).
    #: The upper end bounds the lexicon's size whatever the corpus: terms in a share f of all
    #: documents or more are at most (mean distinct terms of a document) / f; here f is 0.001.
    idf_band: tuple[float, float] = (1.6, 6.9)
    #: Ids are dealt into so many buckets a shuffle partition, by quantiles; their list is a literal.
    buckets: int = 8
    #: The rows of an id that fills whole buckets are dealt into 2 ** bits buckets more, by text hash.
    heavy_bits: int = 10


def terms_of(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.array_remove(F.array_distinct(words), "")


def lexicon(docs: DataFrame, p: IMatch = IMatch(), text: str = "text") -> list[int]:
    """Hashes of the terms in the band; document frequencies are over all of ``docs``.

    Counts are combined on the map side. The list is small by the bound on ``IMatch.idf_band``."""
    n = docs.count()
    low, high = n * math.exp(-p.idf_band[1]), n * math.exp(-p.idf_band[0])
    df = docs.select(F.explode(F.transform(terms_of(F.col(text)), lambda t: F.xxhash64(t))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return sorted(r["h"] for r in df.where(F.col("df").between(low, high)).select("h").toLocalIterator())


def lexicon_test(hashes: list[int]):
    """A function Column -> Column that tells whether a term hash is in the lexicon.

    The lexicon is a literal hash table, an array of short arrays."""
    size = 1 << max(0, (len(hashes) - 1).bit_length())
    slots: list[list[int]] = [[] for _ in range(size)]
    for h in hashes:
        slots[h % size].append(h)
    held = F.from_json(F.lit(json.dumps(slots, separators=(",", ":"))), "array<array<bigint>>")
    return lambda h: F.array_contains(F.get(held, F.pmod(h, F.lit(size)).cast("int")), h)


def fingerprint(text: Column, in_lexicon) -> Column:
    """``hash:hash:...``, one for each subset; ``-`` where a subset has none of the text's terms."""

    def subsets(hashes: Column, bits: tuple[int, ...]) -> list[Column]:
        def kept(first: int, n: int) -> Column:
            mask = F.lit(((1 << n) - 1) << first)
            return F.filter(hashes, lambda h: h.bitwiseAND(mask) == 0) if n else hashes

        return [let(kept(sum(bits[:k]), n), lambda s: F.when(F.size(s) == 0, F.lit("-")).otherwise(F.lower(F.hex(F.xxhash64(s))))) for k, n in enumerate(bits)]

    def signed(hashes: Column, rows: tuple[tuple[int, ...], ...] = SUBSET_BITS) -> Column:
        own = subsets(hashes, rows[0])
        if len(rows) > 1:
            own.append(let(F.transform(hashes, lambda h: F.xxhash64(h)), lambda again: signed(again, rows[1:])))
        return F.concat_ws(":", *own)

    def banded(terms: Column) -> Column:
        own = F.filter(terms, lambda t: in_lexicon(F.xxhash64(t)))
        return let(own, lambda o: F.transform(F.array_sort(F.when(F.size(o) == 0, terms).otherwise(o)), lambda t: F.xxhash64(t)))

    return let(let(terms_of(text), banded), lambda hashes: signed(hashes))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints; else the agreeing share of the subsets that either text fills."""
    pairs = F.zip_with(F.split(a, ":"), F.split(b, ":"), lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    def share(z: Column) -> Column:
        filled = F.size(F.filter(z, lambda e: (e["x"] != "-") | (e["y"] != "-")))
        same = F.size(F.filter(z, lambda e: (e["x"] != "-") & (e["x"] == e["y"])))
        return F.when(filled == 0, 0.0).otherwise(same / filled)

    return F.when(a == b, 1.0).otherwise(let(pairs, share))


def successors(ids: DataFrame, column: str) -> DataFrame:
    """(column, next): each distinct value with the next lower one; the lowest with the highest.

    Range partitions give the order; only one row a partition meets in a single task."""
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = settle(ids.select(column).distinct().repartitionByRange(parts, F.col(column).desc()).withColumn("part", F.spark_partition_id()), "order")
    within = ordered.withColumn("next", F.lead(column).over(W.partitionBy("part").orderBy(F.col(column).desc())))
    heads = ordered.groupBy("part").agg(F.max(column).alias("head"))
    every = W.orderBy("part")  # one row for each partition
    onward = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("over"))
    return within.join(onward, "part").select(column, F.coalesce("next", "over").alias("next"))


def bucket_of(docs: DataFrame, id_: str, hash_: str, p: IMatch) -> Column:
    """A number for each row that falls with the id and, for one id, rises with the text hash; buckets hold
    about as many rows each, wherever the ids lie and however many rows share one."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * p.buckets)
    # one number a bucket; approximate quantiles do, as any bounds give the same result
    cuts = docs.select(F.col(id_).alias("id")).agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10 * n)).first()[0] or [] if n > 1 else []
    heavy = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    bounds = sorted(set(cuts) | set(heavy) | {h + 1 for h in heavy if h < LAST_ID})
    place = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b <= F.col(id_))).cast("long")
    fine = F.shiftrightunsigned(F.col(hash_).bitwiseXOR(F.lit(-(2**63))), 64 - p.heavy_bits)
    return place * (1 << p.heavy_bits) + F.when(F.col(id_).isin(*heavy), (1 << p.heavy_bits) - 1 - fine).otherwise(0) if heavy else place


def with_next(docs: DataFrame, columns: list[str], p: IMatch = IMatch()) -> DataFrame:
    """``docs`` (id, text, ...) with ``next``: a struct of ``columns`` of the next document, by descending
    id, the rows of one id by text hash.

    Whole rows are shuffled once, by bucket of ids. The last document of a bucket needs the first of
    the next bucket that has any; only those first rows, one a bucket, move again."""
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    bucket = bucket_of(docs.select("id", F.lit(0).alias("hash")), "id", "hash", p)
    dealt = hashed.withColumn("bucket", bucket).repartition("bucket")
    down = W.partitionBy("bucket").orderBy(F.col("id").desc(), "hash")
    placed = dealt.withColumn("own", F.struct(*columns)).withColumn("nth", F.row_number().over(down)).withColumn("following", F.lead("own").over(down))
    step = successors(hashed.select(bucket.alias("bucket")), "bucket").select(F.col("next").alias("bucket"), F.col("bucket").alias("before"))
    heads = placed.where("nth = 1").join(step, "bucket").select(F.col("before").alias("bucket"), F.col("own").alias("head"))
    return placed.join(heads, "bucket", "left").withColumn("next", F.coalesce("following", "head")).drop("bucket", "hash", "own", "nth", "following", "head")


def fingerprints(docs: DataFrame, p: IMatch = IMatch(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, fingerprint), one row per input row."""
    inside = lexicon_test(lexicon(docs, p, text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), fingerprint(F.col(text), inside).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, p: IMatch = IMatch(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of an edited text and that of the next document.

    The edit replaces the last third of the code points by the first as many of the next document."""
    inside = lexicon_test(lexicon(docs, p, text))
    own = docs.select(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), fingerprint(F.col(text), inside).alias("fingerprint"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    both = with_next(own, ["text", "fingerprint"], p).select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 3)))"), F.substring("next.text", F.lit(1), cut)).alias("edited"))
    signed = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), inside).alias("edited_fingerprint"), "next_fingerprint")
    return signed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
