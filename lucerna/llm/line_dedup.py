"""Line dedup across documents [native].

Line keys are hashed, range-partitioned by (hash, salt) and sorted within partitions by document
and position; a window that follows that order streams the first occurrence of every key. The
result is a run-length bitmap of kept lines per document, not text.

Defined results: a null or empty text is one empty line; a null doc_id counts as one document after
all others; rows that repeat get the same bitmap; two texts under one doc_id count as one document
for "found in two documents" and get a bitmap each; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm.common import LAST_ID, SPACES, let, settle

#: A-Z lower-cased, nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def identified(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, body, text): the sortable id, and a hash that tells texts under one id apart."""
    return docs.select(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))


def dropped_lines(docs: DataFrame, min_chars: int = 10, salts: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, body, pos) of every line that another document holds first.

    A line's key is two 64-bit hashes of different seeds. A key that a third of all documents hold
    is spread over ``salts`` ranges: first occurrences are streamed per (key, salt), at most
    ``salts`` of them meet per key, and the verdict returns to the (key, salt) ranges."""
    keyed = F.transform(lines_of(F.col("text")), line_key)
    # settled, as three branches read it: texts are split and hashed once
    lines = settle(
        identified(docs, doc_id, text)
        .select("id", "body", F.posexplode(keyed).alias("pos", "key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit("line"), "key").alias("g"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"), "id", "body", "pos"),
        "lines",
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, "h", "g", "salt").sortWithinPartitions("h", "g", "salt", "id", "pos")
    streamed = W.partitionBy("h", "g", "salt").orderBy("id", "pos")
    first = ranged.withColumn("nth", F.row_number().over(streamed)).where("nth = 1").select("h", "g", "salt", "id")
    # last id per (key, salt): with the first, it tells whether two documents hold the key
    ends = lines.groupBy("h", "g", "salt").agg(F.max("id").alias("last"))
    over_salts = W.partitionBy("h", "g")
    verdict = (
        first.join(ends, ["h", "g", "salt"])
        .select("h", "g", "salt", F.min("id").over(over_salts).alias("holder"), F.max("last").over(over_salts).alias("last"))
        .where("last > holder")
        .select("h", "g", "salt", "holder")
    )
    return lines.join(verdict, ["h", "g", "salt"]).where("id <> holder").select("id", "body", "pos")


def keep_edges(n_lines: Column, dropped: Column) -> Column:
    """[0, s1, e1, s2, e2, ..., n_lines]: the lines in [0, s1), [e1, s2), ... are kept.

    ``dropped``: sorted distinct positions, or null for none."""
    starts = F.filter(dropped, lambda p, j: (j == 0) | (F.get(dropped, j - 1) != p - 1))
    ends = F.filter(dropped, lambda p, j: (j == F.size(dropped) - 1) | (F.get(dropped, j + 1) != p + 1))
    inner = F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(a, b + 1)))
    return F.when(dropped.isNull(), F.array(F.lit(0), n_lines)).otherwise(F.concat(F.array(F.lit(0)), inner, F.array(n_lines)))


def keep_runs(edges: Column) -> Column:
    """The run-length bitmap: lengths of alternating runs, kept lines first; their sum is n_lines."""
    return F.transform(F.slice(edges, 2, F.size(edges) - 1), lambda e, j: e - F.get(edges, j))


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the lines that the bitmap ``runs`` drops: the bitmap is unrolled to one flag a
    line, and the flagged lines are joined again."""
    flags = F.flatten(F.transform(runs, lambda n, j: F.array_repeat(j % 2 == 0, n)))
    parts = let(flags, lambda keep: F.filter(lines_of(text), lambda _, i: F.get(keep, i)))
    return F.when(F.size(runs) == 1, text).otherwise(F.array_join(parts, "\n"))


def line_bitmaps(docs: DataFrame, min_chars: int = 10, salts: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, body, dropped, n_dropped) for the documents that lose lines; see ``apply_bitmaps``."""
    gone = dropped_lines(docs, min_chars, salts, doc_id, text)
    return gone.groupBy("id", "body").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def line_dedup(docs: DataFrame, min_chars: int = 10, salts: int = 64, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every input row with ``n_lines``, ``n_dropped``, ``keep_runs`` (the bitmap) and ``kept``, the text
    that the bitmap leaves.

    Read ``kept`` only where the text is wanted; unread, Spark does not build it."""
    maps = line_bitmaps(docs, min_chars, salts, doc_id, text)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("body"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = whole.join(maps, ["id", "body"], "left")
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    edged = joined.select("row", "text", n.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), keep_edges(n, F.col("dropped")).alias("edges"))
    mapped = edged.select("row", "text", "n_lines", "n_dropped", keep_runs(F.col("edges")).alias("keep_runs"))
    return mapped.select("row", "n_lines", "n_dropped", "keep_runs", kept_text(F.col("text"), F.col("keep_runs")).alias("kept"))
