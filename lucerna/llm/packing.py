"""Best-fit packing of documents into token sequences, improved by swap-based local search.

Lengths are whole numbers up to the capacity, so any corpus is described by one count per length.
The packing is made on those counts: bins are classes, a class being a multiset of lengths with a
multiplicity. Best-fit decreasing opens the classes; local search then exchanges one item for one,
two for one, or moves an item between underfull classes wherever that increases the squared fill,
until no exchange does (emptied bins vanish). The driver holds ``capacity`` counts and the classes,
whose number depends on the lengths and not on the corpus. Pieces get their places by rank within
their length.

Defined results: a null or empty text is the end token alone; a null doc_id is kept; rows that
repeat are packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lucerna.llm.common import settle

CAPACITY, END = 1024, 2
#: The rank encoder's pattern backtracks on long runs of white space and ends its process on very long
#: ones; a text with a run of one kind that is longer goes to the tokenizers file itself.
LONGEST_RUN = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Classes = dict[tuple[int, ...], int]


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A function text -> ids by the tokenizers file ``vocabulary`` without added special tokens.

    A rank file of the same name beside it (``.tiktoken``) holds the same vocabulary for a faster
    encoder with equal ids; texts with a special token's string go to the tokenizers file itself."""
    import json
    from pathlib import Path

    import tiktoken

    ranks = Path(vocabulary).with_suffix(".tiktoken")
    if not ranks.exists():
        return lambda text: _exact(vocabulary, text)
    from public_tokenizers import PATTERN

    pairs = (line.split() for line in ranks.read_bytes().splitlines())
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})
    special = tuple(t["content"] for t in json.loads(Path(vocabulary).read_text())["added_tokens"])

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or has_long_run(text):
            return _exact(vocabulary, text)
        try:
            return np.array(fast.encode_ordinary(text), "<u4")
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # a panic of the encoder is no Exception
            return _exact(vocabulary, text)

    return encode


def has_long_run(text: str, longest: int = LONGEST_RUN) -> bool:
    """Whether a run of white space, or of anything else, is longer than ``longest``."""
    if len(text) <= longest:
        return False
    spaces = re.compile(r"\s+")
    at = 0
    for m in spaces.finditer(text):
        if m.start() - at > longest or m.end() - m.start() > longest:
            return True
        at = m.end()
    return len(text) - at > longest


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def _exact(vocabulary: str, text: str) -> np.ndarray:
    return np.array(_tokenizer(vocabulary).encode(text, add_special_tokens=False).ids, "<u4")


def piece_bounds(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of each piece: all have the capacity but the first, which may be shorter."""
    first = (length - 1) % capacity + 1
    edges = [0, *range(first, length + 1, capacity)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def with_place(docs: DataFrame) -> DataFrame:
    """``docs`` with ``part`` and ``nth``, which sort as its rows stand.

    A table read from files is dealt to tasks by the files' sizes, so its order is that of the files'
    names and the rows in them; any other is ordered by its partitions."""
    if docs._jdf.queryExecution().analyzed().nodeName().startswith(("LogicalRelation", "Relation")):
        return docs.select("*", F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("nth"))
    at = F.monotonically_increasing_id()
    return docs.select("*", at.alias("nth")).withColumn("part", F.lpad(F.shiftright("nth", 33).cast("string"), 10, "0"))


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", place: bool = False) -> DataFrame:
    """One row per piece of each document's token ids, the end token included; with ``place``, the
    columns ``part`` and ``nth`` of ``with_place`` as well."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            row: list[int] = []
            for at, (doc, body) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
                ids = np.append(encode(body.as_py() or ""), np.uint32(end)).astype("<u4")
                for k, (a, b) in enumerate(piece_bounds(len(ids), capacity)):
                    for column, value in zip(out, (doc.as_py(), k, a, b - a, zlib.crc32(ids[a:b])), strict=True):
                        column.append(value)
                    row.append(at)
            columns = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            stands = [batch.column(i).take(pa.array(row, pa.int64())) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns + stands, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"][: 5 + len(stands)])

    where = ["part", "nth"] if place else []
    return docs.select(F.col(doc_id).cast("long"), F.col(text), *where).mapInArrow(pieces, PIECES + (", part string, nth long" if place else ""))


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Classes:
    """Best-fit decreasing over counts of lengths: classes of bins, {lengths: how many bins}."""
    left: dict[int, Classes] = {}

    def put(items: tuple[int, ...], bins: int) -> None:
        if bins:
            at = left.setdefault(capacity - sum(items), {})
            at[items] = at.get(items, 0) + bins

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = next((r for r in range(length, capacity) if left.get(r)), capacity)
            items, bins = left[room].popitem() if room < capacity else ((), n)
            each = room // length
            full = min(bins, n // each)
            put(items + (length,) * each, full)
            n -= full * each
            bins -= full
            if bins and n:  # fewer than ``each`` are left for one more bin
                put(items + (length,) * n, 1)
                bins, n = bins - 1, 0
            if items:
                put(items, bins)
    return {items: bins for at in left.values() for items, bins in at.items()}


def _gives(items: tuple[int, ...]) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """What a bin can give: {total: its items}, one item each and two items each.

    Made from the distinct lengths, which are few however many items the bin has."""
    lengths = sorted(set(items))
    one = {a: (a,) for a in lengths}
    two = {a + b: (b, a) for i, a in enumerate(lengths) for b in lengths[i + 1 :]}
    two |= {2 * a: (a, a) for a in lengths if items.count(a) > 1}
    return one, two


def _without(items: tuple[int, ...], gone: tuple[int, ...], new: tuple[int, ...]) -> tuple[int, ...]:
    rest = list(items)
    for x in gone:
        rest.remove(x)
    return tuple(sorted(rest + list(new), reverse=True))


def improve(classes: Classes, capacity: int = CAPACITY) -> Classes:
    """Local search between underfull bins until no exchange is left: one for one, two for one, or a move.

    Each exchange increases the sum of squared fills, a whole number, so the search ends. A bin that
    gains d from another ends fuller than the other was iff the squares grow. For each bin the largest
    gain is sought first, from the emptiest giver; an exchange holds for as many bins as both classes
    have."""
    done = {c: n for c, n in classes.items() if sum(c) == capacity}
    start = {c: n for c, n in classes.items() if sum(c) < capacity}
    open_: Classes = {}
    #: by number of items given, by their total: the classes that can give it, the emptiest first
    givers: tuple[dict[int, list[tuple[int, tuple[int, ...]]]], ...] = ({}, {})
    waiting: list[tuple[int, ...]] = []

    def enter(c: tuple[int, ...], n: int) -> None:
        if not c or not n:
            return
        if sum(c) == capacity:
            done[c] = done.get(c, 0) + n
            return
        if c not in open_:
            for by_total, gives in zip(givers, _gives(c), strict=True):
                for total in gives:
                    insort(by_total.setdefault(total, []), (sum(c), c))
        open_[c] = open_.get(c, 0) + n
        waiting.append(c)

    def leave(c: tuple[int, ...], n: int) -> None:
        open_[c] -= n
        if not open_[c]:
            del open_[c]
            for by_total, gives in zip(givers, _gives(c), strict=True):
                for total in gives:
                    rest = by_total[total]
                    del rest[bisect_left(rest, (sum(c), c))]

    def exchange(c: tuple[int, ...]) -> tuple | None:
        fill = sum(c)
        one, two = _gives(c)
        own = [(0, ()), *sorted(one.items()), *sorted(two.items())]
        for gain in range(capacity - fill, 0, -1):
            for lost, give in own:
                found = []
                for taken, by_total in enumerate(givers[: 1 if len(give) == 2 else 2]):  # two for two is not among the exchanges
                    for filled, o in by_total.get(lost + gain, ())[:2]:
                        if filled < fill + gain and (o != c or open_[c] > 1):
                            found.append((filled, o, taken))
                            break
                if found:
                    _, o, taken = min(found)
                    return o, give, _gives(o)[taken][lost + gain]
        return None

    for c, n in sorted(start.items(), key=lambda x: (sum(x[0]), x[0])):
        enter(c, n)
    while waiting:
        c = waiting.pop()
        if c in open_ and (found := exchange(c)):
            o, give, take = found
            n = open_[c] // 2 if o == c else min(open_[c], open_[o])
            leave(c, n)
            leave(o, n)
            enter(_without(o, take, give), n)
            enter(_without(c, give, take), n)
            if c in open_:
                waiting.append(c)
    return done | open_


def places(classes: Classes) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): where the pieces of a length go."""
    out, used, sequence = [], {}, 0
    for items, bins in sorted(classes.items()):
        offset = 0
        for length in items:
            rank = used.get(length, 0)
            out.append((length, rank, rank + bins, sequence, offset))
            used[length] = rank + bins
            offset += length
        sequence += bins
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = 64, rows_per_salt: int = 20_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    Ranks within a length are made in parallel: pieces are ranked per (length, salt), and small
    per-salt counts, summed up, shift the ranks. A length that very many pieces share has salts in
    proportion.

    Where ``pieces`` have ``part`` and ``nth``, parts are the salts: ranks within a length follow the
    order of the rows, and so do sequences, by their first piece."""
    ordered = {"part", "nth"} <= set(pieces.columns)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one per length
    where = places(improve(best_fit(counts, capacity), capacity))
    spark = pieces.sparkSession
    spots = spark.createDataFrame(where, "length long, low long, high long, first_sequence long, offset long")
    n = max(salts, -(-max(counts.values(), default=0) // rows_per_salt))
    salted = pieces.withColumn("salt", F.col("part") if ordered else F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    shift = salted.groupBy("length", "salt").count().select("length", "salt", (F.sum("count").over(W.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy(*["nth"] * ordered, "doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("local", local).join(shift, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    # ``spots`` depends on the lengths that occur, not on how many rows have them
    placed = ranked.join(F.broadcast(spots), (ranked["length"] == spots["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    out = placed.select(*[ranked[c] for c in pieces.columns], (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("offset"))
    return in_order(out) if ordered else out


def in_order(placed: DataFrame) -> DataFrame:
    """``placed`` without ``part`` and ``nth``, its sequences numbered by the place of their first piece."""
    placed = settle(placed, "placed")
    firsts = settle(placed.groupBy("sequence_id").agg(F.min(F.struct("part", "nth", "piece")).alias("first")).select("sequence_id", "first.*"), "sequences")
    counts = sorted((r["part"], r["count"]) for r in firsts.groupBy("part").count().collect())  # one per part
    before = [(part, sum(n for _, n in counts[:i])) for i, (part, _) in enumerate(counts)]
    shift = F.broadcast(placed.sparkSession.createDataFrame(before, "part string, before long"))
    nth = F.row_number().over(W.partitionBy("part").orderBy("nth", "piece", "sequence_id"))
    numbers = firsts.withColumn("number", nth - 1).join(shift, "part").select("sequence_id", (F.col("before") + F.col("number")).alias("number"))
    columns = [F.col("number").alias(c) if c == "sequence_id" else F.col(c) for c in placed.columns if c not in ("part", "nth")]
    return placed.join(numbers, "sequence_id").select(*columns)


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", ordered: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place;
    ``ordered`` keeps the order of ``docs`` among pieces of a length and among sequences.

    The texts are read and tokenized once; the narrow table of pieces is settled."""
    return pack(settle(cut(with_place(docs) if ordered else docs, vocabulary, capacity, end, doc_id, text, ordered), "pieces"), capacity)
