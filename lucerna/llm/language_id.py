"""Language identification by interpolated Kneser-Ney character models.

One model per language, over the letters of a word and its two ends. All models share sorted arrays
of n-gram hashes with one column of log-probabilities per language. A text gets the language of the
lowest cross-entropy per character. A softmax whose scale is fitted on calibration texts gives the
score, and the calibration texts' cross-entropies give each language's limit for rejection.

Defined results: a null text or one without letters is ``und`` with score 0; a row
without doc_id is neither trained on nor held out; repeated rows are judged each; an empty table gives no
rows; without any training text every text is ``und``; extra columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = 5
#: Fit on at most so many texts per language, the first by hash; every tenth of them calibrates.
SAMPLE = 800
#: And on so many characters of them; a longer text takes no part in the fit. Both bound what the driver
#: reads, whatever the table.
SAMPLE_CHARS = 8_000_000
#: Characters that are worked on at once; longer texts are cut between words.
CHUNK = 1_000_000
UNKNOWN = "und"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_END = 0x20


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _PRIME, np.uint64)]), dtype=np.uint64)


@dataclass(frozen=True)
class Words:
    """The distinct words of a chunk, spelt out one after another, each between two ends."""

    symbols: np.ndarray
    starts: np.ndarray
    keys: np.ndarray
    #: of every word of the chunk: its text, and which distinct word it is
    text: np.ndarray
    which: np.ndarray


def words(texts: Sequence[str]) -> Words:
    joined = "\n".join(texts).lower() + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    # lower() may change lengths, so texts are found again by their line ends: none has one inside
    text = np.concatenate([[0], np.cumsum(code == 10)[:-1]])
    is_letter = letters()[code]
    first = np.flatnonzero(is_letter & ~np.concatenate([[False], is_letter[:-1]]))
    last = np.flatnonzero(is_letter & ~np.concatenate([is_letter[1:], [False]]))
    sizes = last - first + 1
    if not len(first):
        return Words(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    total = np.concatenate([[0], np.cumsum(sizes)])
    inside = code[is_letter]
    place = np.arange(len(inside)) - np.repeat(total[:-1], sizes)
    hashes = np.add.reduceat(_mix(inside) * _powers(int(sizes.max()))[place], total[:-1])
    keys, index, which = np.unique(hashes, return_index=True, return_inverse=True)
    n = sizes[index]
    starts = np.concatenate([[0], np.cumsum(n + 2)])
    symbols = np.full(starts[-1], _END, np.uint32)
    offset = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)])[:-1], n)
    symbols[np.repeat(starts[:-1], n) + 1 + offset] = inside[np.repeat(total[index], n) + offset]
    return Words(symbols, starts[:-1], keys, text[first], which)


def grams(w: Words, order: int = ORDER) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: (order, positions, hashes of the n-grams that end there, of their contexts)."""
    position = np.arange(len(w.symbols))
    depth = position - np.repeat(w.starts, np.diff(np.concatenate([w.starts, [len(w.symbols)]])))
    mixed, powers = _mix(w.symbols), _powers(order)
    hashes = mixed.copy()
    before = np.zeros(len(mixed), np.uint64)
    for k in range(1, order + 1):
        if k > 1:
            before = np.concatenate([np.zeros(1, np.uint64), hashes[:-1]]) if len(hashes) else hashes
            hashes = hashes.copy()
            hashes[k - 1 :] += mixed[: len(mixed) - k + 1] * powers[k - 1]
        at = position[depth >= max(1, k - 1)]
        yield k, at, hashes[at] + np.uint64(k), before[at] + np.uint64(k)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    #: by order: sorted n-gram hashes and log-probabilities (NaN: unseen), sorted contexts and log back-off
    levels: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]
    floor: float
    scale: float = 1.0
    limits: tuple[float, ...] = ()


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool))


def word_scores(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct word: log-probability by language, and how many symbols were predicted."""
    logp = np.full((len(w.symbols), len(model.languages)), model.floor)
    for (keys, values, contexts, backoff), (_, at, hashes, before) in zip(model.levels, grams(w, len(model.levels)), strict=True):
        known, held = _find(contexts, before)
        here = logp[at]
        here[held] += backoff[known[held]]  # 0 where a language has not seen the context
        place, seen = _find(keys, hashes)
        own = values[place[seen]]
        here[seen] = np.where(np.isnan(own), here[seen], own)
        logp[at] = here
    logp[w.starts] = 0
    if not len(w.starts):
        return np.zeros((0, len(model.languages))), np.zeros(0)
    return np.add.reduceat(logp, w.starts, axis=0), np.diff(np.concatenate([w.starts, [len(w.symbols)]])) - 1.0


def counts(texts: Sequence[str], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order: the texts' distinct n-grams, their contexts and counts (of types below the highest)."""
    w = words(texts)
    often = np.bincount(w.which, minlength=len(w.starts))
    weight = np.repeat(often, np.diff(np.concatenate([w.starts, [len(w.symbols)]]))) if len(w.starts) else np.zeros(0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    raw = [(k, at, h, b, weight[at]) for k, at, h, b in grams(w, order)]
    for i, (k, at, h, b, n) in enumerate(raw):
        if k < order:
            # continuation counts: in how many longer n-grams an n-gram ends one; those that begin a word have none longer
            _, up_at, up, _, _ = raw[i + 1]
            _, one = np.unique(up, return_index=True)
            lone = ~np.isin(at, up_at)
            n = np.zeros(len(at))
            np.add.at(n, np.searchsorted(at, up_at[one]), 1.0)
            n[lone] = weight[at[lone]]
        keys, index, which = np.unique(h, return_index=True, return_inverse=True)
        out.append((keys, b[index], np.bincount(which, n, len(keys))))
    return out


def kneser_ney(texts: Sequence[str], order: int = ORDER) -> list[tuple[np.ndarray, ...]]:
    """By order: (n-grams, discounted probabilities, contexts, back-off weights, and of each n-gram its
    context and that context's index); what the discount frees goes to the order below."""
    levels = []
    for keys, before, n in counts(texts, order):
        kept = n > 0
        keys, before, n = keys[kept], before[kept], n[kept]
        once, twice = float((n == 1).sum()), float((n == 2).sum())
        discount = once / (once + 2 * twice) if once and twice else 0.5
        contexts, which = np.unique(before, return_inverse=True)
        total, types = np.bincount(which, n), np.bincount(which)
        backoff = discount * types / total
        levels.append((keys, np.maximum(n - discount, 0) / total[which], contexts, backoff, before, which))
    return levels


def train(samples: dict[str, Sequence[str]], order: int = ORDER) -> Model:
    """A model of the languages with any letters in their samples."""
    languages = tuple(sorted(s for s, texts in samples.items() if any(len(words([t.replace("\n", " ")]).starts) for t in texts)))
    clean = {s: [t.replace("\n", " ") for t in samples[s]] for s in languages}
    fit = {s: [t for i, t in enumerate(texts) if i % 10 or len(texts) < 10] for s, texts in clean.items()}
    check = {s: [t for i, t in enumerate(texts) if not i % 10] for s, texts in clean.items()}
    alphabet = len({c for texts in fit.values() for t in texts for c in t.lower() if c.isalpha()}) + 2
    floor = -math.log(alphabet)
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if not languages:
        return Model((), (), floor)
    parts = {s: kneser_ney(fit[s], order) for s in languages}
    spelt = {s: words(fit[s]) for s in languages}
    for k in range(order):
        keys = np.unique(np.concatenate([parts[s][k][0] for s in languages]))
        contexts = np.unique(np.concatenate([parts[s][k][2] for s in languages]))
        values = np.full((len(keys), len(languages)), np.nan)
        backoff = np.zeros((len(contexts), len(languages)))
        for j, s in enumerate(languages):
            own, p, held, weight, before, which = parts[s][k]
            backoff[np.searchsorted(contexts, held), j] = np.log(weight)
            # probability in the order below of the same n-gram without its first symbol
            lower = _below(levels, spelt[s], k, own, j, floor)
            values[np.searchsorted(keys, own), j] = np.log(p + weight[which] * np.exp(lower))
        levels.append((keys, values, contexts, backoff))
    model = Model(languages, tuple(levels), floor)
    return _calibrated(model, check)


def _below(levels: list, w: Words, k: int, own: np.ndarray, j: int, floor: float) -> np.ndarray:
    """Log-probability by the levels so far of the n-grams ``own`` of order k + 1, shortened by one."""
    logp = np.full(len(w.symbols), floor)
    for level, (order, at, hashes, before) in enumerate(grams(w, k + 1)):
        if level == k:
            out = np.full(len(own), floor)
            place, seen = _find(own, hashes)
            out[place[seen]] = logp[at[seen]]
            return out
        keys, values, contexts, backoff = levels[level]
        known, held = _find(contexts, before)
        here = logp[at]
        here[held] += backoff[known[held], j]
        place, seen = _find(keys, hashes)
        mine = values[place[seen], j]
        here[seen] = np.where(np.isnan(mine), here[seen], mine)
        logp[at] = here
    return logp


def pieces(text: str, size: int = CHUNK) -> Iterator[str]:
    """A text without line ends, cut between words where it is longer than ``size``."""
    text = text.replace("\n", " ")
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        cut = cut if cut > at else at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


class Scores:
    """``word_scores`` that remembers words: most of a text's words were met before.

    Holds up to ``most`` words, sorted by hash; new ones are merged in when there are enough."""

    def __init__(self, model: Model, most: int = 1_000_000):
        self.model, self.most = model, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, len(model.languages) + 1))
        self.fresh: list[tuple[np.ndarray, np.ndarray]] = []

    def of(self, w: Words) -> np.ndarray:
        """Of each distinct word: log-probability by language, then the number of symbols."""
        out = np.empty((len(w.keys), self.values.shape[1]))
        at, held = _find(self.keys, w.keys)
        out[held] = self.values[at[held]]
        new = np.flatnonzero(~held)
        if len(new):
            sizes = np.diff(np.concatenate([w.starts, [len(w.symbols)]]))
            part = np.repeat(~held, sizes)
            starts = np.concatenate([[0], np.cumsum(sizes[new])])[:-1]
            scores, symbols = word_scores(self.model, Words(w.symbols[part], starts, w.keys[new], new, new))
            out[new] = np.column_stack([scores, symbols])
            self.fresh.append((w.keys[new], out[new]))
            if len(self.keys) < self.most and sum(len(k) for k, _ in self.fresh) > 50_000 + len(self.keys) // 4:
                keys = np.concatenate([self.keys, *(k for k, _ in self.fresh)])
                self.keys, index = np.unique(keys, return_index=True)
                self.values = np.concatenate([self.values, *(v for _, v in self.fresh)])[index]
                self.fresh = []
            elif len(self.keys) >= self.most:
                self.fresh = []
        return out


def cross_entropies(model: Model, texts: Sequence[str | None], scores: Scores | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(negative log-probability per symbol by language, symbols) of whole texts."""
    known = scores or Scores(model)
    total, symbols = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    held: list[str] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            w = words(held)
            values = known.of(w)
            of = np.array(owner)[w.text]
            symbols[:] += np.bincount(of, values[w.which, -1], len(texts))
            for j in range(len(model.languages)):
                total[:, j] += np.bincount(of, values[w.which, j], len(texts))
            held.clear()
            owner.clear()

    waiting = 0
    for i, text in enumerate(texts):
        for piece in pieces(text or ""):
            held.append(piece)
            owner.append(i)
            waiting += len(piece)
            if waiting >= CHUNK:
                flush()
                waiting = 0
    flush()
    return -total / np.maximum(symbols, 1)[:, None], symbols


def _shares(h: np.ndarray, symbols: np.ndarray, scale: float) -> np.ndarray:
    z = -h * np.sqrt(symbols)[:, None] * scale
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _calibrated(model: Model, check: dict[str, Sequence[str]]) -> Model:
    """The scale of the lowest log-loss, and per language the highest cross-entropy seen and a margin."""
    texts = [(t, j) for j, s in enumerate(model.languages) for t in check[s]]
    if not texts:
        return model
    h, symbols = cross_entropies(model, [t for t, _ in texts])
    true = np.array([j for _, j in texts])
    ok = symbols > 0
    losses = {a: -np.log(np.maximum(_shares(h[ok], symbols[ok], a)[np.arange(ok.sum()), true[ok]], 1e-9)).mean() if ok.any() else 0.0 for a in (0.25, 0.5, 1.0, 2.0, 4.0)}
    limits = []
    for j in range(len(model.languages)):
        own = h[ok & (true == j), j]
        limits.append(float(own.mean() + 6 * own.std() + 0.1) if len(own) else math.inf)
    return Model(model.languages, model.levels, model.floor, min(losses, key=lambda a: (losses[a], a)), tuple(limits))


def training_rows(docs: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): the first ``sample`` texts per language by hash, and of those the first that hold
    together at most ``chars`` characters, none of a held-out document.

    A frequent language is first thinned by hash to a few times the sample, so that no task meets
    all its rows."""
    counts = {r["lang"]: r["count"] for r in docs.groupBy(F.col(lang).alias("lang")).count().where("lang is not null").collect()}
    if not counts:
        return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * sample / n))])
    draw = F.xxhash64("doc_id")
    open_ = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    thin = open_.where(draw.cast("double") / 2.0**64 + 0.5 <= F.element_at(share, F.col("lang")))
    first = W.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text"))
    drawn = thin.where(F.length("text") <= chars).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= sample)
    summed = drawn.withColumn("chars", F.sum(F.length("text").cast("long")).over(W.partitionBy("lang").orderBy("nth")))
    return summed.where(F.col("chars") <= chars).orderBy("lang", "nth").select("lang", "text")


def language_id(docs: DataFrame, sample: int = SAMPLE, order: int = ORDER, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected), one row per document.

    ``rejected``: the best language's cross-entropy is above its calibrated limit."""
    samples: dict[str, list[str]] = {}
    for r in training_rows(docs, sample, doc_id, text, lang, chars).toLocalIterator():
        samples.setdefault(r["lang"], []).append(r["text"])
    # the model's size follows the sample, not the table
    shared = docs.sparkSession.sparkContext.broadcast(train(samples, order))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scores = Scores(model)
        for b in batches:
            h, symbols = cross_entropies(model, b.column(2).to_pylist(), scores)
            known = (symbols > 0) & bool(model.languages)
            best = h.argmin(axis=1) if model.languages else np.zeros(len(h), int)
            row = np.arange(len(h))
            share = _shares(h, symbols, model.scale)[row, best] if model.languages else np.zeros(len(h))
            low = h[row, best] if model.languages else np.zeros(len(h))
            limit = np.array(model.limits or (math.inf,))[best]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([model.languages[j] if k else UNKNOWN for j, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, share, 0.0)),
                    pa.array(np.where(known, low, np.nan)),
                    pa.array(known & (low > limit)),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.expr(f"crc32(cast(`{doc_id}` as string)) % 4 = 2"), F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return wanted.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
