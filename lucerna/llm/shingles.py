"""Words, word shingles and their weights as numpy arrays, straight from Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1_000_000
#: Word document frequencies are counted in so many hashed counters.
COUNTERS = 1 << 20
#: How far rarity spreads the weights.
RARITY = 0.25

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1), base, np.uint64)]), dtype=np.uint64)


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets of its texts) of runs of texts; a null text is empty."""
    if pa.types.is_large_string(texts.type) or texts.null_count:
        texts = pa.array([t or "" for t in texts.to_pylist()], pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if len(texts) and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


@dataclass(frozen=True)
class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts, in order."""

    hashes: np.ndarray
    #: where the words of each text begin, and the end
    bounds: np.ndarray
    #: byte places within the run
    starts: np.ndarray
    ends: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), none, none)
    solid = ~_SPACE[data]
    opens = np.empty(n + 1, bool)
    opens[0], opens[1:n], opens[n] = solid[0], solid[1:] & ~solid[:-1], False
    closes = np.empty(n + 1, bool)
    closes[0], closes[1:n], closes[n] = False, solid[:-1] & ~solid[1:], solid[-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    inner = inner[solid[inner] & solid[inner - 1]]  # a text ends in a word and the next begins in one
    opens[inner] = closes[inner] = True
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), starts, ends)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    values = (data[solid].astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(sizes.max()))[place]
    return Words(mix(np.add.reduceat(values, first)), np.searchsorted(starts, offsets), starts, ends)


def shingle_hashes(w: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, their texts, their first words): all runs of ``width`` words; of a shorter text, all its words."""
    n = len(w.hashes)
    counts = np.diff(w.bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(w.bounds[1:], counts) - np.arange(n)  # words from here to the text's end
    whole = np.repeat(counts, counts) < width
    first = np.flatnonzero((left >= width) | (whole & (left == np.repeat(counts, counts))))
    total = np.zeros(len(first), np.uint64)
    step = powers(_STEP, width)
    for k in range(width):
        there = left[first] > k
        total += np.where(there, w.hashes[np.minimum(first + k, n - 1)], np.uint64(0)) * step[k] if n else total
    return mix(total), text[first], first


@dataclass(frozen=True)
class Weighted:
    """Each text's distinct shingles, sorted by text and hash, with weights."""

    hashes: np.ndarray
    weights: np.ndarray
    bounds: np.ndarray


def counter_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)) & np.uint64(COUNTERS - 1)


def word_rarity(df: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency by counter, scaled to 0..1.

    What a counter gets from other words on average is taken off, so that rare words stay rare
    however many words the corpus has."""
    spread = (df.sum() - df) / max(len(df) - 1, 1)
    own = np.maximum(df - spread, 1.0)
    return (np.log((1.0 + documents) / (1.0 + own)) / np.log(2.0 + documents)).clip(0.0, 1.0).astype(np.float32)


def weighted(w: Words, rarity: np.ndarray, width: int = WIDTH, spread: float = RARITY) -> Weighted:
    """TF-IDF: a shingle weighs its count in the text times an inverse document frequency from
    1 - ``spread`` to 1, by the mean rarity of its words.

    Rarity is that of the words, not of the shingle: near copies share their shingles, and rarity by
    shingle would make what they share light and what tells them apart heavy."""
    hashes, text, first = shingle_hashes(w, width)
    texts = len(w.bounds) - 1
    if not len(hashes):
        return Weighted(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(texts + 1, np.int64))
    word = rarity[counter_of(w.hashes)]
    summed = np.concatenate([[0.0], np.cumsum(word, dtype=np.float64)])
    last = np.minimum(first + width, w.bounds[text + 1])
    mean = (summed[last] - summed[first]) / (last - first)
    bits = np.uint64(max(1, int(texts - 1).bit_length()))
    key = (text.astype(np.uint64) << (np.uint64(64) - bits)) | (hashes >> bits)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate([at, [len(key)]]))
    # the prefix sums differ in their last bits from text to text; equal words must weigh the same
    grade = np.round(mean[order[at]] * 256) / 256
    return Weighted(hashes[order[at]], (count * (1.0 - spread + spread * grade)).astype(np.float32), np.concatenate([np.searchsorted(text[order[at]], np.arange(texts)), [len(at)]]))
