"""Vectorised word and shingle hashing over Arrow batches of UTF-8 texts.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``.  Words are hashed by a
polynomial over their bytes modulo 2**64, taken as a difference of prefix sums,
so that no Python runs per word; a final mix spreads the bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: The white space of the contracts: space, tab, line feed, VT, FF, CR.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        made = []
        for base in (_BASE, _BACK):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; a worker outlives its tasks, so what Arrow's pool holds is given back after each."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return wrapped


def encoded(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(texts: list[bytes], gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, each word's start and end in them, and each text's first word.

    ``gap`` tells the bytes between words; the space is always one of them.
    """
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = gap[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    at = np.cumsum([1, *(len(x) + 1 for x in texts)])
    return joined, starts, ends, np.searchsorted(starts, at)


def word_hashes(texts: list[bytes], gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the bounds of each text's words."""
    joined, starts, ends, bounds = word_spans(texts, gap)
    return span_hashes(joined, starts, ends), bounds


def span_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the joined bytes."""
    power, back = _tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts])


def text_chunks(batch: pa.RecordBatch, rows: int = 512) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch with A-Z lower-cased, by chunks: the first one's row, and the texts."""
    for low in range(0, batch.num_rows, rows):
        texts = [x.lower() for x in encoded(batch.column("text").slice(low, rows))]
        for start, end in chunks(texts):
            yield low + start, texts[start:end]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, where each is found first, and the sum of its counts."""
    kinds, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
    out = np.zeros(len(kinds), np.int64)
    np.add.at(out, inverse, counts)
    return kinds, at, out


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in each text, and the bounds of each text's runs.

    A text with 1 to k-1 words has one run, its whole sequence of words; a text
    without words has none.
    """
    n = len(words)
    counts = np.diff(bounds)
    factors = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for i in range(k):
        runs += words[i : n - k + 1 + i] * factors[i]
    runs = mix(runs ^ np.uint64(k))
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    to = np.concatenate([[0], np.cumsum(made)])
    keep = np.ones(len(runs), bool)
    for j in range(1, k):  # runs that cross the end of a text
        crossing = bounds[1:] - j
        crossing = crossing[(crossing >= bounds[:-1]) & (crossing < len(runs))]
        keep[crossing] = False
    out = np.empty(to[-1], np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    place = np.ones(to[-1], bool)
    place[to[short]] = False
    out[place] = runs[keep]
    for i in short:
        own = words[bounds[i] : bounds[i + 1]]
        value = np.sum(own * factors[: len(own)], dtype=np.uint64, keepdims=True) + np.uint64(counts[i])
        out[to[i]] = mix(value ^ np.uint64(0x5107))[0]
    return out, to


def digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes."""
    value = int(np.sum(mix(tokens ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)) ^ len(tokens) * 0x9E3779B97F4A7C15
    value = int(mix(np.array([value & 2**64 - 1], np.uint64))[0])
    return value - (value >> 63 << 64)
