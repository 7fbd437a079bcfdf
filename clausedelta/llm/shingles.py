"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from clausedelta.llm.segments import words_by_row

WORDS = 5
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def finish(x: np.ndarray) -> np.ndarray:
    """The final step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def lower_words(texts: pa.Array) -> pa.Array:
    """A-Z lowered, cut at ASCII white space: space, and tab to carriage return."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def distinct_word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the number of every word of all texts among the distinct ones, and their hashes."""
    rows, index, distinct = words_by_row(texts, lower_words)
    each = [xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.large_binary()).to_pylist()]
    return rows, index, np.array(each, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the hash of every word of all texts in turn."""
    rows, index, hashes = distinct_word_hashes(texts)
    return rows, hashes[index]


def window_hashes(rows: np.ndarray, words: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each text in text order, and how many; a text of fewer words is one shingle, without words none."""
    n = len(words)
    starts = np.cumsum(rows) - rows
    state = np.zeros(n, dtype=np.uint64)
    short = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        state[: n - k] = finish(state[: n - k] * GOLDEN + words[k:] + np.uint64(k + 1)) if k < n else state[:0]
        if k < size - 1:
            at = starts[rows == k + 1]
            short[at] = finish(state[at] ^ np.uint64(k + 1))
    counts = np.where(rows >= size, rows - size + 1, np.minimum(rows, 1))
    owner = np.repeat(np.arange(len(rows)), rows)
    place = np.arange(n) - starts[owner]
    values = np.where(rows[owner] < size, short, state)
    return values[place < counts[owner]], counts


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    rows, words = word_hashes(texts)
    values, counts = window_hashes(rows, words, size)
    ends = np.cumsum(counts)
    for a, b in zip(ends - counts, ends, strict=True):
        part = np.sort(values[a:b])
        yield part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) else part
