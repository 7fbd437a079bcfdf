"""Texts to token ids by the distinct segments of a batch: each is encoded once, then gathered."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 12 << 20
CACHE_SEGMENTS = 700_000


def give_back() -> None:
    """What Arrow and the allocator hold free goes back to the system: the worker shares its executor's memory
    with the JVM, and lives on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the GNU C library's call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about `most` bytes, so that memory doesn't follow the batch."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size, dtype=np.int64) - size) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The texts, null as empty, copied out of the batch: Arrow's ascii_lower misreads offsets that don't start at 0."""
    texts = batch.column(text_col).take(pa.array(np.arange(batch.num_rows)))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def words_by_row(texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of segments of each text, the segments' indices into the distinct ones, and those. Empty ones go."""
    lists = split(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets)
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = flat.filter(full).dictionary_encode()
    return np.diff(before[offsets]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


class SegmentEncoder:
    """`encode` maps a list of segments to their ids, as bytes of unsigned 32 bits each.

    What it gave is kept; beyond CACHE_SEGMENTS of them, only that of the last texts.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]]) -> None:
        self.encode, self.seen = encode, {}

    def __call__(self, texts: pa.Array, split: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, and how many each text has."""
        rows, index, distinct = words_by_row(texts, split)
        words = distinct.to_pylist()
        seen = self.seen
        new = [w for w in words if w not in seen]
        seen.update(zip(new, self.encode(new), strict=True))
        found = [seen[w] for w in words]
        if len(seen) > CACHE_SEGMENTS:
            self.seen = dict(zip(words, found, strict=True))
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        table = np.frombuffer(b"".join(found), dtype="<u4")
        starts = np.cumsum(lens) - lens
        each = lens[index]
        ids = table[gather(starts[index], each)]
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = upto[np.cumsum(rows)]
        return ids, np.diff(ends, prepend=0)


def cut_bytes(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The ids between bounds as bytes of unsigned 32 bits each."""
    raw, places = ids.astype("<u4").tobytes(), (bounds * 4).tolist()
    return [raw[a:b] for a, b in zip(places[:-1], places[1:], strict=True)]
