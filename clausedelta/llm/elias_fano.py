"""Elias-Fano sequences on numpy arrays, in memory or memory-mapped.

A non-decreasing sequence of n numbers below u keeps the low bytes of each number as they are and the
rest in unary: bit (high part + i) is set for the i-th number. The number of low bytes is the one that
takes the least room. A count of zeros before each 64-bit word serves both selects. All operations take
arrays of queries.
"""

from __future__ import annotations

import os
import uuid
from functools import cached_property

import numpy as np

U64 = np.uint64


class EliasFano:
    def __init__(self, n: int, low: np.ndarray, words: np.ndarray) -> None:
        self.n, self.low, self.words = n, low, words
        self.width = low.shape[1] if low.ndim == 2 else 0

    @staticmethod
    def build(values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        width = min(range(8), key=lambda b: n * 8 * b + n + (universe >> (8 * b)))
        values = np.ascontiguousarray(values, dtype="<u8")
        low = values.view(np.uint8).reshape(n, 8)[:, :width].copy()
        high = (values >> U64(8 * width)).astype(np.int64)
        bits = np.zeros(-(-(n + (universe >> (8 * width)) + 2) // 64) * 64, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        return EliasFano(n, low, np.packbits(bits, bitorder="little").view("<u8"))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "words": self.words}

    @cached_property
    def zeros_before(self) -> np.ndarray:
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        return np.arange(len(self.words), dtype=np.int64) * 64 - np.concatenate([[0], ones[:-1]])

    @cached_property
    def ones_before(self) -> np.ndarray:
        return np.arange(len(self.words), dtype=np.int64) * 64 - self.zeros_before

    @staticmethod
    def in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit with `rank` set bits below it."""
        place, rest = np.zeros(len(words), dtype=np.uint8), rank.astype(np.uint8)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(words & U64((1 << width) - 1))
            beyond = rest >= below
            rest -= below * beyond
            shift = beyond * np.uint8(width)
            words = words >> shift
            place += shift
        return place

    def select0(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.zeros_before, k, side="right") - 1
        return at * 64 + self.in_word(~self.words[at], k - self.zeros_before[at])

    def select1(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ones_before, k, side="right") - 1
        return at * 64 + self.in_word(np.asarray(self.words[at]), k - self.ones_before[at])

    def low_of(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), dtype=np.uint8)
        if self.width:
            out[:, : self.width] = self.low[i]
        return out.view("<u8").ravel()

    def access(self, i: np.ndarray) -> np.ndarray:
        high = (self.select1(i) - i).astype(np.uint64)
        return (high << U64(8 * self.width)) | self.low_of(i)

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.asarray(self.words).view(np.uint8), bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64)
        return (high << U64(8 * self.width)) | self.low_of(np.arange(self.n))

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x by successor search within its high part; -1 where the successor is another number."""
        if not self.n or not len(x):
            return np.full(len(x), -1, dtype=np.int64)
        # Each number once and in order, so that the search walks through the files.
        order = np.argsort(x)
        x = x[order]
        fresh = np.concatenate([[True], x[1:] != x[:-1]])
        found = np.empty(len(x), dtype=np.int64)
        found[order] = self.find_sorted(x[fresh].astype(np.uint64))[np.cumsum(fresh) - 1]
        return found

    def find_sorted(self, x: np.ndarray) -> np.ndarray:
        high = (x >> U64(8 * self.width)).astype(np.int64)
        low = x & U64((1 << (8 * self.width)) - 1)
        stop = self.select0(high) - high
        start = np.where(high > 0, self.select0(np.maximum(high - 1, 0)) - (high - 1), 0)
        end = stop.copy()
        open_ = np.flatnonzero(start < stop)
        while len(open_):
            mid = (start[open_] + stop[open_]) >> 1
            less = self.low_of(mid) < low[open_]
            start[open_[less]] = mid[less] + 1
            stop[open_[~less]] = mid[~less]
            open_ = open_[start[open_] < stop[open_]]
        hit = np.flatnonzero(start < end)
        hit = hit[self.low_of(start[hit]) == low[hit]]
        out = np.full(len(x), -1, dtype=np.int64)
        out[hit] = start[hit]
        return out


def save(folder: str, **arrays: np.ndarray) -> None:
    """Each array as a file; a task that runs twice replaces its files by equal ones."""
    os.makedirs(folder, exist_ok=True)
    for name, array in arrays.items():
        part = f"{folder}/.{uuid.uuid4().hex}.npy"
        np.save(part, array)
        os.replace(part, f"{folder}/{name}.npy")


def mapped(folder: str, name: str) -> np.ndarray:
    path = f"{folder}/{name}.npy"
    return np.asarray(np.load(path, mmap_mode="r")) if os.path.getsize(path) > 128 else np.load(path)


def save_sequence(folder: str, name: str, seq: EliasFano) -> None:
    save(folder, **{f"{name}.{k}": v for k, v in seq.arrays().items()}, **{f"{name}.zeros": seq.zeros_before})


def map_sequence(folder: str, name: str) -> EliasFano:
    low, words = mapped(folder, f"{name}.low"), mapped(folder, f"{name}.words")
    seq = EliasFano(len(low), low, words)
    seq.__dict__["zeros_before"] = mapped(folder, f"{name}.zeros")
    return seq
