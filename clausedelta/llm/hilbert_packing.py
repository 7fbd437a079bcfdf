"""Packing along a space-filling curve.

Each document becomes ids and an end id, a hashed vector of its ids, a few projections of it, and from
these its key on a Hilbert curve. Documents are range-sorted by (key, id) and poured into sequences of
`length` ids in that order, so neighbours on the curve share sequences. Documents are cut where a
sequence is full; what is left at the end of a partition goes into sequences of powers of two, which
need no padding. A task holds one open sequence and one document at a time.

Defined results: null and empty texts are the end id alone. Equal texts share a key and are ordered by
id; the id in the sort key lets a key with a third of all rows be split. Rows that repeat an id are
packed as documents of their own. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.common import written
from clausedelta.llm.segments import SegmentEncoder, cut_bytes, slices, texts_of

HASHED, PROJECTED, BITS = 64, 4, 12
END_ID = 2
SEPARATOR, JOINED_WORDS = "\x1f", 2000
CODED = "doc_id bigint, curve_key bigint, ids binary"
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, ids binary"
)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64."""
    x = x.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_vectors(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One unit vector of signed hashed id counts per document; zero without ids."""
    h = mixed(ids, 0)
    cell = np.repeat(np.arange(len(counts)), counts) * HASHED + (h % np.uint64(HASHED)).astype(np.int64)
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(cell, weights=sign, minlength=len(counts) * HASHED).reshape(-1, HASHED)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def projection() -> np.ndarray:
    return np.random.default_rng(7).normal(size=(HASHED, PROJECTED))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below 2^bits (Skilling 2004)."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    flat = hashed_vectors(ids, counts) @ projection()
    side = 1 << BITS
    return hilbert_keys(np.clip((np.tanh(flat) + 1) / 2 * side, 0, side - 1).astype(np.int64), BITS)


@cache
def word_encoder(path: str) -> SegmentEncoder:
    """One per Python worker, so that what a task has encoded serves the next one.

    Distinct words go in long texts of them, a separator between: one call each would cost more than its work.

    The separator is one id that no word without it can have; words that hold it are encoded alone.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    (mark,) = encode([SEPARATOR])[0]

    def encode_joined(words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if SEPARATOR not in w]
        alone = [i for i, w in enumerate(words) if SEPARATOR in w]
        parts = [plain[at : at + JOINED_WORDS] for at in range(0, len(plain), JOINED_WORDS)]
        for part in parts:
            ids = np.array(encode([f" {SEPARATOR} ".join([words[i] for i in part])])[0], dtype=np.uint32)
            between = ids == mark
            bounds = np.flatnonzero(between) - np.arange(between.sum())
            rows = cut_bytes(ids[~between], np.concatenate([[0], bounds, [len(ids) - len(bounds)]]))
            for i, row in zip(part, rows, strict=True):
                out[i] = row
        for i, row in zip(alone, encode([words[i] for i in alone]), strict=True):
            out[i] = np.array(row, dtype="<u4").tobytes()
        return out

    return SegmentEncoder(encode_joined)


def word_split(texts: pa.Array) -> pa.Array:
    """Words between ASCII white space, A-Z lowered as the tokenizer does anyway, so that fewer differ."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def code_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, curve_key, ids (end id included, little-endian unsigned 32 bits).

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, counts = encoder(texts_of(part, "text"), word_split)
                keys = curve_keys(ids, counts)
                ends = np.cumsum(counts)
                whole = np.insert(ids, ends, END_ID)
                cells = cut_bytes(whole, np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(keys), pa.array(cells, type=pa.binary())],
                    ["doc_id", "curve_key", "ids"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(code, CODED)


class Pourer:
    """Pours documents into sequences; holds the pieces of the open one."""

    def __init__(self, length: int, first_id: int) -> None:
        self.length, self.next_id, self.open, self.held = length, first_id, [], 0

    def close(self, size: int) -> list[tuple]:
        """The first `size` held ids as a sequence."""
        rows, offset, rest = [], 0, []
        for doc_id, start, ids, whole in self.open:
            now = ids[: size - offset]
            if len(now):
                rows.append((doc_id, start, len(now), zlib.crc32(now), whole, self.next_id, offset, now))
                offset += len(now)
            if len(now) < len(ids):
                rest.append((doc_id, start + len(now), ids[len(now):], whole))
        self.open, self.held, self.next_id = rest, self.held - size, self.next_id + 1
        return rows

    def pour(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            now = ids[at : at + self.length - self.held]
            self.open.append((doc_id, at, now, len(ids)))
            self.held += len(now)
            at += len(now)
            if self.held == self.length:
                yield from self.close(self.length)

    def finish(self) -> Iterator[tuple]:
        while self.held:
            yield from self.close(1 << (self.held.bit_length() - 1))


def pack(coded: DataFrame, length: int = 4096, with_ids: bool = True) -> DataFrame:
    """Pieces of the sequences: PIECES; without ids, that column is null."""

    def rows_of(pieces: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*pieces, strict=True))
        raw = [x.tobytes() for x in cols[7]] if with_ids else [None] * len(pieces)
        types = [pa.int64()] * 7 + [pa.binary()]
        arrays = [pa.array(c, type=t) for c, t in zip([*cols[:7], raw], types, strict=True)]
        return pa.RecordBatch.from_arrays(
            arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        )

    def pour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pourer, out = Pourer(length, TaskContext.get().partitionId() << 36), []
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                out += pourer.pour(doc_id, np.frombuffer(raw.as_buffer(), dtype="<u4"))
                if len(out) > 2000:
                    yield rows_of(out)
                    out = []
        out += pourer.finish()
        if out:
            yield rows_of(out)

    ordered = coded.repartitionByRange("curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    return ordered.select("doc_id", "ids").mapInArrow(pour, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 4096, with_ids: bool = True) -> DataFrame:
    """The ids are written once: range bounds are sampled from them, and a lost task finds them there."""
    coded = written(code_documents(docs, tokenizer_path), "coded", compression="zstd")
    return pack(coded, length, with_ids)
