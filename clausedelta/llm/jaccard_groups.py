"""Exact Jaccard join of word-shingle sets by grouped prefixes.

1. One shuffle of the shingle hashes, packed by hash range, finds those that two documents share. Only
   shared shingles can lie in an intersection, so the rest of a set is kept as a number.
2. Per document, shingles are ordered rare first: unshared ones, then by log2 of the document
   frequency and hash. A document whose prefix is all unshared has no partner. Equal sets are one class.
3. Classes with equal size and prefix form a group. Groups that share a prefix shingle and pass the
   length and position filters are candidates.
4. Members are verified on their exact sets, in stars first (see bucket_links).

Defined results: A-Z is lowered, words are runs of anything but ASCII white space; a text of fewer than
five words is one shingle, null or empty text none, linked with nothing. Rows that repeat an id are one
document with all their shingles; rows without an id are left out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.bucket_links import VERIFY_ROWS, link_buckets, sketch
from clausedelta.llm.common import parts_for, written
from clausedelta.llm.components import merge_components
from clausedelta.llm.segments import gather, give_back, slices, texts_of
from clausedelta.llm.shingles import finish, shingle_sets

SHARD_BYTES, SLICE = 12 << 20, 6 << 20
CELLS = "shard int, docs array<bigint>, counts array<int>, hashes binary, ranks binary"
SETS = (
    "doc_id bigint, n_shingles bigint, unshared bigint, set_key binary, group_key binary, "
    "prefix array<bigint>, tokens binary, bits array<bigint>"
)


def cells(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], ["shard", "docs", "counts", "hashes", "ranks"]
    )


def bucket_of(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (finish(docs.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def by_shard(shard: np.ndarray, docs: np.ndarray, shards: int, *values: np.ndarray) -> Iterator[tuple]:
    """shard and docs (numbers of documents) per value: for each shard its documents, counts and values."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards), side="right")
    start = 0
    for s, end in enumerate(ends):
        part = order[start:end]
        start = end
        if len(part):
            mine = docs[part]
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            yield s, mine[first], np.diff(np.append(first, len(mine))), *(v[part] for v in values)


def small_pool() -> None:
    """Arrow uses the system's memory from here on, which gives back what is freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    give_back()


def sharded_sets(docs: DataFrame, shards: int) -> DataFrame:
    """CELLS: hashes by range, document after document; sizes of the sets go to shard + document bucket."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small_pool()
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                sets = list(shingle_sets(texts_of(part, "text")))
                sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
                hashes = np.concatenate([np.empty(0, np.uint64), *sets])
                shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
                owner = np.repeat(np.arange(len(ids)), sizes)
                rows = [
                    (s, ids[d], n, h.tobytes(), None) for s, d, n, h in by_shard(shard, owner, shards, hashes)
                ]
                for s, d, _, n in by_shard(bucket_of(ids, shards), np.arange(len(ids)), shards, sizes):
                    rows.append((shards + s, ids[d], n, None, None))
                yield cells(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null"
    ).mapInArrow(cut, CELLS)


def numbers(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The values of all lists, or of all binary cells, of a column."""
    if pa.types.is_binary(column.type):
        return np.concatenate([np.empty(0, kind), *(np.frombuffer(x.as_buffer(), dtype=kind) for x in column)])
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)


def shared_only(shards: int):
    """Of a hash range, the hashes that occur twice or more, dealt out to the documents' buckets with log2 of how often."""

    def keep(table: pa.Table) -> pa.Table:
        small_pool()
        if table["shard"][0].as_py() >= shards:
            return table.set_column(0, "shard", pa.array([table["shard"][0].as_py() - shards] * len(table), pa.int32()))
        counts, hashes = numbers(table["counts"], np.int64), numbers(table["hashes"], np.uint64)
        docs = np.repeat(numbers(table["docs"], np.int64), counts)
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        often = np.diff(np.append(first, len(ranked)))
        del ranked
        kept = order[gather(first[often > 1], often[often > 1])]
        rank = np.log2(np.repeat(often[often > 1], often[often > 1])).astype(np.uint8)
        by_doc = np.lexsort((hashes[kept], docs[kept]))
        kept, rank = kept[by_doc], rank[by_doc]
        rows = [
            (s, d, n, h.tobytes(), r.tobytes())
            for s, d, n, h, r in by_shard(bucket_of(docs[kept], shards), docs[kept], shards, hashes[kept], rank)
        ]
        return pa.Table.from_batches([cells(rows)] if rows else [], schema=table.schema)

    return keep


def document_sets(table: pa.Table) -> pa.Table:
    """SETS of the documents of a bucket: shared shingles rare first, the shared part of the prefix, and keys."""
    small_pool()
    sized = table.filter(pa.compute.is_null(table["hashes"]))
    ids, at = np.unique(numbers(sized["docs"], np.int64), return_inverse=True)
    sizes = np.bincount(at, weights=numbers(sized["counts"], np.int64), minlength=len(ids)).astype(np.int64)
    full = table.filter(pa.compute.is_valid(table["hashes"]))
    owner = np.searchsorted(ids, np.repeat(numbers(full["docs"], np.int64), numbers(full["counts"], np.int64)))
    hashes, rank = numbers(full["hashes"], np.uint64), numbers(full["ranks"], np.uint8)
    order = np.lexsort((hashes, rank, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])[: len(owner)]
    sizes -= np.bincount(owner[~new], minlength=len(ids))  # rows that repeat an id
    owner, hashes = owner[new], hashes[new]
    shared = np.bincount(owner, minlength=len(ids))
    ends = np.cumsum(shared)
    prefix = sizes - (4 * sizes + 4) // 5 + 1 - (sizes - shared)
    rows = []
    for i, doc in enumerate(ids.tolist()):
        n, k = int(sizes[i]), int(prefix[i])
        if n == 0 or k <= 0:
            rows.append((doc, n, None, None, None, None, None, None))
            continue
        tokens = hashes[ends[i] - shared[i] : ends[i]]
        rest = n - len(tokens)
        key = xxhash.xxh3_128_digest(tokens.tobytes() + n.to_bytes(8, "little")) if not rest else doc.to_bytes(8, "little", signed=True)
        group = xxhash.xxh3_128_digest(tokens[:k].tobytes() + n.to_bytes(8, "little"))
        rows.append((doc, n, rest, key, group, tokens[:k].view(np.int64), tokens.tobytes(), sketch(tokens)))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in SETS.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.table([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=names)


def shingle_table(docs: DataFrame) -> DataFrame:
    """SETS of every document, written; prefix and what follows are null where no partner can exist."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    shards = parts_for(total, SHARD_BYTES, 4)
    cut = sharded_sets(docs, shards)
    shared = cut.groupBy("shard").applyInArrow(shared_only(shards), CELLS)
    return written(shared.groupBy("shard").applyInArrow(document_sets, SETS), "shingle-sets")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: of the pairs, those with 100 * intersection >= 80 * union. Equal keys never get here twice."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small_pool()
        for batch in batches:
            keep = []
            for na, ta, nb, tb in zip(batch["na"].to_pylist(), batch["ta"], batch["nb"].to_pylist(), batch["tb"], strict=True):
                x, y = (np.frombuffer(t.as_buffer(), dtype=np.uint64) for t in (ta, tb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (na + nb - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    full = sets.select("doc_id", "n_shingles", "tokens")
    one = full.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("tokens").alias("ta"))
    two = full.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(check, "a bigint, b bigint")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), class_id (smallest id with the same set)."""
    sets = shingle_table(docs)
    live = sets.where("prefix is not null")
    classes = written(live.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.min("group_key").alias("group_key")), "classes")
    groups = classes.groupBy("group_key").agg(F.min("class_id").alias("grp"))
    members = written(classes.join(groups, "group_key").select("class_id", "grp"), "members")
    labels = written(members.select(F.col("class_id").alias("node"), F.col("class_id").alias("comp")), "labels")

    leaders = members.select(F.col("grp").alias("doc_id")).distinct()
    entries = written(
        live.select("doc_id", "n_shingles", "unshared", "prefix")
        .join(leaders, "doc_id", "left_semi")
        .select(F.col("doc_id").alias("grp"), F.col("n_shingles").alias("n"), "unshared", F.posexplode("prefix").alias("i", "token"))
        .select("token", "grp", "n", (F.col("unshared") + F.col("i")).alias("pos")),
        "entries",
    )
    inside = members.where("class_id <> grp").select(F.col("grp").alias("a"), F.col("class_id").alias("b"))
    labels = merge_components(labels, written(verified(inside, live), "links", VERIFY_ROWS))
    nodes = members.select("grp", F.col("class_id").alias("node"))
    sketches = live.select(F.col("doc_id").alias("node"), F.col("unshared").alias("rest"), "bits")
    labels = link_buckets(entries, nodes, labels, lambda pairs: verified(pairs, live), sketches)

    known = live.select("doc_id", "set_key").join(classes.select("set_key", "class_id"), "set_key").select("doc_id", "class_id")
    placed = written(known.join(labels.select(F.col("node").alias("class_id"), "comp"), "class_id"), "placed")
    return sets.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )
