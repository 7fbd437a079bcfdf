"""Prefix trie of conversations: one node per distinct beginning, with counts over its members and its subtree.

1. Turns become 127-bit ids (two xxhash64 of role and text) before the first shuffle; texts are not moved.
   A conversation is one row: its turns' ids and lengths in order, 20 bytes a turn.
2. Rows are dealt by ranges of (ids, conv_id). A group of equal conversations, however large, is cut by
   conv_id, and every node is a run of neighbouring rows that only the first and last row of a shard share
   with other shards.
3. In a shard, padded matrices of WIDTH turns at a time, of the rows that go that far, are lexsorted;
   change masks, OR-accumulated along the columns, mark where nodes start; reduceat adds up every depth.
4. Nodes on the path of a shard's first or last row are boundary nodes. Their smallest members and whether
   they go on are combined over the shards by key, dealt back, and then their partial sums are added.

Subtrees are not walked. With s the first depth at which a conversation is the smallest member of its node,
it stands for the nodes from s on. So a node's children are its members with s <= depth + 1 that go on, its
leaves the members that stand for a childless end, and the saved tokens of its subtree are, summed over its
members, the lengths of the turns from its own up to s - 1.

Defined results: turns are ordered by number, null first, those of equal number by id; null role or text is
empty; rows without a conv_id are left out, rows that repeat one are more turns of it. An empty table has no
nodes; a conversation without turns ends in the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta.llm.common import parts_for, written
from clausedelta.llm.segments import gather

WIDTH = 16
SHARD_TURNS = 1 << 20
PAD = -1  # below every first half of an id, so that a beginning sorts before what goes on
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
BORDER = "shard int, key binary, least bigint, goes_on boolean"
NODES = (
    "key binary, shard int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends binary, ends_sha256 string"
)


def turn_ids(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (hi, lo, chars) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"),
        F.shiftrightunsigned(F.xxhash64(F.lit(1), role, text), 1).alias("hi"),
        F.xxhash64(F.lit(2), text, role).alias("lo"), F.char_length(text).alias("chars"),
    ).where("conv_id is not null")
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "hi", "lo", "chars"))).alias("t"))
    return lists.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["hi"].alias("hi"), x["lo"].alias("lo"), x["chars"].alias("chars"))).alias("turns")
    )


def with_shared_heads(conversations: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """conv_id, turns: the first h turns are those of the family's first conversation, h = crc32(conv_id) % (most + 1)."""
    own = written(conversations, "turns")
    heads = own.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("_base"), F.slice("turns", 1, most).alias("_head")
    )
    base = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = own.withColumn("_h", h).join(heads, base == F.col("_base"), "left")
    none = F.slice("turns", 1, 0)
    head = F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return rows.select("conv_id", F.concat(head, rest).alias("turns"))


class Runs:
    """The rows of a shard in order of (ids, conv_id), and the runs of rows that are nodes, by depth."""

    def __init__(self, table: pa.Table) -> None:
        conv = table["conv_id"].to_numpy()
        by = np.argsort(conv, kind="stable")
        lists = table["ids"].combine_chunks()
        offsets = np.asarray(lists.offsets).astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)
        lens, starts = np.diff(offsets) // 2, offsets[:-1]
        chars = table["chars"].combine_chunks()
        chars_at, chars = np.asarray(chars.offsets).astype(np.int64)[:-1], chars.values.to_numpy(zero_copy_only=False)
        order, self.spans = self.sorted_runs(by, ids, starts, lens)
        self.ids, self.first_id = ids, starts[order]
        self.conv, self.lens = conv[order], lens[order]
        # upto[at + d]: code points of the first d turns of the row.
        sizes = self.lens + 1
        self.at = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), dtype=np.int64)
        flat[gather(self.at + 1, self.lens)] = chars[gather(chars_at[order], self.lens)]
        total = np.cumsum(flat)
        self.upto = total - np.repeat(total[self.at], sizes)
        self.place_of = np.argsort(self.conv, kind="stable")

    @staticmethod
    def sorted_runs(order: np.ndarray, ids: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """Row numbers in order, and per depth the places where its nodes start and end. order: by conv_id."""
        order, n = order.copy(), len(order)
        spans = [(np.zeros(1, np.int64), np.full(1, n))]
        group = np.zeros(n, dtype=np.int64)
        for left in range(0, int(lens.max(initial=0)), WIDTH):
            at = np.flatnonzero(lens[order] >= left)  # those that end here are put before those that go on
            rows = order[at]
            have = np.minimum(lens[rows] - left, WIDTH)
            matrix = np.full((len(rows), 2 * WIDTH), PAD, dtype=np.int64)
            matrix[np.arange(2 * WIDTH) < 2 * have[:, None]] = ids[gather(starts[rows] + 2 * left, 2 * have)]
            by = np.lexsort((*matrix.T[::-1], group[at]))
            order[at], matrix, have = rows[by], matrix[by], have[by]
            change = np.ones((len(rows), WIDTH), dtype=bool)
            change[1:] = (matrix[1:] != matrix[:-1]).reshape(-1, WIDTH, 2).any(axis=2)
            change[1:, 0] |= group[at][1:] != group[at][:-1]
            change = np.logical_or.accumulate(change, axis=1)
            for j in range(int(have.max())):
                marks = np.flatnonzero(change[:, j])
                ends = np.append(marks[1:], len(rows))
                live = have[marks] > j
                spans.append((at[marks[live]], at[ends[live] - 1] + 1))
            group[at] = np.cumsum(change[:, -1])
        return order, spans

    def keys(self, row: int) -> list[bytes]:
        """Digest of every beginning of a row, by depth."""
        state, found = xxhash.xxh3_128(), [xxhash.xxh3_128_digest(b"")]
        ids, at = self.ids, int(self.first_id[row])
        for d in range(int(self.lens[row])):
            state.update(ids[at + 2 * d : at + 2 * d + 2].tobytes())
            found.append(state.digest())
        return found

    def borders(self) -> Iterator[tuple[int, int, bytes]]:
        """depth, number of the node within the depth, key of the nodes that other shards may share."""
        first, last = self.keys(0), self.keys(len(self.conv) - 1)
        for depth, (a, b) in enumerate(self.spans):
            if a[0] == 0 and depth < len(first):
                yield depth, 0, first[depth]
            if b[-1] == len(self.conv) and depth < len(last) and (len(a) > 1 or a[0] > 0):
                yield depth, len(a) - 1, last[depth]

    def members(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of all members of a depth's nodes, and where each node's begin among them."""
        a, b = self.spans[depth]
        return gather(a, b - a), np.cumsum(b - a) - (b - a)

    def least(self, depth: int) -> np.ndarray:
        rows, begin = self.members(depth)
        return np.minimum.reduceat(self.conv[rows], begin)

    def goes_on(self, depth: int) -> np.ndarray:
        rows, begin = self.members(depth)
        return np.maximum.reduceat(self.lens[rows], begin) > depth


def shard_borders(table: pa.Table) -> pa.Table:
    """BORDER: what a shard knows of its boundary nodes."""
    runs, rows, known = Runs(table), [], {}
    for depth, i, key in runs.borders():
        if depth not in known:
            known = {depth: (runs.least(depth), runs.goes_on(depth))}
        least, on = known[depth]
        rows.append((key, int(least[i]), bool(on[i])))
    keys, least, on = zip(*rows, strict=True)
    shard = pa.array([table["shard"][0].as_py()] * len(rows), pa.int32())
    return pa.table([shard, pa.array(keys, pa.binary()), pa.array(least, pa.int64()), pa.array(on)], names=["shard", "key", "least", "goes_on"])


def shard_nodes(table: pa.Table, border: pa.Table) -> pa.Table:
    """NODES: whole ones without a key, and this shard's part of the boundary nodes."""
    runs = Runs(table)
    n = len(runs.conv)
    known = {k: (a, b) for k, a, b in zip(*(border[c].to_pylist() for c in ("key", "least", "goes_on")), strict=True)}
    at_border: dict[int, dict[int, bytes]] = {}
    for depth, i, key in runs.borders():
        at_border.setdefault(depth, {})[i] = key

    stands = runs.lens + 1  # the first depth at which the row is the smallest member of its node
    childless = np.zeros(n, dtype=bool)
    sorted_conv = runs.conv[runs.place_of]
    smallest = []
    for depth, (a, _) in enumerate(runs.spans):
        least, on = runs.least(depth), runs.goes_on(depth)
        for i, key in at_border.get(depth, {}).items():
            least[i], on[i] = known[key]
        smallest.append(least)
        found = np.minimum(np.searchsorted(sorted_conv, least), n - 1)
        here = runs.place_of[found[sorted_conv[found] == least]]
        stands[here] = np.minimum(stands[here], depth)
        rows, begin = runs.members(depth)
        ended = runs.lens[rows] == depth
        childless[rows[ended]] = ~np.repeat(on, np.diff(np.append(begin, len(rows))))[ended]
    leaf = (childless & (stands <= runs.lens)).astype(np.int64)
    shared = runs.upto[runs.at + np.clip(stands - 1, 0, runs.lens)]

    columns: list[list] = [[] for _ in NODES.split(", ")]
    for depth, (a, b) in enumerate(runs.spans):
        rows, begin = runs.members(depth)
        copies = stands[rows] > depth
        before = runs.upto[runs.at[a] + max(depth - 1, 0)]
        add = lambda values: np.add.reduceat(values.astype(np.int64), begin)
        saved = add(np.where(copies, shared[rows], 0)) - add(copies) * before
        children = add((stands[rows] <= depth + 1) & (runs.lens[rows] > depth))
        n_ends = add(runs.lens[rows] == depth)
        parent = [None] if not depth else smallest[depth - 1][np.searchsorted(runs.spans[depth - 1][0], a, side="right") - 1].tolist()
        keys = at_border.get(depth, {})
        ends = [
            ",".join(map(str, runs.conv[x : x + k].tolist())).encode() if k else b""
            for x, k in zip(a.tolist(), n_ends.tolist(), strict=True)
        ]
        whole = [i not in keys for i in range(len(a))]
        for column, values in zip(columns, (
            [keys.get(i) for i in range(len(a))], [table["shard"][0].as_py()] * len(a), smallest[depth].tolist(), [depth] * len(a),
            parent, (b - a).tolist(), children.tolist(), add(leaf[rows]).tolist(), saved.tolist(),
            [None if w or not e else e for w, e in zip(whole, ends, strict=True)],
            [hashlib.sha256(e).hexdigest() if w else None for w, e in zip(whole, ends, strict=True)],
        ), strict=True):
            column += values
    kinds = [pa.binary(), pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODES.split(", ")])


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends_sha256 of rows (key, ends) sorted by key and shard: one chunk in memory, whatever a node's size."""

    def digest(key: bytes, state) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    now, state = None, None
    for batch in batches:
        for key, ends in zip(batch["key"], batch["ends"], strict=True):
            if key.as_py() == now:
                state.update(b",")
            else:
                if state is not None:
                    yield digest(now, state)
                now, state = key.as_py(), hashlib.sha256()
            state.update(ends.as_buffer())
    if state is not None:
        yield digest(now, state)


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of conversations (conv_id, turns): see the module's docstring for the columns."""
    spark: SparkSession = conversations.sparkSession
    rows = written(
        conversations.select(
            "conv_id", F.flatten(F.transform("turns", lambda x: F.array(x["hi"], x["lo"]))).alias("ids"),
            F.transform("turns", lambda x: x["chars"].cast("long")).alias("chars"),
        ),
        "sequences",
    )
    turns = rows.agg(F.sum(F.size("chars"))).first()[0] or 0
    shards = parts_for(turns, shard_turns, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id())
    rows = written(ranged, "ranges")

    found = written(rows.groupBy("shard").applyInArrow(shard_borders, BORDER), "borders")
    totals = found.groupBy("key").agg(F.min("least").alias("least"), F.max("goes_on").alias("goes_on"))
    border = found.select("shard", "key").join(totals, "key")
    nodes = written(rows.groupBy("shard").cogroup(border.groupBy("shard")).applyInArrow(shard_nodes, NODES), "nodes")

    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    parts = nodes.where("key is not null")
    chunks = parts.where("ends is not null").select("key", "shard", "ends")
    hashes = chunks.repartition(F.col("key")).sortWithinPartitions("key", "shard").select("key", "ends").mapInArrow(
        hashed_ends, "key binary, ends_sha256 string"
    )
    kept = [F.min(c).alias(c) for c in columns[:3]]
    summed = parts.groupBy("key").agg(*kept, *(F.sum(c).alias(c) for c in columns[3:]))
    whole = summed.join(hashes, "key", "left").select(*columns, F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    return nodes.where("key is null").select(*columns, "ends_sha256").unionByName(whole)
