"""Nearest neighbours by inner product: vantage-point trees per shard.

Inner product becomes a distance by one more component, sqrt(M^2 - |x|^2) with M the tree's largest norm,
0 for a query; then the nearest by distance are those of largest inner product. A node keeps the range of
distances to its vantage point in both halves; a half is skipped when the triangle inequality puts it
beyond the k-th best: bound * factor > distance. Factor 1 is the exact search, larger ones skip more.
How much a factor loses depends on the norms, so none is trusted: for every tree a task holds, the
first SAMPLE_QUERIES by hash of their id in the first block of queries that meets it are also compared with all
its rows, and the factor goes down the FACTORS until they have MEASURED_RECALL of their true k best there, to 1
if need be.

Vectors are dealt to shards by a hash of their id, so a vector that a third of all rows share is spread;
a shard's tree is one row of the index. Trees form groups of about GROUP_BYTES, blocks of queries form lanes of
LANE_BLOCKS: a task holds the trees of one group and streams the blocks of one lane past them, one at a time. So the
shuffle takes every tree once per lane and every query once per group. A query keeps k rows per group, and
a window takes the best k.

Defined results: vectors that are null, zero, of another length than the commonest (the greater on ties),
or hold null or non-finite components take no part, as row or query. Rows with a query's own id are no
candidates. Ties go to the smaller id. Repeated rows of one id are candidates each, and one query.
Rows without an id are left out. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausedelta.llm.common import parts_for, written
from clausedelta.llm.shingles import finish

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 2048, 128
GROUP_BYTES, LEAST_GROUPS, LANE_BLOCKS = 64 << 20, 64, 32
SAMPLE_QUERIES, MEASURED_RECALL, FACTORS = 64, 0.95, (4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25)
FOUND = "query_id bigint, vec_id bigint, score double"


class Tree:
    """Nodes (vantage point, left, right, ranges of distance of both) or leaves (rows from, to)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        squares = (vectors**2).sum(axis=1)
        self.largest = np.sqrt(squares.max())
        rest = np.sqrt(np.maximum(squares.max() - squares, 0))
        full = np.hstack([vectors, rest[:, None]])
        order, self.nodes, self.points = np.arange(len(ids)), [], []
        self.root = self.grow(full, order, 0, len(ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.points = np.array(self.points).reshape(len(self.points), vectors.shape[1])

    def grow(self, full: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        """Splits order[a:b] at the median distance, by rank, so equal vectors split too."""
        number = len(self.nodes)
        self.nodes.append((a, b))
        if b - a <= LEAF_ROWS:
            return number
        part = order[a:b]
        vantage = full[part[len(part) * 7 // 11]]
        far = np.linalg.norm(full[part] - vantage, axis=1)
        ranks = np.argsort(far, kind="stable")
        order[a:b], far = part[ranks], far[ranks]
        half = len(part) // 2
        self.points.append(vantage[:-1])
        point = len(self.points) - 1
        left, right = self.grow(full, order, a, a + half), self.grow(full, order, a + half, b)
        self.nodes[number] = (point, left, right, far[0], far[half - 1], far[half], far[-1])
        return number


class Search:
    """The k best of one tree for a block of queries."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> None:
        self.tree, self.ids, self.queries, self.k, self.factor = tree, ids, queries, k, factor
        self.base = (queries**2).sum(axis=1) + tree.largest**2
        self.far = self.distance(queries @ tree.points.T, slice(None)) if len(tree.points) else None
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.visited = 0
        self.visit(tree.root, np.arange(len(ids)))

    def distance(self, inner: np.ndarray, which: slice | np.ndarray) -> np.ndarray:
        base = self.base[which]
        return np.sqrt(np.maximum((base[:, None] if inner.ndim == 2 else base) - 2 * inner, 0))

    def visit(self, number: int, who: np.ndarray) -> None:
        if not len(who):
            return
        node = self.tree.nodes[number]
        if len(node) == 2:
            self.leaf(*node, who)
            return
        point, left, right, *ranges = node
        far = self.far[who, point]
        near_left = far <= (ranges[1] + ranges[2]) / 2
        for first, second, near, lo, hi in ((left, right, near_left, *ranges[2:]), (right, left, ~near_left, *ranges[:2])):
            mine, d = who[near], far[near]
            self.visit(first, mine)
            bound = np.maximum(np.maximum(lo - d, d - hi), 0)
            worst = self.scores[mine, -1]
            limit = np.full(len(mine), np.inf)
            full = np.isfinite(worst)
            limit[full] = self.distance(worst[full], mine[full])
            self.visit(second, mine[bound * self.factor <= limit * (1 + 1e-9) + 1e-9])

    def leaf(self, a: int, b: int, who: np.ndarray) -> None:
        self.visited += len(who) * (b - a)
        inner = self.queries[who] @ self.tree.vectors[a:b].T
        better = (inner >= self.scores[who, -1:]).any(axis=1)
        who, inner = who[better], inner[better]
        ids = np.broadcast_to(self.tree.ids[a:b], (len(who), b - a))
        inner[ids == self.ids[who][:, None]] = -np.inf
        scores, found = np.hstack([self.scores[who], inner]), np.hstack([self.found[who], ids])
        best = np.lexsort((found, -scores), axis=1)[:, : self.k]
        self.scores[who] = np.take_along_axis(scores, best, axis=1)
        self.found[who] = np.take_along_axis(found, best, axis=1)


def safe_factor(tree: Tree, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> float:
    """The largest of factor and the smaller FACTORS that keeps MEASURED_RECALL on sampled queries; else 1."""
    some = np.argsort(finish(ids.astype(np.uint64)), kind="stable")[:SAMPLE_QUERIES]
    ids, queries = ids[some], queries[some]
    inner = queries @ tree.vectors.T
    inner[tree.ids == ids[:, None]] = -np.inf
    k = min(k, inner.shape[1])
    last = -np.partition(-inner, k - 1, axis=1)[:, k - 1 : k]
    real = np.isfinite(inner).sum(axis=1).clip(max=k).sum()
    for f in (factor, *(f for f in FACTORS if f < factor)):
        scores = Search(tree, ids, queries, k, f).scores
        hits = np.isfinite(scores) & (scores >= last - 1e-9 * np.abs(np.where(np.isfinite(last), last, 0)))
        if f <= 1 or hits.sum() >= MEASURED_RECALL * real:
            return f
    return 1.0


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles): the rows that take part."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")
    ).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(good).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1)
    first = sizes.first()
    return rows.where(F.size("v") == (first["d"] if first else 0))


def build_index(rows: DataFrame) -> DataFrame:
    """shard, tree: one tree of about SHARD_ROWS vectors per row, written."""
    shards = parts_for(rows.count(), SHARD_ROWS, 1)

    def build(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        tree = Tree(ids[order], matrix(table["v"], len(ids))[order])
        raw = pickle.dumps(tree, protocol=5)
        return pa.table([table["shard"][:1], pa.array([raw], pa.binary())], names=["shard", "tree"])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInArrow(build, "shard int, tree binary"), "vantage-trees")


def query_blocks(queries: DataFrame) -> DataFrame:
    """block, ids, data: BLOCK_ROWS queries per row at most on average."""
    blocks = parts_for(queries.count(), BLOCK_ROWS, 1)

    def pack(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        flat = matrix(table["v"], len(ids))
        cells = [table["block"][:1], pa.array([ids], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary())]
        return pa.table(cells, names=["block", "ids", "data"])

    dealt = queries.dropDuplicates(["vec_id"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInArrow(pack, "block int, ids array<bigint>, data binary"), "query-blocks")


def best_of(parts: list[Search], ids: np.ndarray, k: int) -> pa.RecordBatch:
    """FOUND: the k best that the searches of several trees have found for a block."""
    scores, found = np.hstack([p.scores for p in parts]), np.hstack([p.found for p in parts])
    best = np.lexsort((found, -scores), axis=1)[:, :k]
    scores, found = np.take_along_axis(scores, best, axis=1), np.take_along_axis(found, best, axis=1)
    real = np.isfinite(scores)
    cells = [pa.array(np.repeat(ids, k)[real.ravel()]), pa.array(found[real]), pa.array(scores[real])]
    return pa.RecordBatch.from_arrays(cells, ["query_id", "vec_id", "score"])


def trees_and_blocks(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """grp, lane, block, ids, data: in every task the trees of a group (block -1), then the blocks of a lane."""
    shards, size = index.agg(F.count("*"), F.sum(F.octet_length("tree").cast("long"))).first()
    groups = max(1, min(shards, parts_for(size or 0, GROUP_BYTES, LEAST_GROUPS)))
    lanes = parts_for((blocks.agg(F.max("block")).first()[0] or 0) + 1, LANE_BLOCKS, 1)
    trees = index.select(
        F.pmod("shard", F.lit(groups)).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        F.lit(-1).alias("block"), F.lit(None).cast("array<bigint>").alias("ids"), F.col("tree").alias("data"), "shard",
    )
    queries = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.pmod("block", F.lit(lanes)).alias("lane"),
        "block", "ids", "data", F.lit(-1).alias("shard"),
    )
    rows = trees.union(queries).repartition(groups * lanes, "grp", "lane")
    return rows.sortWithinPartitions("grp", "lane", "block", "shard").drop("shard")


def search(index: DataFrame, queries: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found of every query; `factor` is the largest one tried."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trees, factors = None, [], []
        for batch in batches:
            for i in range(batch.num_rows):
                here = (batch["grp"][i].as_py(), batch["lane"][i].as_py())
                if here != place:
                    place, trees, factors = here, [], []
                data = batch["data"][i].as_buffer()
                if batch["block"][i].as_py() < 0:
                    trees.append(pickle.loads(data))
                    continue
                ids = batch["ids"][i].values.to_numpy()
                vectors = np.frombuffer(data, dtype=np.float64).reshape(len(ids), -1)
                if not factors:
                    factors = [safe_factor(t, ids, vectors, k, factor) for t in trees]
                if trees:
                    yield best_of([Search(t, ids, vectors, k, f) for t, f in zip(trees, factors, strict=True)], ids, k)

    found = written(trees_and_blocks(index, query_blocks(queries)).mapInArrow(find, FOUND), "found", batch_rows=4)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
