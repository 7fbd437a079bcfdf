"""Balanced label propagation: documents move to the shards of those they are linked with.

Linked nodes start spread evenly. A node wishes to be in the shard where most of its neighbours are. Every link
points from the node of lower rank (fewer links, then hash) to the one of higher rank, and rounds take turns: in
one, nodes move that have a neighbour of higher rank where they wish to go, in the next the others, so that
two partners never swap places and the leaves of a star follow its centre in one round. Those that follow a node with
more links than a shard has rows come last, or they would take the room of groups that fit. A shard grants what its
row quota allows. Rounds go on until no node has a wish, until no turn is granted any (nothing would ever
change then), or until as many rounds as `rounds` in a row have not lowered the number of wishes:
then quotas stand against the rest. Nodes without links fill the room that is left, so shard
sizes differ by one row at most. Votes are joins and map-side aggregates; only the counts per
(from, to) pair of shards, shards^2 numbers, reach the driver.

Defined results: null, empty and repeated rows are rows like others; nodes of an edge that the node
table lacks are ignored, as are self-links; ties of votes go to the current shard, then the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausedelta.llm.common import discard, parts_for, ranked, written

CHUNK_ROWS = 50_000
FOLLOWS, CROWDS, LEADS = 0, 1, 2  # turns: led by a node of higher rank, by one whose neighbours fit no shard, by none


def quotas(wanted: dict[tuple[int, int], int], held: list[int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of each (from, to) wish are granted so that no shard exceeds its room."""
    granted = {k: n for k, n in wanted.items() if k[0] != k[1]}
    while True:
        now = list(held)
        for (a, b), n in granted.items():
            now[a] -= n
            now[b] += n
        over = [(s, now[s] - room[s]) for s in range(len(room)) if now[s] > room[s]]
        if not any(n for (_, b), n in granted.items() for s, _ in over if s == b):
            return granted
        for shard, excess in over:
            for key in sorted(k for k in granted if k[1] == shard):
                cut = min(excess, granted[key])
                granted[key] -= cut
                excess -= cut


def by_pair(table: dict[tuple[int, int], int], a: str, b: str) -> Column:
    """Lookup in a table of at most shards^2 numbers."""
    cells = [x for (i, j), n in table.items() for x in (F.lit(f"{i},{j}"), F.lit(n))]
    if not cells:
        return F.lit(0)
    return F.coalesce(F.element_at(F.create_map(*cells), F.concat_ws(",", a, b)), F.lit(0))


def links_both_ways(edges: DataFrame, cap: int) -> DataFrame:
    """src, dst, turn: every link in both directions, self-links left out; cap: rows of a shard."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = written(both.where("src <> dst"), "edges")
    ranks = written(both.groupBy("src").agg(F.struct(F.count("*").alias("links"), F.xxhash64("src"), F.col("src")).alias("rank")), "ranks")
    of_dst = ranks.select(F.col("src").alias("dst"), F.col("rank").alias("dst_rank"))
    led = F.when(F.col("dst_rank.links") < cap, FOLLOWS).otherwise(CROWDS)
    turn = F.when(F.col("dst_rank") > F.col("rank"), led).otherwise(LEADS)
    return written(both.join(ranks, "src").join(of_dst, "dst").select("src", "dst", turn.alias("turn")), "edges")


def wishes_of(both: DataFrame, labels: DataFrame) -> DataFrame:
    """src, from_shard, to_shard, turn: of the nodes that wish to move."""
    near = labels.select(F.col("node").alias("dst"), F.col("shard").alias("to_shard"))
    votes = both.join(near, "dst").groupBy("src", "to_shard").agg(F.count("*").alias("votes"), F.min("turn").alias("turn"))
    mine = labels.select(F.col("node").alias("src"), F.col("shard").alias("from_shard"))
    best = Window.partitionBy("src").orderBy(
        F.desc("votes"), F.desc(F.col("to_shard") == F.col("from_shard")), F.asc("to_shard")
    )
    first = votes.join(mine, "src").withColumn("place", F.row_number().over(best)).where("place = 1")
    return written(first.where("to_shard <> from_shard").select("src", "from_shard", "to_shard", "turn"), "wishes")


def propagate(linked: DataFrame, edges: DataFrame, caps: list[int], rounds: int, chunks: int) -> DataFrame:
    """linked: node, distinct; edges: src, dst, each link once. Gives node, shard within the caps."""
    shards = len(caps)
    labels = written(
        ranked(linked.select("node"), [], "node", chunks, "r").select(
            "node", F.pmod("r", F.lit(shards)).cast("int").alias("shard")
        ),
        "labels",
    )
    both = links_both_ways(edges, max(caps, default=0))
    held = [0] * shards
    for r in labels.groupBy("shard").count().collect():
        held[r[0]] = r[1]
    turn, fewest, stale = LEADS, float("inf"), 0
    while True:
        wishes = wishes_of(both, labels)
        counts = wishes.groupBy("turn", "from_shard", "to_shard").count().collect()
        left = sum(r["count"] for r in counts)
        fewest, stale = (left, 0) if left < fewest else (fewest, stale + 1)
        if not left or stale >= rounds:
            return labels
        for turn in (LEADS, FOLLOWS, CROWDS) if turn == FOLLOWS else (FOLLOWS, LEADS, CROWDS):
            wanted = {(r[1], r[2]): r[3] for r in counts if r[0] == turn}
            granted = quotas(wanted, held, caps)
            if any(granted.values()):
                break
        else:
            return labels
        moves = wishes.where(F.col("turn") == turn).select("src", "from_shard", "to_shard")
        if granted != wanted:
            moves = ranked(moves, ["from_shard", "to_shard"], "src", chunks, "r").where(
                F.col("r") < by_pair(granted, "from_shard", "to_shard")
            )
        old, labels = labels, written(
            labels.join(moves.select(F.col("src").alias("node"), "to_shard"), "node", "left").select(
                "node", F.coalesce("to_shard", "shard").cast("int").alias("shard")
            ),
            "labels",
        )
        discard(old, wishes)
        for (a, b), n in granted.items():
            held[a] -= n
            held[b] += n


def assign(nodes: DataFrame, edges: DataFrame, shards: int, rounds: int = 8) -> DataFrame:
    """nodes: node (distinct, not null) and other columns; edges: src, dst. Adds shard and slot.

    Rows per shard differ by one at most, slots are gapless from 0.
    """
    total = nodes.count()
    chunks = parts_for(total, CHUNK_ROWS, 8)
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    linked = written(nodes.select("node").join(ends, "node", "left_semi"), "linked")
    labels = propagate(linked, edges, caps, rounds, chunks)
    room = list(caps)
    for r in labels.groupBy("shard").count().collect():
        room[r[0]] -= r[1]
    free = ranked(nodes.select("node").join(linked, "node", "left_anti"), [], "node", chunks, "r")
    bound, cases = 0, None
    for s in range(shards):
        bound += room[s]
        cases = F.when(F.col("r") < bound, s) if cases is None else cases.when(F.col("r") < bound, s)
    placed = labels.union(free.select("node", cases.cast("int").alias("shard")))
    return ranked(written(nodes.join(placed, "node"), "placed"), ["shard"], "node", chunks, "slot")


def equal_text_links(nodes: DataFrame) -> DataFrame:
    """nodes: node, digest. A star per group of equal digests, not its pairs; null digests have no links."""
    groups = nodes.where("digest is not null").groupBy("digest").agg(
        F.min("node").alias("dst"), F.count("*").alias("n")
    )
    stars = nodes.select(F.col("node").alias("src"), "digest").join(groups.where("n > 1").drop("n"), "digest")
    return stars.where("src <> dst").select("src", "dst")


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes, null: 0, plus 8), text_crc32, shard, slot; equal texts are linked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.monotonically_increasing_id().alias("node"),
        ),
        "nodes",
    )
    edges = written(equal_text_links(nodes), "links")
    return assign(nodes.drop("digest"), edges, shards, rounds).drop("node")
