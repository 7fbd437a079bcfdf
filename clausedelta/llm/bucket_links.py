"""Links between the members of many small or large buckets, without the pairs of a bucket.

First each bucket's groups are tried against one leader (a star, so a thousand near copies are a thousand
pairs). Then the members of buckets that still have several components are tried in the same way, each
bucket against a member of its own, round by round while that links many of them: a round is linear in the
members, and a leader has met all it can link to and leaves its bucket. What is left after that is joined, exactly the
pairs whose components still differ and that an exact bound on the difference of their sets lets through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.common import discard, written
from clausedelta.llm.components import merge_components

STAR_ROUNDS = 3
SKETCH_LONGS = 8
FEW_LINKS = 50  # members of the open buckets for each link that a round has found, from which on they are joined at once
FEW_PAIRS = 4  # pairs of a bucket's members for each of them, from which on they are joined at once
VERIFY_ROWS = 200  # pairs of whole sets or passages in a batch
ENTRY = ("grp", "comp", "n", "pos")


def long_enough(a: str, b: str) -> Column:
    """Sizes na and nb leave room for the similarity."""
    return (F.col(a) * 5 >= F.col(b) * 4) & (F.col(b) * 5 >= F.col(a) * 4)


def overlap_possible(shared: Column, last_a: Column, last_b: Column, na: Column, nb: Column) -> Column:
    """Shared prefix shingles plus all that follows the last of them reaches the overlap asked for."""
    return (shared + F.least(na - last_a - 1, nb - last_b - 1)) * 9 >= (na + nb) * 4


def named(entries: DataFrame, x: str) -> DataFrame:
    """token and ENTRY as one side of a pair."""
    return entries.select(
        "token", F.col("grp").alias(x), F.col("comp").alias(f"comp_{x}"), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"pos_{x}")
    )


def stars(entries: DataFrame, labels: DataFrame, step: int) -> DataFrame | None:
    """a, b: in every bucket with two components, its leader and the groups of other components.

    None if no bucket has two components. The leader is drawn by a hash, anew each round.
    """
    now = written(entries.join(labels.select(F.col("node").alias("grp"), "comp"), "grp"), "entries")
    leaders = written(
        now.groupBy("token")
        .agg(
            F.min_by(F.struct("grp", "comp", "n", "pos"), F.xxhash64("grp", F.lit(step))).alias("lead"),
            F.min("comp").alias("low"), F.max("comp").alias("high"),
        )
        .where("low <> high")
        .select("token", "lead.*"),
        "leaders",
    )
    if leaders.isEmpty():
        return None
    return candidates(named(now, "a"), named(leaders, "b"), F.col("comp_a") != F.col("comp_b"))


def candidates(one: DataFrame, two: DataFrame, cond: Column) -> DataFrame:
    """Pairs of groups that share prefix shingles and pass the filters."""
    met = one.join(two, "token").where(cond & long_enough("na", "nb"))
    same = met.groupBy("a", "comp_a", "b", "comp_b", "na", "nb").agg(
        F.count("*").alias("shared"), F.max("pos_a").alias("last_a"), F.max("pos_b").alias("last_b")
    )
    return same.where(
        overlap_possible(*(F.col(c) for c in ("shared", "last_a", "last_b", "na", "nb")))
    ).select("a", "comp_a", "b", "comp_b")


def difference_possible() -> Column:
    """9 * |symmetric difference| <= na + nb is similarity 0.8; differing bits of the sketches bound it from below."""
    bits = reduce(lambda x, y: x + y, [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(SKETCH_LONGS)])
    return (bits + F.col("rest_a") + F.col("rest_b")) * 9 <= F.col("na") + F.col("nb")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the hashes by cell, 64 * SKETCH_LONGS of them: a member more or less flips one bit."""
    cells = 64 * SKETCH_LONGS
    odd = np.bincount((hashes % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def link_buckets(
    entries: DataFrame, members: DataFrame, labels: DataFrame, verify: Callable[[DataFrame], DataFrame],
    sketches: DataFrame,
) -> DataFrame:
    """Final labels (node, comp).

    entries: token, grp, n (size of the set), pos (place of the token in the set's order); members: grp,
    node, a group being nodes that meet the same buckets; labels: node, comp, each group's node grp among
    them; verify: the pairs a, b of nodes that are linked, out of candidates; sketches: node, rest (members
    of its set that no other set has), bits (sketch of the others).
    """
    for step in range(STAR_ROUNDS):
        pairs = stars(entries, labels, step)
        if pairs is None:
            break
        labels = merge_components(labels, written(verify(pairs.select("a", "b")), "links", VERIFY_ROWS))

    member_comps = written(members.join(labels, "node"), "member-comps")
    split = entries.join(member_comps.select("grp", "comp").distinct(), "grp")
    mixed = split.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    met = entries.join(mixed.select("token"), "token", "left_semi").join(member_comps, "grp").join(sketches, "node")
    left = written(met.select("token", "node", "comp", "n", "rest", "bits"), "open-entries")
    step, going = 0, many_pairs(left)
    while going:
        pairs, rest, leaders = member_stars(left, step)
        links = written(verify(pairs), "links", VERIFY_ROWS)
        found = links.count()
        labels, old = merge_components(labels, links) if found else labels, left
        left = still_mixed(rest, labels)
        discard(old, leaders, links)
        step, going = step + 1, found * FEW_LINKS > left.select("node").distinct().count() and many_pairs(left)
    rest = sided(left, "a").join(sided(left, "b"), "token").where((F.col("comp_a") < F.col("comp_b")) & may_link())
    return merge_components(labels, written(verify(rest.select("a", "b").distinct()), "links", VERIFY_ROWS))


def many_pairs(left: DataFrame) -> bool:
    """Whether a join of the buckets would compare many pairs for each of their members."""
    sizes = left.groupBy("token").agg(F.count("*").alias("k"))
    members, pairs = sizes.agg(F.sum("k"), F.sum(F.col("k") * (F.col("k") - 1) / 2)).first()
    return bool(members) and pairs > FEW_PAIRS * members


def sided(left: DataFrame, x: str) -> DataFrame:
    return left.select(
        "token", F.col("node").alias(x), F.col("n").alias(f"n{x}"), *(F.col(c).alias(f"{c}_{x}") for c in ("comp", "rest", "bits"))
    )


def may_link() -> Column:
    return long_enough("na", "nb") & difference_possible()


def member_stars(left: DataFrame, step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """a, b: of every bucket its leader and the members of other components that it may link to; the entries without
    leaders; and the leaders' table.

    The leader is drawn anew for each bucket and round, so that equal buckets try different members.
    """
    draw = F.xxhash64("token", "node", F.lit(step))
    leaders = written(left.groupBy("token").agg(F.min_by("node", draw).alias("lead")), "leaders")
    marked = left.join(leaders, "token").withColumn("_leads", F.col("node") == F.col("lead"))
    first = sided(marked.where("_leads"), "b")
    others = sided(marked.where("not _leads"), "a")
    pairs = others.join(first, "token").where((F.col("comp_a") != F.col("comp_b")) & may_link())
    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ends, marked.where("not _leads").drop("lead", "_leads"), leaders


def still_mixed(left: DataFrame, labels: DataFrame) -> DataFrame:
    """The entries with their new components, of buckets that have several of them."""
    now = left.drop("comp").join(labels.select("node", "comp"), "node")
    now = written(now.select("token", "node", "comp", "n", "rest", "bits"), "open-entries")
    mixed = now.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    left = written(now.join(mixed.select("token"), "token", "left_semi"), "open-entries")
    discard(now)
    return left
