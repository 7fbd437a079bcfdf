"""Clause tables and clause changes between snapshots.

Snapshots: document_id, version, cleaned_text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.clauses import (
    clause_key,
    with_clause_diff,
    with_clauses,
    with_paragraphs,
    with_sections,
    with_unique_clauses,
)
from clausedelta.functions.similarity import compare_texts
from clausedelta.functions.stages import exploded


def _exploded(df: DataFrame, array: str, keep: list[str]) -> DataFrame:
    return exploded(df, array, "pos", "c", keep).select(*keep, "pos", "c.*")


def split_sections(snapshots: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """One row per numbered section of each snapshot."""
    df = with_sections(snapshots, text)
    return _exploded(df, "sections", ["document_id", "version"])


def split_paragraphs(snapshots: DataFrame, text: str = "cleaned_text") -> DataFrame:
    df = with_paragraphs(snapshots, text)
    return _exploded(df, "paragraphs", ["document_id", "version"])


def split_clauses(snapshots: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Sections where a snapshot has two or more, else paragraphs."""
    df = with_clauses(snapshots, text)
    return _exploded(df, "clauses", ["document_id", "version", "strategy"])


def unique_clauses(snapshots: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """Clauses by key: last content, first position."""
    df = with_unique_clauses(with_clauses(snapshots, text), "clauses")
    return (
        exploded(df, "unique_clauses", "_p", "u", ["document_id", "version", "strategy"])
        .select("document_id", "version", "strategy", "u.key", "u.ord", "u.clause.*")
    )


def snapshot_pairs(snapshots: DataFrame, values: list[str]) -> DataFrame:
    """Consecutive versions side by side, as structs ``old`` and ``new``.

    Versions of a document count up by one, so version v pairs with v - 1. Each
    snapshot is sent to its (at most two) pairs and grouped by (document,
    version): the input is read once and no key has more than two rows.
    """
    role = F.struct(*[F.col(v) for v in values])
    places = F.filter(
        F.array(
            F.struct(F.col("version").alias("pair"), F.lit(True).alias("is_new")),
            F.struct((F.col("version") + 1).alias("pair"), F.lit(False).alias("is_new")),
        ),
        lambda p: (p["pair"] > 1),
    )
    sent = snapshots.select("document_id", F.inline(places), role.alias("r")).withColumnRenamed("pair", "version")
    # Two rows per key leave nothing to combine before the shuffle, so it comes first.
    pairs = sent.repartition("document_id", "version").groupBy("document_id", "version").agg(
        F.first(F.when(~F.col("is_new"), F.col("r")), ignorenulls=True).alias("old"),
        F.first(F.when(F.col("is_new"), F.col("r")), ignorenulls=True).alias("new"),
    )
    return pairs.where("old is not null and new is not null")


def diff_pairs(pairs: DataFrame, old: str = "old_text", new: str = "new_text") -> DataFrame:
    """Add ``changes`` and ``strategy_used`` to rows holding both texts.

    Both sides are split, keyed and matched inside the row: after the pairing
    no clause text is shuffled again and unchanged clauses end here.
    """
    df = pairs
    for side, text in (("old", old), ("new", new)):
        df = with_clauses(df, text, f"_{side}_all", f"_{side}_strategy")
        df = with_unique_clauses(df, f"_{side}_all", f"_{side}_clauses").drop(f"_{side}_all")
    df = with_clause_diff(df, "_old_clauses", "_new_clauses")
    by_section = (F.col("_old_strategy") == "section") | (F.col("_new_strategy") == "section")
    return df.withColumn("strategy_used", F.when(by_section, "section").otherwise("paragraph")).drop(
        "_old_clauses", "_new_clauses", "_old_strategy", "_new_strategy"
    )


def snapshot_diffs(snapshots: DataFrame, text: str = "cleaned_text") -> DataFrame:
    """One row per pair: document_id, version, strategy_used, changes."""
    pairs = snapshot_pairs(snapshots, [text]).select(
        "document_id", "version", F.col(f"old.{text}").alias("old_text"), F.col(f"new.{text}").alias("new_text")
    )
    return diff_pairs(pairs).drop("old_text", "new_text")


def clause_changes(diffs: DataFrame) -> DataFrame:
    """One row per changed clause of a pair; ``ord`` counts within the pair."""
    return exploded(diffs, "changes", "ord", "c", ["document_id", "version", "strategy_used"]).select(
        "document_id", "version", "strategy_used", "ord", "c.change_type", "c.clause_key",
        "c.identifier", "c.section_number", "c.old_text", "c.new_text",
    )


def _of_kind(kind: str) -> Column:
    return F.filter(F.col("changes"), lambda c: c["change_type"] == kind)


def diff_summary(added: Column, removed: Column, modified: Column) -> Column:
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" clause(s) {word}")))
    text = F.concat_ws(", ", part(added, "added"), part(removed, "removed"), part(modified, "modified"))
    return F.when(text == "", "No statutory changes detected").otherwise(text)


def diff_payload(diffs: DataFrame) -> DataFrame:
    """Counts, the three clause arrays and the summary of every pair."""
    df = diffs
    for kind in ("added", "removed", "modified"):
        df = df.withColumn(kind, _of_kind(kind)).withColumn(f"total_{kind}", F.size(kind))
    return df.withColumn(
        "summary", diff_summary(F.col("total_added"), F.col("total_removed"), F.col("total_modified"))
    ).drop("changes")


def score_changes(changes: DataFrame, autojunk: bool = True) -> DataFrame:
    """Add similarity_score and word_deltas; only modified clauses are compared."""
    modified = F.col("change_type") == "modified"
    texts = [F.when(modified, F.col(c)) for c in ("old_text", "new_text")]
    return changes.withColumn("_s", compare_texts(*texts, autojunk)).select(
        *changes.columns, F.col("_s.similarity").alias("similarity_score"), F.col("_s.deltas").alias("word_deltas")
    )


def keyed(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("clause_key", clause_key(F.col("identifier")))
