"""Content versions of documents.

Fetches: document_id, fetch_id, fetched_at, body. Only hashes and order travel
through the shuffles below; bodies are joined back for the fetches that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.segments import segmented_last, segmented_row_number


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def document_key(source_id: Column, url: Column) -> Column:
    """Stable document id: the same source and url always give the same key."""
    return F.sha2(F.concat_ws("\x01", source_id, url), 256)


def hashed(fetches: DataFrame) -> DataFrame:
    """Metadata of fetches with the content hash, without the body."""
    return fetches.select("document_id", "fetch_id", "fetched_at", content_hash(F.col("body")).alias("content_hash"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Row of the highest version per document."""
    rest = [c for c in snapshots.columns if c != "document_id"]
    best = snapshots.groupBy("document_id").agg(F.max_by(F.struct(*rest), "version").alias("s"))
    return best.select("document_id", "s.*")


_ORDER = ["fetched_at", "fetch_id"]


def _day() -> Column:
    return F.to_date("fetched_at")


def detect_changes(fetch_hashes: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Fetches whose hash differs from the one before them in their document.

    ``latest`` (document_id, content_hash, version) is the stored state: the
    first fetch of a document is compared with it. A fetch with content seen
    before, but not last, is a change. Documents with very many fetches are
    handled by day segments.
    """
    seen = segmented_last(
        fetch_hashes, ["document_id"], _ORDER, _day(), F.col("content_hash"), "previous_hash", include_current=False
    )
    if latest is not None:
        stored = latest.select("document_id", F.col("content_hash").alias("_stored"))
        seen = seen.join(stored, "document_id", "left").withColumn(
            "previous_hash", F.coalesce("previous_hash", "_stored")
        ).drop("_stored")
    return seen.where(~F.col("content_hash").eqNullSafe(F.col("previous_hash")))


def assign_versions(changed: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Number changed fetches per document, continuing the stored versions."""
    numbered = segmented_row_number(changed, ["document_id"], _ORDER, _day(), "version")
    if latest is None:
        return numbered
    stored = latest.select("document_id", F.col("version").alias("_stored"))
    return numbered.join(stored, "document_id", "left").withColumn(
        "version", (F.col("version") + F.coalesce("_stored", F.lit(0))).cast("int")
    ).drop("_stored")


def register_documents(links: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New documents: the first title and type seen per (source_id, url)."""
    first = links.groupBy("source_id", "url").agg(
        F.min_by(F.struct("title", "document_type"), F.struct("seen_at", "title")).alias("d"),
        F.min("seen_at").alias("created_at"),
    )
    if stored is not None:
        first = first.join(stored.select("source_id", "url"), ["source_id", "url"], "left_anti")
    return first.select(
        document_key(F.col("source_id"), F.col("url")).alias("document_id"), "source_id", "url", "d.*", "created_at"
    )


def document_status(fetch_hashes: DataFrame, versions: DataFrame) -> DataFrame:
    """Current hash, last crawl and last change per document."""
    crawled = fetch_hashes.select("document_id", F.col("fetched_at").alias("crawled"), F.lit(None).cast("timestamp_ntz").alias("changed"), F.lit(None).cast("string").alias("h"), F.lit(None).cast("int").alias("version"))
    changed = versions.select("document_id", F.lit(None).cast("timestamp_ntz").alias("crawled"), F.col("fetched_at").alias("changed"), F.col("content_hash").alias("h"), "version")
    return crawled.unionByName(changed).groupBy("document_id").agg(
        F.expr("max_by(h, version) FILTER (WHERE version IS NOT NULL)").alias("current_content_hash"),
        F.max("crawled").alias("last_crawled_at"),
        F.max("changed").alias("last_changed_at"),
        F.max("version").alias("versions"),
    )
