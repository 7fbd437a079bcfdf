"""One ingest batch: fetched bodies to snapshots and clause diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausedelta.functions.html import with_html_text
from clausedelta.functions.stages import with_computed
from clausedelta.functions.text import clean_text
from clausedelta.functions.urls import ingest_route
from clausedelta.operators.changes import diff_pairs, diff_payload, snapshot_pairs
from clausedelta.operators.pages import clean_multipage, raw_text
from clausedelta.operators.versions import assign_versions, content_hash, detect_changes
from clausedelta.session import Scratch
from clausedelta.sources.landing import accepted, rejected
from clausedelta.sources.sinks import append_batch, drop_older, newest_before, read_batch
from clausedelta.sources.state import KeyedState

SNAPSHOTS = (
    "document_id string, version int, content_hash string, raw_text string, cleaned_text string, "
    "crawled_at timestamp_ntz, fetch_id bigint, ocr_applied boolean"
)
LATEST = "document_id string, version int, content_hash string, in_batch bigint"
PAGES = "document_id string, fetch_id bigint, page_no int, page_text string, page_count int, ocr_applied boolean"
NO_PAGES = "no page texts"
FETCH = ["document_id", "fetch_id"]


def latest_state(spark: SparkSession, store: str) -> KeyedState:
    """Newest version, its hash and the batch that holds its snapshot, per document."""
    return KeyedState(spark, f"{store}/latest", LATEST, "document_id", "version")


def is_paged() -> Column:
    return ingest_route(F.col("url")) == "pdf"


def html_texts(fetches: DataFrame) -> DataFrame:
    """Add raw_text and cleaned_text of HTML bodies."""
    return with_computed(with_html_text(fetches, "body", "raw_text"), cleaned_text=clean_text(F.col("raw_text")))


def paged_texts(fetches: DataFrame, pages: DataFrame) -> DataFrame:
    """Add raw_text and cleaned_text from the fetches' page texts, and whether any of them was recognised."""
    by_fetch = pages.withColumn("document_id", F.concat_ws("\x01", "document_id", F.col("fetch_id").cast("string")))
    texts = clean_multipage(by_fetch).join(raw_text(by_fetch).select("document_id", "raw_text"), "document_id")
    recognised = by_fetch.groupBy("document_id").agg(F.coalesce(F.bool_or("ocr_applied"), F.lit(False)).alias("ocr_applied"))
    texts = texts.join(recognised, "document_id").select(F.col("document_id").alias("_key"), "raw_text", "cleaned_text", "ocr_applied")
    key = F.concat_ws("\x01", "document_id", F.col("fetch_id").cast("string"))
    return fetches.withColumn("_key", key).join(texts, "_key").drop("_key")


def with_page_columns(pages: DataFrame) -> DataFrame:
    """PAGES; page_count and ocr_applied are null where the extractor does not tell them."""
    types = dict(x.split() for x in PAGES.split(", "))
    have = [F.col(c) if c in pages.columns else F.lit(None) for c in types]
    return pages.select(*[c.cast(t).alias(n) for c, (n, t) in zip(have, types.items(), strict=True)])


def complete_fetches(pages: DataFrame) -> DataFrame:
    """Fetches whose page texts are there: all of page_count, or any where that is not told."""
    found = pages.groupBy(*FETCH).agg(F.count_distinct("page_no").alias("n"), F.max("page_count").alias("of"))
    return found.where("of is null or n >= of").select(*FETCH)


def ingest_batch(
    spark: SparkSession, fetches: DataFrame, store: str, batch_id: int, pages: DataFrame | None = None,
    arrived: DataFrame | None = None,
) -> None:
    """Write the batch's snapshots, diffs and rejects below ``store``.

    Page texts (PAGES, page_count and ocr_applied if known) come as ``pages``, all
    that have landed by now, or as ``arrived``, those new in this batch. Every fetch ends as a snapshot, as
    unchanged, in rejects (no body, an empty one), or it waits: a paged fetch without its page texts is
    listed in rejects once, keeps its hash in ``waiting``, and is taken by the batch in which its pages are
    complete. Arrived pages whose fetch has not come wait in ``pages``. A waiting fetch counts as crawled
    at its own time and gets the next version when it is taken.

    Order of work: hash; keep what changed against the newest state of the batch's own documents; only
    then extract, clean and compare. Previous texts are read from the batch folders that the state names.
    Other folders of the history are neither read nor listed. What batches carry over is written last;
    a batch that is run again finds what it found before.
    """
    with Scratch(spark) as scratch:
        usable = accepted(fetches)
        new = scratch.written(usable.select(*FETCH, "fetched_at", "url", content_hash(F.col("body")).alias("content_hash")), "hashes")
        waiting_schema = T.StructType([*new.schema.fields])
        waited = read_batch(spark, f"{store}/waiting", waiting_schema, newest_before(spark, f"{store}/waiting", batch_id))
        offered = new.unionByName(waited.join(new.select(*FETCH), FETCH, "left_anti"))

        at_hand = None if pages is None else with_page_columns(pages)
        if arrived is not None:
            kept = read_batch(spark, f"{store}/pages", PAGES, newest_before(spark, f"{store}/pages", batch_id))
            at_hand = scratch.written(kept.unionByName(with_page_columns(arrived)).dropDuplicates([*FETCH, "page_no"]), "pages")
        paged = offered.where(is_paged())
        ready = paged.limit(0).select(*FETCH) if at_hand is None else scratch.written(
            paged.join(complete_fetches(at_hand), FETCH, "left_semi").select(*FETCH), "ready"
        )
        lacking = scratch.written(paged.join(ready, FETCH, "left_anti"), "lacking")
        told = lacking.join(new.select(*FETCH), FETCH, "left_semi").select(*FETCH)
        kept_aside = fetches.join(told, FETCH, "left_semi").drop("body")
        append_batch(rejected(fetches).unionByName(kept_aside.withColumn("reason", F.lit(NO_PAGES))), f"{store}/rejects", batch_id)

        hashes = offered.join(lacking.select(*FETCH), FETCH, "left_anti")
        state = latest_state(spark, store)
        latest = scratch.written(state.read(batch_id, hashes), "latest")
        # As a written table its size is known: Spark broadcasts a short list of
        # changed fetches and leaves the bodies unshuffled, and joins a long one by key.
        changed = scratch.written(
            assign_versions(detect_changes(hashes, latest), latest).select(*FETCH, "fetched_at", "url", "version", "content_hash"),
            "changed",
        )
        from_html = html_texts(usable.join(changed.where(~is_paged()).select(*FETCH, "version", "content_hash"), FETCH))
        columns = [
            "document_id", "version", "content_hash", "raw_text", "cleaned_text",
            F.col("fetched_at").cast("timestamp_ntz").alias("crawled_at"), "fetch_id", "ocr_applied",
        ]
        texts = from_html.withColumn("ocr_applied", F.lit(False)).select(*columns)
        if at_hand is not None:
            mine = changed.where(is_paged())
            own = at_hand.join(mine.select(*FETCH), FETCH, "left_semi")
            texts = texts.unionByName(paged_texts(mine, own).select(*columns))
        append_batch(texts, f"{store}/snapshots", batch_id)

        fresh = read_batch(spark, f"{store}/snapshots", SNAPSHOTS, batch_id).select("document_id", "version", "cleaned_text")
        both = previous_texts(spark, store, scratch, latest, changed).unionByName(fresh)
        pairs = snapshot_pairs(both, ["cleaned_text"]).select(
            "document_id", "version", F.col("old.cleaned_text").alias("old_text"), F.col("new.cleaned_text").alias("new_text")
        )
        append_batch(diff_payload(diff_pairs(pairs).drop("old_text", "new_text")), f"{store}/diffs", batch_id)

        append_batch(lacking, f"{store}/waiting", batch_id)
        if arrived is not None:
            append_batch(at_hand.join(ready, FETCH, "left_anti"), f"{store}/pages", batch_id)
        newest = changed.groupBy("document_id").agg(
            F.max("version").alias("version"), F.max_by("content_hash", "version").alias("content_hash")
        )
        state.write(batch_id, newest.withColumn("in_batch", F.lit(batch_id).cast("long")))
        for table in ("waiting", "pages"):
            drop_older(spark, f"{store}/{table}", batch_id)


def previous_texts(spark: SparkSession, store: str, scratch: Scratch, latest: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored side of the pairs: the newest snapshot of every document that changed, out of the folders named."""
    wanted = scratch.written(latest.join(changed.select("document_id").distinct(), "document_id", "left_semi"), "previous")
    named = [r.in_batch for r in wanted.select("in_batch").distinct().collect()]  # one number per earlier batch at most
    columns = ["document_id", "version", "cleaned_text"]
    if not named:
        return spark.createDataFrame([], SNAPSHOTS).select(*columns)
    stored = spark.read.schema(SNAPSHOTS).parquet(*[f"{store}/snapshots/batch_id={b}" for b in sorted(named)])
    return stored.select(*columns).join(wanted.select("document_id", "version"), ["document_id", "version"], "left_semi")
