"""Streaming forms of the three feeds that arrive continuously."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clausedelta.operators.billing import default_next_billing, fold_subscriptions, normalize_events
from clausedelta.plans.ingest import ingest_batch
from clausedelta.sources.sinks import Changelog, append_batch, drop_older, newest_before, read_batch


def table_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """A Parquet table as a stream of its files, be it one file or a folder of them.

    The last letter as a class makes the path a pattern with one match. A stream of a pattern lists that
    match, file or folder; a plain path would have to be a folder.
    """
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def stream_ingest(
    fetches: DataFrame, store: str, checkpoint: str,
    pages: DataFrame | Callable[[SparkSession], DataFrame] | None = None,
) -> StreamingQuery:
    """Run every micro-batch of landed fetches through the ingest batch.

    ``pages`` is a second stream, of page texts: both inputs go into the same batches, and whichever side
    of a paged document comes first waits in the store for the other. A function that reads all page texts
    landed so far may stand in for it. A repeated batch id replaces its own output, so a restart is safe.
    """
    if not isinstance(pages, DataFrame):
        def run(batch: DataFrame, batch_id: int) -> None:
            spark = batch.sparkSession
            ingest_batch(spark, batch, store, batch_id, None if pages is None else pages(spark))

        both = fetches
    else:
        one, two = (F.struct(*df.columns) for df in (fetches, pages))
        none = lambda df: F.lit(None).cast(df.schema)
        both = fetches.select(one.alias("fetch"), none(pages).alias("page")).unionByName(
            pages.select(none(fetches).alias("fetch"), two.alias("page"))
        )

        def run(batch: DataFrame, batch_id: int) -> None:
            rows, texts = (batch.where(F.col(c).isNotNull()).select(f"{c}.*") for c in ("fetch", "page"))
            ingest_batch(batch.sparkSession, rows, store, batch_id, arrived=texts)

    return (
        both.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_deduped_events(deliveries: DataFrame, path: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """First delivery of each event id that arrives within the delay.

    Events without an id are told apart by their delivery. For the outcome of
    later deliveries see stream_event_outcomes.
    """
    typed = normalize_events(deliveries).withColumn("event_time", F.col("received_at").cast("timestamp"))
    keyed = typed.withColumn(
        "dedupe_key", F.coalesce(F.concat(F.lit("e"), F.col("event_id")), F.concat(F.lit("d"), F.col("delivery_id").cast("string")))
    )
    unique = keyed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["dedupe_key"])
    return (
        unique.drop("dedupe_key", "event_time").writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# Of one event and batch, besides its first delivery and its last outcome: what folds it with the event's other batches.
FOLDED = ["last_at", "last_id", "gone_before"]


def batch_outcomes(typed: DataFrame, gone_before: int | None) -> DataFrame:
    """A row per event of one batch: data of its first delivery, result and error of its last, their number.

    Keys without a delivery since ``gone_before`` (ms) had left the state when the batch began.
    """
    rest = [c for c in typed.columns if c not in ("result", "error_detail")]
    key = F.coalesce(F.concat(F.lit("e"), F.col("event_id")), F.concat(F.lit("d"), F.col("delivery_id").cast("string")))
    order = F.struct("received_at", "delivery_id")
    folded = typed.withColumn("dedupe_key", key).groupBy("dedupe_key").agg(
        F.min_by(F.struct(*rest), order).alias("_first"),
        F.max_by(F.struct("result", "error_detail", F.col("received_at").alias("last_at"), F.col("delivery_id").alias("last_id")), order).alias("_last"),
        F.count("*").alias("deliveries"),
    )
    return folded.select("dedupe_key", "_first.*", "_last.*", "deliveries", F.lit(gone_before).cast("long").alias("gone_before"))


def fold_outcomes(rows: DataFrame) -> DataFrame:
    """One row per event of the rows of its batches. An event that had left the state counts as new from that batch on.

    Batches take no delivery older than the watermark, so whatever comes after a key has gone is later than all before.
    """
    rest = [c for c in rows.columns if c not in ("dedupe_key", "result", "error_detail", "deliveries", "batch_id", *FOLDED)]
    of_key = Window.partitionBy("dedupe_key")
    before = F.max(_millis("last_at")).over(of_key.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1))
    started = F.max(F.when(F.col("_before") < F.col("gone_before"), F.col("batch_id"))).over(of_key)
    kept = rows.withColumn("_before", before).withColumn("_started", started).where("_started is null or batch_id >= _started")
    folded = kept.groupBy("dedupe_key").agg(
        F.min_by(F.struct(*rest), F.struct("received_at", "delivery_id")).alias("_first"),
        F.max_by(F.struct("result", "error_detail", *FOLDED), F.struct("last_at", "last_id")).alias("_last"),
        F.sum("deliveries").alias("deliveries"), F.max("batch_id").alias("batch_id"),
    )
    return folded.select("dedupe_key", "_first.*", "_last.*", "deliveries", "batch_id").select(*rows.columns)


def _millis(time: str) -> Column:
    return F.unix_millis(F.col(time).cast("timestamp"))


def _outcomes(spark: SparkSession, path: str, every: int = 16) -> Changelog:
    return Changelog(spark, path, "dedupe_key", every, fold_outcomes)


def stream_event_outcomes(deliveries: DataFrame, path: str, checkpoint: str, delay: str = "2 days", every: int = 16) -> StreamingQuery:
    """One row per event as a changelog: the data of its first delivery, result and error of its last, their number.

    A batch is folded by an aggregate and written as what it adds; readers fold an event's batches, so no state
    of all events is held or read by a batch. ``seen`` holds the latest delivery time so far: deliveries that are
    later than it by the delay are dropped, as in stream_deduped_events, and an event whose last delivery the
    watermark has passed by the delay counts as new.
    """
    typed = normalize_events(deliveries)
    millis = deliveries.sparkSession.sql(f"select unix_millis(timestamp_millis(0) + interval {delay})").first()[0]

    def append(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, f"{path}/seen"
        before = read_batch(spark, seen, "at bigint", newest_before(spark, seen, batch_id)).agg(F.max("at")).first()[0]
        passed = None if before is None else before - millis
        if passed is not None:
            batch = batch.where(F.coalesce(_millis("received_at") > passed, F.lit(True)))
        log = _outcomes(spark, path, every)
        log.append(batch_outcomes(batch, None if passed is None else passed - millis), batch_id)
        newest = read_batch(spark, f"{path}/changes", "last_at timestamp_ntz", batch_id).agg(F.max(_millis("last_at"))).first()[0]
        at = max((x for x in (before, newest) if x is not None), default=None)
        append_batch(spark.range(1, numPartitions=1).select(F.lit(at).cast("long").alias("at")), seen, batch_id)
        drop_older(spark, seen, batch_id)

    return (
        typed.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return _outcomes(spark, path).current().drop("dedupe_key", *FOLDED)


def stream_subscriptions(deliveries: DataFrame, path: str, checkpoint: str, every: int = 16) -> StreamingQuery:
    """Keep the state of every subscription as a changelog.

    The same fold as in batch, as a streaming aggregate: events are combined
    inside each task before the shuffle, the state holds one row per
    subscription, and the order of arrival does not matter.
    """
    state = fold_subscriptions(default_next_billing(normalize_events(deliveries)))
    return (
        state.writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: Changelog(batch.sparkSession, path, "subscription_id", every).append(batch, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Newest state per subscription of the changelog."""
    return Changelog(spark, path, "subscription_id").current()
