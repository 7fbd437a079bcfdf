"""One crawl run as one job: catalogue, registration, ingest and the run's own record.

Tables below the store, one folder per run, so that a run that is repeated replaces its own rows:

* ``sources``: the whole catalogue as of the run (a list people keep; older ones are dropped);
* ``documents``: those the run registered, ``registered``: which exist (see KeyedState);
* ``snapshots``, ``diffs``, ``rejects`` and the ingest's state;
* ``runs`` and ``run_failures``: totals with the diffs really created, and the sources that failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta.operators.health import run_failures, run_summary, source_results
from clausedelta.operators.versions import register_documents
from clausedelta.plans.ingest import ingest_batch
from clausedelta.session import Scratch
from clausedelta.sources.catalogue import upsert_sources
from clausedelta.sources.sinks import append_batch, drop_older, newest_before, read_batch
from clausedelta.sources.state import KeyedState


def upsert_catalogue(spark: SparkSession, store: str, run: int, incoming: DataFrame) -> DataFrame:
    """Merge the run's source list into the stored one; ids of known sites stay."""
    rows = incoming.dropDuplicates(["base_url"])
    stored = read_batch(spark, f"{store}/sources", rows.schema, newest_before(spark, f"{store}/sources", run))
    append_batch(upsert_sources(stored, rows).drop("action").select(*[c for c in rows.columns]), f"{store}/sources", run)
    drop_older(spark, f"{store}/sources", run)
    return spark.read.schema(rows.schema).parquet(f"{store}/sources/batch_id={run}")


def register_new(spark: SparkSession, store: str, run: int, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents seen for the first time. Only the state's parts that the run's links fall into are read."""
    state = KeyedState(spark, f"{store}/registered", "document_id string, in_run bigint", "document_id", "in_run")
    seen = scratch.written(register_documents(links), "seen")
    new = seen.join(state.read(run, seen), "document_id", "left_anti")
    append_batch(new, f"{store}/documents", run)
    fresh = read_batch(spark, f"{store}/documents", seen.schema, run)
    state.write(run, fresh.select("document_id", F.lit(run).cast("long").alias("in_run")))
    return fresh


def crawl_run(
    spark: SparkSession, store: str, run: int, catalogue: DataFrame, links: DataFrame, fetches: DataFrame, log: DataFrame,
    pages: DataFrame | None = None, arrived: DataFrame | None = None,
) -> DataFrame:
    """Run everything of one crawl and give its row of ``runs``.

    ``catalogue``: the configured sources; ``links``: source_id, url, title, document_type, seen_at of what the
    crawl found; ``fetches`` and page texts as in ingest_batch; ``log``: the crawl's log lines as in source_results,
    all of this run. A source that fails has no fetches; the others go through.
    """
    with Scratch(spark) as scratch:
        upsert_catalogue(spark, store, run, catalogue)
        registered = register_new(spark, store, run, links, scratch)
        ingest_batch(spark, fetches, store, run, pages, arrived)
        results = scratch.written(source_results(log), "results")
        append_batch(run_failures(results), f"{store}/run_failures", run)
        diffs = spark.read.parquet(f"{store}/diffs/batch_id={run}")
        summary = run_summary(results).withColumns({
            "diffs_created": diffs.agg(F.count("*")).scalar(), "documents_registered": registered.agg(F.count("*")).scalar(),
        })
        append_batch(summary, f"{store}/runs", run)
    return spark.read.schema(summary.schema).parquet(f"{store}/runs/batch_id={run}")
