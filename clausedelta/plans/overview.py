"""One row of figures over sources, subscribers and revenue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.operators.billing import revenue, subscriber_buckets
from clausedelta.operators.health import health_counts


def overview(sources: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """The one-row aggregates side by side, as named figures folded into a row."""
    parts = (
        health_counts(sources).withColumnRenamed("total", "total_sources"),
        subscriber_buckets(subscriptions).select(
            F.col("total").alias("total_subscribers"), F.col("active").alias("active_subscribers"),
            F.col("past_due").alias("past_due_subscribers"), F.col("cancelled").alias("cancelled_subscribers"),
        ),
        revenue(subscriptions, plans),
    )
    figures = [
        p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("value")) for c in p.columns])))
        for p in parts
    ]
    rows = reduce(DataFrame.unionByName, figures)
    names = [c for p in parts for c in p.columns]
    return rows.agg(*[
        F.max(F.when(F.col("figure") == n, F.col("value"))).cast("double" if n in ("mrr", "arr") else "bigint").alias(n)
        for n in names
    ])
