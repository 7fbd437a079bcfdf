"""Landed inputs: fetched pages, paged texts and raw files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched responses as parquet; columns and filters reach the scan."""
    return spark.read.parquet(path)


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw files as url, body and fetch time; the content stays binary."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("url"), F.col("content").alias("body"), F.col("modificationTime").alias("fetched_at"), "length"
    )


def accepted(fetches: DataFrame, body: str = "body") -> DataFrame:
    """Fetches with a usable body: present and not empty, of any size."""
    return fetches.where(F.coalesce(F.length(body), F.lit(0)) > 0)


def rejected(fetches: DataFrame, body: str = "body") -> DataFrame:
    """Fetches that are kept aside, with the reason."""
    n = F.length(body)
    reason = F.when(n.isNull(), "no body").when(n == 0, "empty body")
    return fetches.withColumn("reason", reason).where("reason is not null").drop(body)
