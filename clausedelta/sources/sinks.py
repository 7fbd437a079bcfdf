"""Tables the jobs append to. Each batch owns one partition folder, so running
a batch again replaces its rows instead of adding them twice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausedelta.session import drop_path, file_system


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str | None = None, before: int | None = None) -> DataFrame:
    """All batches of a table, or those before one; empty when there are none."""
    try:
        reader = spark.read if schema is None else spark.read.schema(f"{schema}, batch_id bigint")
        df = reader.parquet(path)
    except AnalysisException as exc:
        if schema is None or exc.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], f"{schema}, batch_id bigint")
    return df if before is None else df.where(F.col("batch_id") < before)


def batch_ids(spark: SparkSession, path: str) -> list[int]:
    """Batches whose folder is complete, ascending; one listing, no data is read."""
    files, at = file_system(spark, path)
    if not files.exists(at):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in files.listStatus(at)]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(n[9:]) for p, n in names if n.startswith("batch_id=") and files.exists(mark(p, "_SUCCESS")))


def read_batch(spark: SparkSession, path: str, schema: T.StructType | str, batch_id: int | None) -> DataFrame:
    """Rows of one batch folder, without the others being listed; none if there is no such batch."""
    if batch_id is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id}")


def newest_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    return max((b for b in batch_ids(spark, path) if b < batch_id), default=None)


def drop_older(spark: SparkSession, path: str, batch_id: int) -> None:
    """Drop the folders of a table that each batch writes anew, but the two newest up to the batch:
    the one before it serves when the batch is run again."""
    for old in [b for b in batch_ids(spark, path) if b <= batch_id][:-2]:
        drop_path(spark, f"{path}/batch_id={old}")


class Changelog:
    """Changed rows per batch over a base, the newest row per key of all batches up to its own.

    A batch holds a key once. Every ``every`` batches the base is written anew, as the folder of the batch that
    did it; its completeness mark is the pointer, so a reader sees the old base with the batches after it, or
    the new one. Folders that the base before the newest covers are dropped: a batch that is run again still
    finds what it started from. So reading costs the keys and at most 2 x ``every`` batches, however many there were.
    ``merged`` makes one row per key of the rows of several batches, told apart by batch_id; without it the newest stays.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str, every: int = 16, merged: Callable[[DataFrame], DataFrame] | None = None
    ) -> None:
        self.spark, self.path, self.key, self.every, self.merged = spark, path, key, every, merged or self.last_row

    def append(self, rows: DataFrame, batch_id: int) -> None:
        append_batch(rows, f"{self.path}/changes", batch_id)
        base = newest_before(self.spark, f"{self.path}/base", batch_id)
        if len([b for b in batch_ids(self.spark, f"{self.path}/changes") if b > (-1 if base is None else base)]) >= self.every:
            self.fold(batch_id)

    def newest(self, base: int | None, upto: int | None = None) -> DataFrame:
        after = [
            b for b in batch_ids(self.spark, f"{self.path}/changes")
            if (base is None or b > base) and (upto is None or b <= upto)
        ]
        parts = [self.spark.read.option("basePath", f"{self.path}/changes").parquet(*[f"{self.path}/changes/batch_id={b}" for b in after])] if after else []
        if base is not None:
            parts.append(self.spark.read.parquet(f"{self.path}/base/batch_id={base}").withColumnRenamed("in_batch", "batch_id"))
        rows = reduce(DataFrame.unionByName, parts)
        return rows if len(after) + (base is not None) == 1 else self.merged(rows)  # one batch holds a key once

    def last_row(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_s"))
        return best.select(self.key, "_s.*")

    def fold(self, batch_id: int) -> None:
        bases = [b for b in batch_ids(self.spark, f"{self.path}/base") if b < batch_id]
        base = bases[-1] if bases else None
        rows = self.newest(base, batch_id).withColumnRenamed("batch_id", "in_batch")
        append_batch(rows, f"{self.path}/base", batch_id)
        for table in ("changes", "base") if base is not None else ():
            for old in batch_ids(self.spark, f"{self.path}/{table}"):
                if old < base or (old == base and table == "changes"):
                    drop_path(self.spark, f"{self.path}/{table}/batch_id={old}")

    def current(self) -> DataFrame:
        bases = batch_ids(self.spark, f"{self.path}/base")
        return self.newest(bases[-1] if bases else None).drop("batch_id")


def append_snapshots(snapshots: DataFrame, path: str) -> None:
    """Append snapshot rows, partitioned by the day they were crawled."""
    dated = snapshots.withColumn("crawl_date", F.to_date("crawled_at"))
    # A day is as many files as the batch has partitions for it; a usual batch is one day.
    dated.write.mode("append").partitionBy("crawl_date").parquet(path)


def diff_rows(payloads: DataFrame) -> DataFrame:
    """Diff rows with the added and removed counts lifted out of the payload."""
    return payloads.select(
        "document_id",
        "version",
        F.concat("document_id", F.lit("-"), (F.col("version") - 1).cast("string")).alias("previous_snapshot_id"),
        F.concat("document_id", F.lit("-"), F.col("version").cast("string")).alias("current_snapshot_id"),
        F.struct(
            "strategy_used", "total_added", "total_removed", "total_modified", "added", "removed", "modified", "summary"
        ).alias("diff_payload"),
        F.col("total_added").alias("added_clauses_count"),
        F.col("total_removed").alias("removed_clauses_count"),
    )


def append_diffs(payloads: DataFrame, path: str) -> None:
    diff_rows(payloads).write.mode("append").parquet(path)
