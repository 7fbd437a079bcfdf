"""Shared folder, intermediate tables, and numbering without a one-task window."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausedelta.session import drop_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = "file://" + tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_rows: int | None = None, **options: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder.

    batch_rows: how many rows go to Python at once meanwhile, where rows are large.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key)
    if batch_rows:
        spark.conf.set(key, str(batch_rows))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(key, usual)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Drops written tables that no plan reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            drop_path(table.sparkSession, folder)


def shared_file_path(uri: str) -> str:
    """Path of a shared folder as Python sees it; memory mapping needs one that is mounted."""
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return parts.path


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null stays null. Texts of ASCII alone take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_for(n: int, per_part: int, least: int = 1) -> int:
    return max(least, -(-n // per_part))


def ranked(df: DataFrame, keys: list[str], by: str, chunks: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each key, in the order of (chunk of a hash, `by`).

    A window runs per (key, chunk) and one summary row per chunk carries the count across, so a key
    with a third of all rows is no single task. `by` must differ between rows of a key.
    """
    chunk, total, before = f"_{out}_chunk", f"_{out}_n", f"_{out}_before"
    rows = df.withColumn(chunk, F.pmod(F.xxhash64(by), F.lit(chunks)).cast("int"))
    sums = rows.groupBy(*keys, chunk).agg(F.count("*").alias(total))
    upto = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn(before, F.coalesce(F.sum(total).over(upto), F.lit(0))).drop(total)
    same = [rows[k].eqNullSafe(sums[k]) for k in [*keys, chunk]]
    joined = rows.join(sums, same, "inner").select(rows["*"], sums[before])
    within = Window.partitionBy(*keys, chunk).orderBy(by)
    number = F.row_number().over(within) - 1 + F.col(before)
    return joined.withColumn(out, number.cast("long")).drop(chunk, before)
