"""Session helpers: local test session, shared work folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clausedelta")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master that
    names none gets a temporary folder; anywhere else that is an error, as
    executors would each write to a disk of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    current = getattr(spark, "_clausedelta_work_root", None)
    if current is None:
        current = tempfile.mkdtemp(prefix="clausedelta-")
        spark.sparkContext.setCheckpointDir(current)
        spark._clausedelta_work_root = current
    return current


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; runs never overwrite each other."""
    return f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where a result feeds several branches of a plan: it is computed once
    and survives the loss of executors.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def drop_path(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


class Scratch:
    """Intermediate tables of one job, dropped when it has written its results."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, work_path(spark, "scratch")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        drop_path(self.spark, self.root)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
