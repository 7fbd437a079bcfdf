"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. A batch is folded to
one row per digest in the map tasks, anti-joined with the index by sort-merge (the index side is read
in its buckets, without a shuffle), and what is new is appended in the same buckets. Each batch adds a
file per bucket; `compact` makes one sorted file of them again, so that the merge needs no sort.

Defined results: null text counts as empty. Of equal texts in one batch the largest id stays; a text
that an earlier batch has put into the index keeps the id stored there. `deduplicated` deals a corpus to
batches by descending id, so the largest id stays. A null id loses against any other. Rows that repeat an id
share its decision. An empty batch gives no rows and changes nothing. Columns of the input other than id and
text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta.llm.common import ascii_lower, parts_for, work_path, written
from clausedelta.session import drop_path

INDEX_SCHEMA = "digest binary, keep_id bigint, batch string"
BUCKET_ROWS = 2_000_000  # about 100 MB
BATCHES = 4


def digests_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of every row, written."""
    text = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")


class DigestIndex:
    """A table of the catalogue, its files below `path`. `buckets` is fixed at creation: BUCKET_ROWS rows each at the most."""

    def __init__(self, spark: SparkSession, table: str, buckets: int, path: str | None = None) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets
        self.path = path or work_path(spark, table)
        if spark.catalog.tableExists(f"{table}_compacted") and not spark.catalog.tableExists(table):
            self._put_compacted()  # a compaction that broke off in its last step
        if not spark.catalog.tableExists(table):
            self._append(spark.createDataFrame([], INDEX_SCHEMA))

    def _write(self, rows: DataFrame, table: str, path: str, mode: str) -> None:
        (
            rows.write.mode(mode).format("parquet").option("path", path).bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(table)
        )

    def _append(self, rows: DataFrame) -> None:
        exists = self.spark.catalog.tableExists(self.table)
        path = self.spark.sql(f"describe formatted {self.table}").where("col_name = 'Location'").first()[1] if exists else self.path
        self._write(rows, self.table, path, "append")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def compact(self) -> None:
        """One sorted file per bucket again, in a new folder that takes the table's name."""
        bucketed = self.rows().repartition(self.buckets, "digest")
        self._write(bucketed, f"{self.table}_compacted", f"{self.path}-{uuid.uuid4().hex}", "overwrite")
        self.spark.sql(f"drop table {self.table}")
        self._put_compacted()

    def _put_compacted(self) -> None:
        self.spark.sql(f"alter table {self.table}_compacted rename to {self.table}")

    def drop(self) -> None:
        folder = self.spark.sql(f"describe formatted {self.table}").where("col_name = 'Location'").first()[1]
        self.spark.sql(f"drop table {self.table}")
        drop_path(self.spark, folder)

    def add_digests(self, groups: DataFrame, batch: str) -> None:
        """groups: digest, batch_keep, a digest once. Those that the index has not are appended."""
        bucketed = groups.repartition(self.buckets, "digest")
        fresh = bucketed.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", F.col("batch_keep").alias("keep_id"), F.lit(batch).alias("batch")))

    def decided(self, digests: DataFrame, groups: DataFrame) -> DataFrame:
        """One row per digests row: id, digest, keep_id, group_size, kept. groups: digest, group_size."""
        found = written(
            groups.select("digest", "group_size").repartition(self.buckets, "digest")
            .join(self.rows().select("digest", "keep_id").hint("merge"), "digest").select("digest", "keep_id", "group_size"),
            "digest-found",
        )
        # Both sides are plain tables, so a digest with a third of all rows is a skew join that Spark splits.
        return digests.join(found, "digest").select(
            "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
        )

    def add(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; one row per input row: id, digest, keep_id, group_size (copies in this batch), kept."""
        digests = digests_of(docs, id_col, text_col)
        groups = written(folded(digests), "digest-groups")
        self.add_digests(groups, batch)
        return self.decided(digests, groups)


def folded(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("doc_id").alias("batch_keep"), F.count("*").alias("group_size"))


def deduplicated(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """A whole corpus through an index of its own, in batches of descending ids: doc_id, digest, keep_id,
    group_size (copies in the corpus), kept. Batches after the first meet what the ones before have put in."""
    spark = docs.sparkSession
    digests = digests_of(docs)
    buckets = parts_for(digests.count(), BUCKET_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / batches for i in range(1, batches)]
    cuts = digests.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in shares]))).first()[0] or []
    index = DigestIndex(spark, f"digests_{uuid.uuid4().hex}", buckets)
    number = sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    placed = written(
        digests.groupBy("digest", number.alias("part")).agg(F.max("doc_id").alias("batch_keep"), F.count("*").alias("group_size")),
        "digest-groups",
    )
    for part in range(len(cuts), -1, -1):
        index.add_digests(placed.where(F.col("part") == part), f"batch {part}")
        if part:
            index.compact()
    rows = index.decided(digests, placed.groupBy("digest").agg(F.sum("group_size").alias("group_size")))
    index.drop()
    return rows
