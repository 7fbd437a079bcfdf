"""Search over stored snapshots and diffs: an inverted index by term bucket, texts read for the rows shown only.

Layout below the root, one folder per batch so that a repeated batch replaces its own rows:

* ``snapshots``, ``diffs``: the rows. Diffs carry their searched text, computed once when they are stored.
* ``snapshots_index``, ``diffs_index``: partitioned by bucket of the term and sorted by term, one row per term
  and slice of the batch's rows: the ids in order, and how often the term occurs in each.

A search opens the buckets of its words (partition filters), in them the row groups of the words (the files
are sorted by term), and intersects the lists slice by slice, the shortest first. No slice holds more than
SLICE_ROWS ids, so a term that every row has is a row per slice and no large group.

What is found travels as keys with the place of its row: file and position. Only the rows shown, ``limit`` at
most, come to the driver as keys, and their texts are read from the files and row groups that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta.operators.search import DEFAULT_LIMIT, diff_text, term_index, tokens
from clausedelta.session import drop_path
from clausedelta.sources.sinks import append_batch, batch_ids

BUCKETS = 64
SLICE_ROWS = 200_000
PLACE = ["_file", "_row"]


@dataclass(frozen=True)
class Side:
    name: str
    text: str
    at: str


SNAPSHOTS, DIFFS = Side("snapshots", "cleaned_text", "crawled_at"), Side("diffs", "diff_text", "generated_at")


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def posting_lists(rows: DataFrame, text: str, slices: int, buckets: int) -> DataFrame:
    """bucket, term, slice, ids (ascending), tfs: the lists of every term, cut by slices of the rows.

    Postings are shuffled once, to the place where their list is written: lists are not shuffled again.
    """
    place = {"bucket": term_bucket(F.col("term"), buckets), "slice": F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")}
    dealt = term_index(rows, ["id"], text).repartition(*place.values()).withColumns(place)
    lists = dealt.groupBy("bucket", "slice", "term").agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("l"))
    return lists.select("bucket", "term", "slice", F.col("l.id").alias("ids"), F.col("l.tf").alias("tfs"))


class SearchStore:
    """``buckets`` belongs to a store and never changes."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root, buckets

    # --- writing

    def add(self, batch_id: int, snapshots: DataFrame | None = None, diffs: DataFrame | None = None, index: bool = True) -> None:
        """Store the batch's rows (with an id column each) and the lists of their terms."""
        for side, rows in ((SNAPSHOTS, snapshots), (DIFFS, diffs)):
            if rows is None:
                continue
            append_batch(diff_text(rows) if side is DIFFS else rows, f"{self.root}/{side.name}", batch_id)
            if index:
                self.add_lists(side, batch_id)

    def add_lists(self, side: Side, batch_id: int) -> None:
        rows = self.spark.read.parquet(f"{self.root}/{side.name}/batch_id={batch_id}")
        slices = max(1, -(-rows.count() // SLICE_ROWS))  # from the files' footers
        self.write_lists(side, batch_id, posting_lists(rows, side.text, slices, self.buckets))

    def write_lists(self, side: Side, batch_id: int, dealt: DataFrame) -> None:
        """The lists come dealt by bucket and slice, a bucket to as many files as it has slices: a hot bucket is no single task."""
        path = f"{self.root}/{side.name}_index/batch_id={batch_id}"
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def merge_lists(self, side: Side, batch_id: int) -> None:
        """Fold the lists of all batches up to this one into its folder, so that searches open fewer files.

        Slices keep their size: each batch's are numbered on. A merge that breaks off is repeated; until the
        last step the batches stand as they were, and the step itself is the new folder in the old one's place.
        """
        path = f"{self.root}/{side.name}_index"
        old = [b for b in batch_ids(self.spark, path) if b <= batch_id]
        if len(old) < 2:
            return
        lists = self.lists(side).where(F.col("batch_id").isin(*old))
        per_batch = lists.groupBy("batch_id").agg((F.max("slice") + 1).alias("n")).collect()  # one row per batch
        upto, first = 0, {}
        for r in sorted(per_batch):
            first[r.batch_id], upto = upto, upto + r.n
        offset = reduce(lambda c, b: c.when(F.col("batch_id") == b, first[b]), first, F.when(F.lit(False), 0))
        merged = lists.withColumn("slice", F.col("slice") + offset).select("term", "slice", "ids", "tfs")
        aside = f"{self.root}/merging"
        merged.write.mode("overwrite").parquet(aside)
        bucket = term_bucket(F.col("term"), self.buckets)
        self.write_lists(side, batch_id, self.spark.read.parquet(aside).withColumn("bucket", bucket).repartition("bucket", "slice"))
        for b in old[:-1]:
            drop_path(self.spark, f"{path}/batch_id={b}")
        drop_path(self.spark, aside)

    # --- reading

    def rows(self, side: Side) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{side.name}")

    def lists(self, side: Side) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{side.name}_index")

    def postings(self, side: Side) -> DataFrame:
        """id, term, tf: the stored lists as rows."""
        zipped = F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf")))
        return self.lists(side).select("term", zipped).select("id", "term", "tf")

    def words(self, query: str) -> list[tuple[str, int]]:
        """The words of one query and their buckets."""
        word = self.spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(query)))).alias("term"))
        return [(r.term, r.bucket) for r in word.select("term", term_bucket(F.col("term"), self.buckets).alias("bucket")).collect()]

    def ids_with_terms(self, side: Side, query: str) -> DataFrame:
        """id of the rows in which every word of the query occurs; no words, no rows."""
        words = self.words(query)
        if not words:
            return self.lists(side).limit(0).select(F.explode("ids").alias("id"))
        terms, buckets = zip(*words, strict=True)
        named = self.lists(side).where(F.col("bucket").isin(*set(buckets)) & F.col("term").isin(*terms))
        met = named.groupBy("batch_id", "slice").agg(
            F.sort_array(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("l")
        ).where(F.size("l") == len(terms))
        both = F.aggregate(F.slice("l", 2, len(terms)), F.col("l")[0]["ids"], lambda have, x: F.array_intersect(have, x["ids"]))
        return met.select(F.explode(both).alias("id"))

    def keys(self, side: Side, found: Column | None = None) -> DataFrame:
        """id, document_id, time and place of the rows, of those only for which ``found`` holds."""
        rows = self.rows(side)
        place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
        return (rows if found is None else rows.where(found)).select("id", "document_id", side.at, *place)

    def keys_with_terms(self, side: Side, query: str) -> DataFrame:
        return self.keys(side).join(self.ids_with_terms(side, query), "id", "left_semi")

    def keys_containing(self, side: Side, query: str) -> DataFrame:
        """Rows whose text contains the query, ignoring case: the only scan of all texts."""
        return self.keys(side, F.contains(F.lower(side.text), F.lower(F.trim(F.lit(query)))))

    def newest(self, side: Side, keys: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
        """The newest ``limit`` keys whose document is registered, with its title, url and source."""
        docs = documents.select("document_id", F.col("title").alias("doc_title"), F.col("url").alias("doc_url"), "source_id")
        return keys.join(docs, "document_id").orderBy(F.desc(side.at), "id").limit(limit)

    def fetched(self, side: Side, shown: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """``shown`` (keys with their places) joined with the rows' other columns, read where the rows lie.

        The keys of the rows shown come to the driver; their number is the limit of the search.
        """
        keys = shown.collect()
        rows = self.rows(side)
        other = [c for c in (columns or rows.columns) if c not in shown.columns and c != "batch_id"]
        small = self.spark.createDataFrame(keys, shown.schema)
        if not keys:
            return small.join(rows.limit(0).select("id", *other), "id")
        files = sorted({k["_file"] for k in keys})
        at = reduce(
            lambda a, b: a | b,
            ((F.col("_file") == f) & F.col("_row").isin(*[k["_row"] for k in keys if k["_file"] == f]) for f in files),
        )
        # The ids let Parquet skip row groups and pages; the place tells the row.
        part = self.spark.read.schema(rows.schema).option("basePath", f"{self.root}/{side.name}").parquet(*files)
        part = part.where(F.col("id").isin(*[k["id"] for k in keys])).select(
            F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), *other
        )
        return small.join(part.where(at), PLACE)

    def search(
        self, side: Side, keys: DataFrame, documents: DataFrame, sources: DataFrame, limit: int = DEFAULT_LIMIT,
        columns: list[str] | None = None,
    ) -> DataFrame:
        """Newest found rows with their documents, sources and the asked columns (all if not told)."""
        src = sources.select(
            F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("state").alias("source_state")
        )
        shown = self.newest(side, keys, documents, limit).join(src, "source_id", "left")
        return self.fetched(side, shown, columns).drop(*PLACE)

    def containing(
        self, side: Side, query: str, documents: DataFrame, sources: DataFrame, limit: int = DEFAULT_LIMIT, columns: list[str] | None = None
    ) -> DataFrame:
        return self.search(side, self.keys_containing(side, query), documents, sources, limit, columns)

    def with_terms(
        self, side: Side, query: str, documents: DataFrame, sources: DataFrame, limit: int = DEFAULT_LIMIT, columns: list[str] | None = None
    ) -> DataFrame:
        return self.search(side, self.keys_with_terms(side, query), documents, sources, limit, columns)

    def totals(self, query: str, documents: DataFrame, limit: int = DEFAULT_LIMIT, by_terms: bool = False) -> DataFrame:
        """One row: snapshots and diffs shown for a query, counted on keys alone."""
        find = self.keys_with_terms if by_terms else self.keys_containing
        s, d = (
            self.newest(side, find(side, query), documents, limit).agg(F.count("*").alias(f"total_{side.name}"))
            for side in (SNAPSHOTS, DIFFS)
        )
        return s.select("total_snapshots", d.scalar().alias("total_diffs"))
