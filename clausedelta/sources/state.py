"""Newest row per key of a growing store, so that a batch costs what it touches and not the history.

Rows lie in generations, one per batch, split into parts by a hash of the key. A manifest per batch
names the generations that hold a part's rows; a batch reads the manifest before it, opens the named
folders of the parts it touches, and adds one generation with its own rows. A part with MOST_GENERATIONS
of them is folded into the new one. Nothing that a manifest names is ever written again, and the
manifest comes last, so a batch that is run again starts from the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta.session import drop_path
from clausedelta.sources.sinks import append_batch, batch_ids, read_batch

PARTS = 64
MOST_GENERATIONS = 8
MANIFEST = "part int, generation bigint"

Places = set[tuple[int, int]]  # (part, generation)


class KeyedState:
    """schema holds key and order; a later row of a key has a larger order.

    ``parts`` belongs to a store and never changes; it bounds the manifest to parts x MOST_GENERATIONS rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str, parts: int = PARTS) -> None:
        self.spark, self.path, self.schema, self.key, self.order, self.parts = spark, path, schema, key, order, parts

    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def places(self, batch_id: int | None) -> Places:
        """What the manifest of a batch names."""
        rows = read_batch(self.spark, f"{self.path}/manifest", MANIFEST, batch_id)
        return {(r.part, r.generation) for r in rows.collect()} if batch_id is not None else set()

    def manifests(self, before: int) -> list[int]:
        return [b for b in batch_ids(self.spark, f"{self.path}/manifest") if b < before]

    def touched(self, rows: DataFrame) -> set[int]:
        """At most ``parts`` numbers come to the driver."""
        return {r[0] for r in rows.select(self.part()).distinct().collect()}

    def folders(self, places: Places) -> list[str]:
        return [f"{self.path}/rows/generation={g}/part={p}" for p, g in sorted(places)]

    def newest(self, places: Places, more: DataFrame | None = None) -> DataFrame:
        rows = self.spark.createDataFrame([], self.schema)
        if places:
            rows = self.spark.read.schema(self.schema).parquet(*self.folders(places))
        if more is not None:
            rows = rows.unionByName(more.select(*rows.columns))
        rest = [c for c in rows.columns if c != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), self.order).alias("_s"))
        return best.select(self.key, "_s.*")

    def read(self, batch_id: int, keys: DataFrame) -> DataFrame:
        """Rows of the given keys as they were before the batch."""
        old = self.manifests(batch_id)
        parts = self.touched(keys) if old else set()
        found = self.newest({x for x in self.places(old[-1]) if x[0] in parts} if old else set())
        return found.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def write(self, batch_id: int, new: DataFrame) -> None:
        """Add the batch's rows, at most one per key, and name them."""
        old = self.manifests(batch_id)
        before = self.places(old[-1]) if old else set()
        parts = self.touched(new)
        full = {p for p in parts if sum(q == p for q, _ in before) >= MOST_GENERATIONS}
        rows = new.withColumn("part", self.part())
        if full:
            names = [x.split()[0] for x in self.schema.split(", ")]
            folded = self.newest({x for x in before if x[0] in full}, rows.where(F.col("part").isin(*full)).select(*names))
            rows = rows.where(~F.col("part").isin(*full)).select(*names, "part").unionByName(
                folded.select(*names, self.part().alias("part"))
            )
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/generation={batch_id}")
        now = {x for x in before if x[0] not in full} | {(p, batch_id) for p in parts}
        append_batch(self.spark.createDataFrame(sorted(now), MANIFEST).coalesce(1), f"{self.path}/manifest", batch_id)
        if len(old) > 1:  # neither this batch nor a second run of it needs them
            for folder in self.folders(self.places(old[-2]) - before):
                drop_path(self.spark, folder)
