"""The catalogue of monitored sources."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausedelta import schemas
from clausedelta.functions.segments import segmented_row_number
from clausedelta.functions.urls import infer_adapter, site_label

# Adapter names a source may use, and the adapter each one means.
ADAPTERS = {
    "municode": "municode",
    "granicus": "granicus",
    "civicplus": "civicplus",
    "custom": "custom",
    "rest_api": "rest_api",
    "api": "rest_api",
    "json": "rest_api",
    "xml": "xml_feed",
    "atom": "xml_feed",
    "feed": "xml_feed",
    "direct_document": "direct_document",
    "document": "direct_document",
}

# Fixed value: link selector given to sources made from a plain list of links.
LISTED_SELECTOR = (
    "a[href*='.pdf'], a[href*='notice'], a[href*='bylaw'], a[href*='ordinance'], a[href*='planning']"
)


def load_catalogue(spark: SparkSession, path: str, yaml_path: str | None = None, multi_line: bool = True) -> DataFrame:
    """Catalogue rows from JSON; from YAML only when the JSON file is absent.

    A field of another type is null in its row; text that gives neither id nor
    base_url gives no row. Both are in ``catalogue_rejects``. ``multi_line=False`` reads one object or array per
    line, which lets Spark split large files.
    """
    try:
        rows = _catalogue_rows(spark, path, multi_line)
        return rows.where("id is not null or base_url is not null").drop("_corrupt")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    if yaml_path is not None:
        try:
            import json

            import yaml

            # A hand-written configuration file, parsed on the driver.
            text = spark.read.text(yaml_path, wholetext=True).first()[0]
            listed = (yaml.safe_load(text) or {}).get("sources", [])
            lines = spark.createDataFrame([(json.dumps(s),) for s in listed], "value string")
            return lines.select(F.from_json("value", schemas.SOURCES).alias("s")).select("s.*")
        except Exception:  # noqa: BLE001 - any unreadable file is an empty catalogue
            pass
    return spark.createDataFrame([], schemas.SOURCES)


def _catalogue_rows(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    reader = spark.read.schema(f"{schemas.SOURCES}, _corrupt string").option("multiLine", multi_line)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def catalogue_rejects(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Catalogue rows that do not parse or have a field of another type, as text in ``record``."""
    rows = _catalogue_rows(spark, path, multi_line).where("_corrupt is not null")
    return rows.select("id", F.col("_corrupt").alias("record"))


def sources_from_links(lines: DataFrame, rows_per_segment: int = 100_000) -> DataFrame:
    """Sources from numbered link lines: columns ``line_no``, ``line``."""
    found = lines.select(
        "line_no",
        F.regexp_replace(F.regexp_extract(F.trim("line"), r"^\d+\.\s*(https?://\S+)", 1), r"/+$", "").alias("base_url"),
    ).where("base_url <> ''")
    numbered = segmented_row_number(
        found, [], ["line_no"], F.floor(F.col("line_no") / rows_per_segment), "ordinal"
    )
    label = site_label(F.col("base_url"))
    digits = F.col("ordinal").cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0"))
    return numbered.select(
        F.concat(F.lit("site-"), padded, F.lit("-"), label).alias("id"),
        F.concat(F.upper(F.substring(label, 1, 1)),
                 F.lower(F.substr(label, F.lit(2))), F.lit(" Statutory Monitor")).alias("name"),
        "base_url",
        infer_adapter(F.col("base_url")).alias("adapter_type"),
        F.lit(LISTED_SELECTOR).alias("link_selector"),
        F.lit(True).alias("is_active"),
    )


def new_sources(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalogue rows whose base_url is not stored yet."""
    return catalogue.join(stored.select("base_url").distinct(), "base_url", "left_anti")


def new_source_counts(catalogue: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: configured, stored and new sources."""
    tagged = (
        catalogue.select(F.lit(1).alias("configured"), F.lit(0).alias("stored"), F.lit(0).alias("new"))
        .unionAll(stored.select("base_url").distinct().select(F.lit(0), F.lit(1), F.lit(0)))
        .unionAll(new_sources(catalogue, stored).select(F.lit(0), F.lit(0), F.lit(1)))
    )
    return tagged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("configured", "stored", "new")])


def adapter_for(adapter_type: Column) -> Column:
    """Adapter of a source; unknown or missing names fall back to custom."""
    table = F.create_map(*[F.lit(x) for pair in ADAPTERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(adapter_type)), F.lit("custom"))


def active_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.coalesce("is_active", F.lit(True))).orderBy("name", "id")


def all_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy(F.desc("is_active"), F.asc("name"), F.asc("id"))


def upsert_sources(stored: DataFrame, incoming: DataFrame, all_columns: bool = False) -> DataFrame:
    """Merge incoming sources on base_url; the stored id always stays.

    A known base_url takes name, adapter_type and link_selector from the incoming
    row, with ``all_columns`` every provided column.
    """
    updated = ["name", "adapter_type", "link_selector"]
    kept = [
        c for c in ("state", "county", "is_active", "health_status", "status_detail")
        if c in stored.columns and c in incoming.columns
    ]
    if all_columns:
        updated, kept = updated + kept, []
    # The last incoming row of a base_url wins.
    latest = incoming.groupBy("base_url").agg(
        F.max_by(F.struct("id", *updated, *kept), "id").alias("new")
    )
    both = stored.select("base_url", F.struct("id", *updated, *kept).alias("old")).join(latest, "base_url", "full")
    known = F.col("old").isNotNull()
    return both.select(
        F.coalesce("old.id", "new.id").alias("id"),
        "base_url",
        *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in updated],
        *[F.when(known, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in kept],
        F.when(~known, "inserted").when(F.col("new").isNotNull(), "updated").otherwise("unchanged").alias("action"),
    )


def direct_documents(sources: DataFrame, fetch_log: DataFrame) -> DataFrame:
    """Sources that are themselves one document, with the outcome of their fetch.

    ``fetch_log``: source_id, success, content_type, error.
    """
    from clausedelta.functions.text import non_blank, strip
    from clausedelta.functions.urls import classify_document

    direct = sources.where((adapter_for(F.col("adapter_type")) == "direct_document") & (F.coalesce("base_url", F.lit("")) != ""))
    title = F.coalesce(non_blank(F.col("document_title")), non_blank(F.col("name")), F.lit("Statutory Document"))
    joined = direct.join(fetch_log, direct["id"] == fetch_log["source_id"], "left").withColumn("_title", title)
    ok = F.coalesce("success", F.lit(False))
    return joined.select(
        F.col("id").alias("source_id"),
        ok.alias("success"),
        F.when(ok, strip(F.col("_title"))).alias("title"),
        F.when(ok, F.col("base_url")).alias("url"),
        F.when(ok, classify_document(F.col("_title"), F.col("base_url"))).alias("document_type"),
        F.when(ok, strip(F.split_part(F.coalesce("content_type", F.lit("")), F.lit(";"), F.lit(1)))).alias("content_type"),
        F.when(~ok, F.coalesce("error", F.lit("not fetched"))).alias("error"),
    )
