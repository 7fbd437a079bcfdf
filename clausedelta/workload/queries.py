"""The registered queries: every operator over views of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausedelta.functions import text as tx
from clausedelta.functions import urls as ur
from clausedelta.functions.html import with_html_text
from clausedelta.functions.stages import with_computed
from clausedelta.operators import billing, changes, health, links, pages, search, versions
from clausedelta.operators import stored_search as stored
from clausedelta.plans.crawl_run import crawl_run
from clausedelta.plans.ingest import ingest_batch
from clausedelta.plans.overview import overview
from clausedelta.plans.search_request import stored_cards, stored_search_request
from clausedelta.session import work_path, written
from clausedelta.sources import catalogue, feeds, landing, listings, sinks
from clausedelta.streaming import ingest as streams
from clausedelta.workload import views

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Times as text and decimals as doubles, for comparison across engines."""
    def column(field: T.StructField):
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return F.col(field.name).cast("string").alias(field.name)
        if isinstance(field.dataType, T.DecimalType):
            return F.col(field.name).cast("double").alias(field.name)
        return F.col(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# --- sources and sinks ------------------------------------------------------


@query
def q01_source_catalogue(spark, sf):
    rows = views.sources(spark, sf)
    path = work_path(spark, "catalogue")
    rows.select(F.to_json(F.array(F.struct(
        "id", "name", "state", "base_url", "adapter_type", "is_active", "health_status",
        F.struct("document_title").alias("selectors_config"),
    )))).write.text(path)
    return catalogue.load_catalogue(spark, path, multi_line=False).select(
        "id", "name", "state", "base_url", "adapter_type", "is_active", "health_status",
        F.col("selectors_config.document_title").alias("document_title"),
    )


@query
def q02_link_list_to_sources(spark, sf):
    p = views.table(spark, sf, "pages")
    line = F.when(F.col("page_id") % 7 == 6, F.concat(F.lit("# "), F.col("url"))).otherwise(
        F.concat((F.col("page_id") + 1).cast("string"), F.lit(". "), F.col("url"), F.lit("/  listed"))
    )
    found = catalogue.sources_from_links(p.select(F.col("page_id").alias("line_no"), line.alias("line")))
    return found.select("id", "name", "base_url", "adapter_type")


@query
def q03_catalogue_new_sources(spark, sf):
    s = views.sources(spark, sf)
    return catalogue.new_sources(s, s.where("is_active")).select("id", "base_url")


@query
def q03_new_source_counts(spark, sf):
    s = views.sources(spark, sf)
    return catalogue.new_source_counts(s, s.where("is_active"))


@query
def q04_json_listing_ingest(spark, sf):
    return listings.listing_documents(views.listing_payloads(spark, sf)).withColumn("snippet", F.md5("snippet"))


@query
def q04_json_listing_templates(spark, sf):
    payloads = views.listing_payloads(spark, sf)
    template = F.when(F.col("url_template").isNotNull(), "https://register.example.gov/{rid:07d}-{rid:x}/{made!s:.4}/{label:_>30.6}")
    return listings.listing_documents(payloads.withColumn("url_template", template)).select("source_id", "pos", "url")


@query
def q04_json_listing_results(spark, sf):
    return listings.listing_results(views.listing_payloads(spark, sf))


@query
def q05_feed_ingest(spark, sf):
    return feeds.feed_documents(views.feed_payloads(spark, sf))


@query
def q05_feed_results(spark, sf):
    return feeds.feed_results(views.feed_payloads(spark, sf)).select("source_id", "success", "items_found")


@query
def q06_direct_document_register(spark, sf):
    log = views.probes(spark, sf).select(
        "source_id", (F.col("http_status") == 200).alias("success"),
        F.lit("application/xml; charset=utf-8").alias("content_type"),
        F.coalesce("error_text", F.concat(F.lit("HTTP "), F.col("http_status").cast("string"))).alias("error"),
    )
    return catalogue.direct_documents(views.sources(spark, sf), log)


@query
def q07_page_landing_scan(spark, sf):
    landed = landing.landed_pages(spark, f"{sf}/pages.parquet")
    return landing.accepted(landed, "html").select("page_id", "url", F.length("html").alias("body_chars"))


@query
def q08_page_text_scan(spark, sf):
    return views.page_texts(spark, sf).select(
        "document_id", "page_no", "image_count", F.length("page_text").alias("text_chars")
    )


@query
def q09_snapshot_append(spark, sf):
    path = work_path(spark, "snapshots")
    sinks.append_snapshots(views.snapshots(spark, sf), path)
    back = spark.read.parquet(path)
    return back.select("document_id", "version", F.sha2("cleaned_text", 256).alias("text_hash"), "crawl_date")


@query
def q10_diff_append(spark, sf):
    path = work_path(spark, "diffs")
    sinks.append_diffs(changes.diff_payload(changes.snapshot_diffs(views.snapshots(spark, sf))), path)
    back = spark.read.parquet(path)
    return back.select(
        "document_id", "previous_snapshot_id", "current_snapshot_id", "added_clauses_count", "removed_clauses_count",
        F.col("diff_payload.total_modified").alias("modified_in_payload"), F.col("diff_payload.summary").alias("summary"),
    )


def _audited(spark, sf):
    return health.audit(views.probes(spark, sf), views.probe_links(spark, sf))


@query
def q11_report_export(spark, sf):
    path = work_path(spark, "audit")
    health.export_audit(_audited(spark, sf), path)
    schema = "source_id string, name string, http_status int, recommendation string, docs_found bigint, category string"
    return spark.read.schema(schema).json(path)


# --- link discovery ---------------------------------------------------------


@query
def q12_extract_links(spark, sf):
    found = links.extract_links(views.link_pages(spark, sf))
    return found.select("page_id", "pos", "href", "text", "link_title", "link_id", "link_class")


@query
def q13_selector_filter(spark, sf):
    test = links.selector_test("a[href*='.pdf'], a[href*='notice'], a[href*='ordinance']")
    return views.raw_links(spark, sf).where(test).select("page_id", "pos", "href")


@query
def q13_scoped_selector(spark, sf):
    selector = "nav a[href*='th'], footer a[href^='/']"
    found = links.extract_links(views.link_pages(spark, sf), scopes=links.scopes_of(selector))
    return found.where(links.selector_test(selector)).select("page_id", "pos", "href")


@query
def q14_meeting_table_links(spark, sf):
    return links.meeting_table_links(views.meeting_pages(spark, sf)).select(
        "source_id", "url", "title", "document_type", "published_date"
    )


@query
def q15_drop_nonnavigable(spark, sf):
    return views.raw_links(spark, sf).where(links.navigable(F.col("href"))).select("page_id", "pos", "href")


@query
def q16_statutory_heuristic(spark, sf):
    kept = ur.is_statutory(F.col("href"), F.col("text"))
    return views.raw_links(spark, sf).where(kept).select("page_id", "pos", "href", "text")


def _urls(spark, sf):
    return ur.with_resolved_url(views.raw_links(spark, sf), F.col("base_url"), F.col("href"), "url")


@query
def q17_normalize_url(spark, sf):
    return _urls(spark, sf).select("page_id", "pos", "url")


@query
def q18_is_pdf(spark, sf):
    kind = F.when(F.col("pos") % 3 == 0, "Application/PDF; q=1").otherwise("text/html")
    return _urls(spark, sf).select(
        "page_id", "pos", ur.is_pdf(F.col("url")).alias("by_url"), ur.is_pdf(F.col("url"), kind).alias("by_type_or_url")
    )


@query
def q19_ingest_route(spark, sf):
    return _urls(spark, sf).select("page_id", "pos", ur.ingest_route(F.col("url")).alias("route"))


@query
def q20_exclude_domains(spark, sf):
    return _urls(spark, sf).where(ur.is_allowed_host(F.col("url"))).select("page_id", "pos", "url")


@query
def q21_classify_document(spark, sf):
    kind = ur.classify_document(F.col("text"), F.col("url")).alias("document_type")
    return _urls(spark, sf).select("page_id", "pos", kind)


@query
def q22_classify_basic(spark, sf):
    df = ur.with_resolved_url(views.raw_links(spark, sf), F.col("base_url"), F.col("href"), "full_url", normalize=False)
    kind = ur.classify_basic(F.col("text"), F.col("full_url")).alias("document_type")
    return df.select("page_id", "pos", "full_url", kind)


@query
def q23_link_title(spark, sf):
    text = F.when(F.col("pos") % 3 != 1, F.col("text")).otherwise("")
    title = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("Title "), F.col("pos").cast("string"))).otherwise("")
    adapter = F.element_at(F.array(*[F.lit(a) for a in links.DEFAULT_TITLES]), F.col("pos") % 5 + 1)
    return views.raw_links(spark, sf).select("page_id", "pos", links.link_title(text, title, adapter).alias("title"))


@query
def q24_dedupe_links(spark, sf):
    df = _urls(spark, sf).withColumn("pos", F.col("page_id") * 1000 + F.col("pos"))
    return links.dedupe_links(df.select("source_id", "url", "pos", "text"))


@query
def q24_discover_documents(spark, sf):
    df = views.link_pages(spark, sf).withColumn("source_id", F.col("page_id").cast("string"))
    moved = F.replace("html", F.lit('<a href="/'), F.lit('<a href="/notices/'))
    return links.discover(df.withColumn("html", moved))


@query
def q25_adapter_route(spark, sf):
    return views.sources(spark, sf).select("id", catalogue.adapter_for(F.col("adapter_type")).alias("adapter"))


@query
def q26_infer_adapter(spark, sf):
    p = views.table(spark, sf, "pages")
    host = F.element_at(F.array(*[F.lit(v) for v in ("/municode", "/legistar", "/granicus", "/civicplus", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.concat(F.col("url"), host)
    return p.select("page_id", ur.infer_adapter(url).alias("adapter"), ur.site_label(url).alias("label"))


@query
def q27_static_else_rendered(spark, sf):
    df = _urls(spark, sf)
    # Pages served without encryption stand for the static crawl.
    static = df.where(F.startswith("base_url", F.lit("http:"))).select("source_id", "url", F.lit("static").alias("origin"))
    rendered = df.where(F.startswith("base_url", F.lit("https:"))).select("source_id", "url", F.lit("rendered").alias("origin"))
    return links.static_else_rendered(static, rendered)


@query
def q28_link_metadata(spark, sf):
    entry = links.link_metadata(
        platform=F.when(F.col("pos") % 2 == 0, "custom_heuristic"),
        source_format=F.when(F.col("pos") % 2 == 1, "xml_feed"),
        date=F.when(F.col("pos") % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("pos") % 28 + 1).cast("string"), 2, "0"))),
    )
    return views.raw_links(spark, sf).select("page_id", "pos", F.to_json(entry).alias("metadata"))


@query
def q29_unsafe_url_flag(spark, sf):
    url = F.element_at(F.array(
        F.col("url"), F.concat(F.lit("http://127.0.0.1/"), F.col("text")), F.lit("ftp://files.example.gov/a"),
        F.lit("http://192.168.4.5:8080/x"), F.lit("https://10.0.0.8/"), F.lit("http://localhost:8000/s"),
        F.lit("http://169.254.169.254/latest"), F.lit("https://user@example.gov/"),
    ), F.col("pos") % 8 + 1)
    return _urls(spark, sf).select("page_id", "pos", ur.is_unsafe(url).alias("unsafe"))


# --- extraction and cleaning ------------------------------------------------


@query
def q30_html_to_lines(spark, sf):
    text = with_html_text(views.table(spark, sf, "pages"), "html", "t")
    return text.select("page_id", F.md5("t").alias("text_md5"), F.size(F.split("t", "\n", -1)).alias("lines"))


def _cleaned(spark, sf, column):
    """A text function on documents decorated with what it should change."""
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    decorated = F.concat(
        F.lit("Page 1 of 9\n\n\nThe “ordi-\nnance” of "), k, F.lit(" — it’s §\u00a04\n  - 3 -\n"), F.col("text"),
        F.lit("\n \t\n\n\nDRAFT – subject to change today\nCrown Copyright 2024 x\n7 / 12\nALL RIGHTS RESERVED. Clerk\nend  "),
    )
    out = with_computed(d.select("doc_id", decorated.alias("d")), t=column(F.col("d")))
    return out.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("chars"))


@query
def q31_normalize_unicode(spark, sf):
    return _cleaned(spark, sf, tx.normalize_unicode)


@query
def q32_dehyphenate(spark, sf):
    return _cleaned(spark, sf, tx.dehyphenate)


@query
def q33_strip_boilerplate(spark, sf):
    return _cleaned(spark, sf, tx.strip_boilerplate)


@query
def q34_strip_source_disclaimers(spark, sf):
    phrases = F.array(F.lit("the "), F.lit("la."), F.lit("de (x)"), F.concat(F.lit("of "), F.col("doc_id").cast("string")))
    return _cleaned(spark, sf, lambda t: tx.strip_phrases(t, phrases))


@query
def q35_collapse_blank_lines(spark, sf):
    return _cleaned(spark, sf, tx.collapse_blank_lines)


@query
def q36_clean_text(spark, sf):
    return _cleaned(spark, sf, tx.clean_text)


@query
def q37_repeated_lines(spark, sf):
    return pages.repeated_lines(views.page_texts(spark, sf))


@query
def q38_clean_multipage(spark, sf):
    df = pages.clean_multipage(views.page_texts(spark, sf))
    return df.select("document_id", F.md5("cleaned_text").alias("text_md5"), F.length("cleaned_text").alias("chars"))


@query
def q39_raw_text_join(spark, sf):
    df = pages.raw_text(views.page_texts(spark, sf))
    return df.select("document_id", "page_count", F.md5("raw_text").alias("text_md5"))


@query
def q40_low_density_pages(spark, sf):
    return pages.low_density(views.page_texts(spark, sf))


@query
def q40_ocr_documents(spark, sf):
    return pages.ocr_documents(views.page_texts(spark, sf))


@query
def q41_extraction_metrics(spark, sf):
    d = views.page_texts(spark, sf)
    raw, clean = F.length("page_text"), F.length("c")
    return d.withColumn("c", tx.clean_text(F.col("page_text"))).select(
        "document_id", "page_no", raw.alias("raw_chars"), clean.alias("clean_chars"), tx.reduction_pct(raw, clean).alias("reduction_pct")
    )


# --- clauses and changes ----------------------------------------------------


@query
def q42_split_sections(spark, sf):
    df = changes.split_sections(views.snapshots(spark, sf))
    return df.withColumn("text", F.md5("text"))


@query
def q43_split_paragraphs(spark, sf):
    df = changes.split_paragraphs(views.snapshots(spark, sf)).drop("line_start", "line_end")
    return df.withColumn("text", F.md5("text"))


@query
def q44_split_clauses(spark, sf):
    df = changes.split_clauses(views.snapshots(spark, sf))
    return df.select("document_id", "version", "strategy", "pos", "identifier", "section_number", "title")


def _changes(spark, sf):
    return changes.clause_changes(changes.snapshot_diffs(views.snapshots(spark, sf)))


@query
def q47_clause_key(spark, sf):
    df = changes.keyed(changes.split_clauses(views.snapshots(spark, sf)))
    return df.select("document_id", "version", "pos", "clause_key")


@query
def q48_clause_last_wins(spark, sf):
    # Two versions in one text, so that every header occurs twice.
    d = views.document_versions(views.table(spark, sf, "documents"))
    twice = d.select(
        F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("version"),
        F.concat("v1", F.lit("\n"), "v2").alias("cleaned_text"),
    )
    return changes.unique_clauses(twice).select("document_id", "key", "ord", F.md5("text").alias("text_md5"))


@query
def q49_clause_changes(spark, sf):
    return _changes(spark, sf).select(
        "document_id", "version", "ord", "change_type", "clause_key", "identifier", "section_number",
        F.md5("old_text").alias("old_md5"), F.md5("new_text").alias("new_md5"),
    )


@query
def q50_diff_payload(spark, sf):
    df = changes.diff_payload(changes.snapshot_diffs(views.snapshots(spark, sf)))
    return df.select("document_id", "version", "total_added", "total_removed", "total_modified", "summary")


@query
def q51_diff_strategy(spark, sf):
    return changes.snapshot_diffs(views.snapshots(spark, sf)).select("document_id", "version", "strategy_used")


# --- versions ---------------------------------------------------------------


def _hashes(spark, sf):
    """Written once: what follows reads hashes, never bodies, however often."""
    return written(versions.hashed(views.fetches(spark, sf)), "hashes")


@query
def q52_content_hash(spark, sf):
    return versions.hashed(views.fetches(spark, sf))


@query
def q53_latest_snapshot(spark, sf):
    df = views.snapshots(spark, sf).withColumn("text_hash", F.sha2("cleaned_text", 256)).drop("cleaned_text")
    return versions.latest_snapshots(df)


@query
def q54_detect_changes(spark, sf):
    return versions.detect_changes(_hashes(spark, sf)).select("document_id", "fetch_id", "content_hash", "previous_hash")


def _versions(spark, sf):
    return versions.assign_versions(versions.detect_changes(_hashes(spark, sf)))


@query
def q55_assign_versions(spark, sf):
    return _versions(spark, sf).select("document_id", "fetch_id", "version")


@query
def q56_snapshot_pairs(spark, sf):
    pairs = changes.snapshot_pairs(_versions(spark, sf), ["fetch_id", "content_hash"])
    return pairs.select(
        "document_id", "version", F.col("old.fetch_id").alias("previous_fetch"), F.col("new.fetch_id").alias("current_fetch"),
        F.col("old.content_hash").alias("previous_hash"), F.col("new.content_hash").alias("current_hash"),
    )


@query
def q57_register_documents(spark, sf):
    seen = _urls(spark, sf).select(
        "source_id", "url", F.col("text").alias("title"), ur.classify_document(F.col("text"), F.col("url")).alias("document_type"),
        (F.col("page_id") * 1000 + F.col("pos")).alias("seen_at"),
    )
    stored = seen.where("document_type = 'meeting_minutes'").select("source_id", "url").distinct()
    return versions.register_documents(seen, stored)


@query
def q58_upsert_sources(spark, sf):
    s = views.sources(spark, sf).withColumn("link_selector", F.lit(None).cast("string")).withColumn(
        "status_detail", F.lit(None).cast("string")
    )
    stored = s.where("health_status <> 'operational'").drop("s_suppkey", "document_title")
    incoming = s.where("is_active").withColumns({
        "name": F.concat("name", F.lit(" v2")), "link_selector": F.lit("a[href*='.pdf']"),
        "id": F.concat(F.lit("new-"), "id"), "state": F.lit("changed"),
    }).drop("s_suppkey", "document_title")
    return catalogue.upsert_sources(stored, incoming)


@query
def q59_document_status(spark, sf):
    return versions.document_status(_hashes(spark, sf), _versions(spark, sf))


def _landed(fetches: DataFrame) -> DataFrame:
    """Fetched text as an HTML page around it."""
    safe = F.replace(F.replace(F.replace("body", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return fetches.withColumn("body", F.concat(F.lit("<html><body><nav>Menu</nav><article>"), safe, F.lit("</article></body></html>")))


@query
def q60_ingest_batch(spark, sf):
    store = work_path(spark, "store")
    fetches = _landed(views.fetches(spark, sf))
    # Two batches: the first fetch of every document, then the later ones.
    ingest_batch(spark, fetches.where("round = 0"), store, 0)
    ingest_batch(spark, fetches.where("round > 0"), store, 1)
    return spark.read.parquet(f"{store}/diffs").select(
        "document_id", "version", "strategy_used", "total_added", "total_removed", "total_modified", "summary"
    )


@query
def q60_crawl_run(spark, sf):
    """Two whole runs: the first fetch of every document, then the later ones; some sources fail in between."""
    store = work_path(spark, "store")
    fetches = _landed(views.fetches(spark, sf)).withColumn("run", F.least("round", F.lit(1)))
    sites = views.sources(spark, sf).withColumn("link_selector", F.lit(None).cast("string")).drop("s_suppkey", "document_title")
    title = F.concat(F.lit("Document "), F.col("document_id"))
    links = fetches.select(
        "run", "source_id", "url", title.alias("title"), ur.classify_document(title, F.col("url")).alias("document_type"),
        F.col("fetched_at").alias("seen_at"),
    )
    failed = F.col("fetch_id") % 97 == 5
    log = fetches.select(
        F.col("run").cast("string").alias("run_id"), "source_id", F.col("source_id").alias("source_name"), (~failed).alias("success"),
        F.when(failed, F.lit("no answer")).alias("error"), F.lit(1).cast("bigint").alias("documents"),
        F.col("fetched_at").alias("started_at"), F.col("fetched_at").alias("ended_at"),
    )
    rows = []
    for run in (0, 1):
        rows.append(crawl_run(
            spark, store, run, sites, links.where(F.col("run") == run).drop("run"), fetches.where(F.col("run") == run).drop("run"),
            log.where(F.col("run_id") == str(run)),
        ))
    return rows[0].unionByName(rows[1])


# --- search -----------------------------------------------------------------


def _diffs(spark, sf):
    d = changes.snapshot_diffs(views.snapshots(spark, sf))
    minutes = F.col("document_id").cast("bigint")
    return d.select(
        F.concat(F.lit("d"), "document_id").alias("id"), "*", views.after(minutes, days=2).alias("generated_at")
    )


def _store(spark, sf, snapshots=True, diffs=True, index=False):
    """The snapshots and diffs stored as the ingest leaves them: each computed once, whatever a search reads of it."""
    store = stored.SearchStore(spark, work_path(spark, "search"), buckets=16)
    store.add(0, views.snapshots(spark, sf) if snapshots else None, _diffs(spark, sf) if diffs else None, index)
    return store


@query
def q61_search_snapshots_substring(spark, sf):
    found = _store(spark, sf, diffs=False).containing(
        stored.SNAPSHOTS, " AMENDED ", views.registry(spark, sf), views.sources(spark, sf), columns=["version"]
    )
    return found.select("id", "document_id", "version", "doc_title", "doc_url", "source_name", "source_state", "crawled_at")


@query
def q62_search_diffs_substring(spark, sf):
    found = _store(spark, sf, snapshots=False).containing(
        stored.DIFFS, "added CLAUSE", views.registry(spark, sf), views.sources(spark, sf), columns=["version"]
    )
    return found.select("id", "document_id", "doc_title", "source_name", "generated_at")


@query
def q63_term_index(spark, sf):
    return _store(spark, sf, diffs=False, index=True).postings(stored.SNAPSHOTS)


@query
def q65_diff_term_index(spark, sf):
    return _store(spark, sf, snapshots=False, index=True).postings(stored.DIFFS)


@query
def q66_search_all_terms(spark, sf):
    found = _store(spark, sf, diffs=False, index=True).with_terms(
        stored.SNAPSHOTS, "The amended Clause 5", views.registry(spark, sf), views.sources(spark, sf), columns=["version"]
    )
    return found.select("id", "document_id", "version", "doc_title", "source_name", "crawled_at")


@query
def q66_search_diff_terms(spark, sf):
    found = _store(spark, sf, snapshots=False, index=True).with_terms(
        stored.DIFFS, "new Clause, modified", views.registry(spark, sf), views.sources(spark, sf), columns=["version"]
    )
    return found.select("id", "document_id", "version", "doc_title", "source_name", "generated_at")


def _cards(spark, sf, kind="all"):
    return stored_cards(_store(spark, sf), views.registry(spark, sf), views.sources(spark, sf), "amended", kind)


@query
def q67_result_cards(spark, sf):
    return _cards(spark, sf).select("card_id", "type", "entity", "doc", "section", F.md5("full").alias("full_md5"), "url", "ts")


@query
def q68_snapshot_preview(spark, sf):
    return views.snapshots(spark, sf).select(
        "id", search.preview(F.col("cleaned_text")).alias("card_preview"), search.preview(F.col("cleaned_text"), 300).alias("page_preview")
    )


@query
def q69_filter_by_type(spark, sf):
    return _cards(spark, sf, "diffs").select("card_id", "type", "section")


@query
def q70_search_totals(spark, sf):
    return _store(spark, sf).totals("amended", views.registry(spark, sf))


def _access(spark, sf):
    people = views.users(spark, sf)
    k = F.col("id").cast("int")
    asked = people.select(
        F.when(k % 50 == 49, F.lit(None)).when(k % 50 == 48, F.concat(F.lit("ghost-"), "id"))
        .when(k % 3 == 0, F.col("id")).when(k % 3 == 1, F.upper("email")).otherwise(F.col("email")).alias("user_ref")
    )
    return billing.access_status(asked, people, views.subscriptions(spark, sf), views.ACCESS_AT)


@query
def q71_gate_results(spark, sf):
    # Whether the viewer has access is decided from the users table.
    allowed = _access(spark, sf).where("user_id = '17'").agg(F.coalesce(F.bool_or("has_access"), F.lit(False)).alias("ok"))
    shown = stored_search_request(_store(spark, sf), views.registry(spark, sf), views.sources(spark, sf), "amended", allowed.scalar())
    return shown.select("card_id", "type", "section", "full", "is_locked")


@query
def q71_open_results(spark, sf):
    shown = stored_search_request(
        _store(spark, sf), views.registry(spark, sf), views.sources(spark, sf), "amended", True, "snapshots"
    )
    return shown.select("card_id", F.md5("full").alias("full_md5"), "is_locked")


@query
def q72_diff_display(spark, sf):
    shown = search.diff_display(_changes(spark, sf))
    return shown.select("document_id", "version", "ord", "badge", "identifier", F.md5("shown_text").alias("shown_md5"))


# --- billing ----------------------------------------------------------------


def _events(spark, sf):
    return billing.normalize_events(views.deliveries(spark, sf))


@query
def q73_normalize_events(spark, sf):
    return _events(spark, sf).select(
        "delivery_id", "event_id", "event_type", "status", "subscription_id", "email", "subscriber_name", "next_billing_at", "plan_id"
    )


@query
def q74_payment_amounts(spark, sf):
    return _events(spark, sf).select("delivery_id", "amount", "currency")


@query
def q75_dedupe_events(spark, sf):
    df = billing.dedupe_events(_events(spark, sf))
    return df.select("delivery_id", "event_id", "event_type", "subscription_id", "result", "error_detail", "deliveries")


@query
def q76_truncate_payload(spark, sf):
    # The payload of one event next to a long document, cut where it is too long.
    d = views.table(spark, sf, "documents")
    payload = F.to_json(F.struct("doc_id", "text"))
    return d.select("doc_id", F.md5(billing.stored_payload(payload, 20_000)).alias("payload_md5"))


@query
def q77_default_next_billing(spark, sf):
    return billing.default_next_billing(_events(spark, sf)).select("delivery_id", "status", "plan_id", "next_billing_at")


@query
def q78_fold_subscriptions(spark, sf):
    return views.subscriptions(spark, sf)


@query
def q79_subscriber_list(spark, sf):
    return billing.subscriber_list(views.subscriptions(spark, sf), views.plans(spark))


@query
def q80_plan_counts(spark, sf):
    return billing.plan_counts(views.subscriptions(spark, sf), views.plans(spark))


@query
def q81_public_plans(spark, sf):
    # Only plans that occur in the events are offered here.
    used = _events(spark, sf).select(F.col("plan_id").alias("provider_plan_id")).distinct()
    return billing.public_plans(views.plans(spark).join(used, "provider_plan_id", "left_semi"))


@query
def q82_revenue(spark, sf):
    return billing.revenue(views.subscriptions(spark, sf), views.plans(spark))


@query
def q83_subscriber_buckets(spark, sf):
    return billing.subscriber_buckets(views.subscriptions(spark, sf))


@query
def q84_access_status(spark, sf):
    return _access(spark, sf)


@query
def q85_trial_activation(spark, sf):
    issues, attempts, people = views.codes(spark, sf)
    return billing.trial_activation(attempts, issues, people)


@query
def q86_event_log(spark, sf):
    return billing.event_log(billing.dedupe_events(_events(spark, sf)).drop("payload"))


@query
def q86_event_log_totals(spark, sf):
    return billing.event_log_totals(billing.event_log(billing.dedupe_events(_events(spark, sf)), 200))


# --- health and runs --------------------------------------------------------


@query
def q87_active_sources(spark, sf):
    return catalogue.active_sources(views.sources(spark, sf)).select("id", "name", "is_active")


@query
def q88_all_sources(spark, sf):
    return catalogue.all_sources(views.sources(spark, sf)).select("id", "name", "is_active", "health_status")


@query
def q89_health_counts(spark, sf):
    return health.health_counts(views.sources(spark, sf))


def _results(spark, sf):
    return health.source_results(views.crawl_log(spark, sf))


@query
def q90_source_results(spark, sf):
    return _results(spark, sf)


@query
def q91_run_summary(spark, sf):
    # The diffs of a day's run are those generated on it.
    created = _diffs(spark, sf).select(F.to_date("generated_at").cast("string").alias("run_id"))
    return health.run_summary(_results(spark, sf), views.runs(spark, sf), created)


@query
def q92_run_failures(spark, sf):
    return health.run_failures(_results(spark, sf))


@query
def q93_run_report(spark, sf):
    results = _results(spark, sf)
    report = health.run_report(results, health.run_summary(results))
    return report.withColumn("failures", F.md5(F.array_join(F.transform("failures", lambda f: F.concat_ws("|", f["source_name"], f["error"])), "\n")))


@query
def q94_audit_category(spark, sf):
    return _audited(spark, sf).select("source_id", "name", "http_status", "category", "error_detail", "recommendation", "docs_found")


@query
def q95_audit_sample(spark, sf):
    return health.audit_samples(_audited(spark, sf))


@query
def q96_audit_summary(spark, sf):
    return health.audit_summary(_audited(spark, sf))


@query
def q97_probe_verdict(spark, sf):
    return health.probe_verdicts(views.probes(spark, sf))


@query
def q97_probe_totals(spark, sf):
    return health.probe_totals(health.probe_verdicts(views.probes(spark, sf)))


@query
def q98_two_probe_verdict(spark, sf):
    p = views.probes(spark, sf)
    http = p.select("source_id", "url", "http_status", "error_text", "body")
    browser = p.select("source_id", "url", "browser_status", "browser_error", "is_404", "is_challenge")
    return health.two_probe_verdicts(http, browser).drop("source_id")


@query
def q99_catalogue_checks(spark, sf):
    s = views.sources(spark, sf).withColumn("health_status", F.when(F.col("s_suppkey") % 10 != 0, F.col("health_status")))
    s = s.withColumn("base_url", F.when(F.col("s_suppkey") % 8 == 3, "https://shared.example.gov").otherwise(F.col("base_url")))
    s = s.withColumn("name", F.when(F.col("s_suppkey") % 9 == 2, F.lit(None)).otherwise(F.col("name")))
    return health.catalogue_checks(s)


@query
def q100_overview(spark, sf):
    return overview(views.sources(spark, sf), views.subscriptions(spark, sf), views.plans(spark))


# --- streams ----------------------------------------------------------------


def _stream(spark, sf, name):
    return streams.table_stream(spark, f"{sf}/{name}.parquet", views.table(spark, sf, name).schema)


@query
def q101_page_stream_ingest(spark, sf):
    store, check = work_path(spark, "store"), work_path(spark, "check")
    streamed = views.fetch_rows(_stream(spark, sf, "documents"))
    streams.stream_ingest(_landed(streamed), store, check).awaitTermination()
    return spark.read.parquet(f"{store}/diffs").select(
        "document_id", "version", "strategy_used", "total_added", "total_removed", "total_modified", "summary"
    )


@query
def q102_event_stream_dedupe(spark, sf):
    path, check = work_path(spark, "events"), work_path(spark, "check")
    raw = views.payment_deliveries(_stream(spark, sf, "events"))
    streams.stream_deduped_events(raw, path, check, "40 days").awaitTermination()
    kept = spark.read.parquet(path)
    # Which delivery of an id comes first in one micro-batch is not fixed.
    key = F.coalesce("event_id", F.col("delivery_id").cast("string"))
    return kept.groupBy(key.alias("event_key")).agg(F.count("*").alias("kept"))


@query
def q102_event_stream_outcomes(spark, sf):
    path, check = work_path(spark, "outcomes"), work_path(spark, "check")
    raw = views.payment_deliveries(_stream(spark, sf, "events"))
    streams.stream_event_outcomes(raw, path, check, "40 days").awaitTermination()
    return streams.current_outcomes(spark, path).select(
        "delivery_id", "event_id", "event_type", "subscription_id", "result", "error_detail", "deliveries"
    )


@query
def q103_subscription_state_stream(spark, sf):
    path, check = work_path(spark, "state"), work_path(spark, "check")
    streams.stream_subscriptions(views.payment_deliveries(_stream(spark, sf, "events")), path, check).awaitTermination()
    return streams.current_subscriptions(spark, path)
