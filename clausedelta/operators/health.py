"""Source health, probe verdicts and crawl-run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausedelta.functions.text import non_blank
from clausedelta.sources.catalogue import ADAPTERS

# Audit categories in report order.
AUDIT_CATEGORIES = (
    "healthy_success", "dead_links_client", "access_restricted_waf", "selector_tuning_needed",
)
REPORT_FAILURES = 25
ERROR_CHARS = 160


def health_counts(sources: DataFrame) -> DataFrame:
    status = F.col("health_status")
    return sources.agg(
        F.count("*").alias("total"),
        F.count_if(status == "operational").alias("operational"),
        F.count_if(status == "cloudflare_blocked").alias("cloudflare_blocked"),
        F.count_if(status == "dead_link").alias("dead_link"),
    )


def source_results(crawl_log: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Outcome per run and source; a failed source never affects the others.

    ``crawl_log``: run_id, source_id, source_name, success, error, documents,
    started_at, ended_at. With ``links`` (run_id, source_id) the documents are
    counted from them. Several log rows of one source add up; any failure wins.
    """
    log = crawl_log
    if links is not None:
        counts = links.groupBy("run_id", "source_id").agg(F.count("*").alias("_n"))
        log = log.drop("documents").join(counts, ["run_id", "source_id"], "left").withColumn(
            "documents", F.coalesce("_n", F.lit(0))
        ).drop("_n")
    seconds = (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")))
    return log.groupBy("run_id", "source_id").agg(
        F.min("source_name").alias("source_name"),
        F.bool_and("success").alias("success"),
        F.sum(F.when(F.col("success"), F.col("documents")).otherwise(0)).alias("documents"),
        F.expr("min_by(coalesce(error, 'Unknown failure'), started_at) FILTER (WHERE NOT success)").alias("error"),
        F.round((F.sum(seconds).cast("decimal(20,0)") / 1_000_000), 2).cast("double").alias("duration_seconds"),
    )


def run_status(succeeded: Column, failed: Column) -> Column:
    return F.when(failed == 0, "completed").when(succeeded == 0, "failed").otherwise("partial_failure")


def run_summary(results: DataFrame, runs: DataFrame | None = None, diffs: DataFrame | None = None) -> DataFrame:
    """Totals and status per run.

    ``runs`` (run_id, started_at, finished_at) brings in runs without results;
    a run without an end stays 'running'. ``diffs``: run_id per diff created.
    """
    totals = results.groupBy("run_id").agg(
        F.count("*").alias("total_sources"),
        F.count_if("success").alias("sources_succeeded"),
        F.count_if(~F.col("success")).alias("sources_failed"),
        F.sum("documents").alias("documents_found"),
    )
    if diffs is not None:
        totals = totals.join(diffs.groupBy("run_id").agg(F.count("*").alias("diffs_created")), "run_id", "left")
    else:
        totals = totals.withColumn("diffs_created", F.lit(0))
    if runs is not None:
        totals = runs.join(totals, "run_id", "left")
        ended = F.col("finished_at").isNotNull()
    else:
        ended = F.lit(True)
    numbers = ["total_sources", "sources_succeeded", "sources_failed", "documents_found", "diffs_created"]
    filled = totals.select(
        *[c for c in totals.columns if c not in numbers],
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in numbers],
    )
    return filled.withColumn(
        "status", F.when(ended, run_status(F.col("sources_succeeded"), F.col("sources_failed"))).otherwise("running")
    )


def run_failures(results: DataFrame) -> DataFrame:
    """One row per failed source of a run: its error log, kept as rows."""
    return results.where("NOT success").select("run_id", "source_id", "source_name", "error")


def run_report(results: DataFrame, summary: DataFrame, forced: bool = False) -> DataFrame:
    """Subject, figures, the first 25 failures and the send flag per run.

    The 25 are taken with a row number filter, which Spark applies inside the
    map tasks already, so a run with very many failures stays small.
    """
    rank = Window.partitionBy("run_id").orderBy("source_name", "source_id")
    shown = (
        run_failures(results)
        .withColumn("_rank", F.row_number().over(rank))
        .where(F.col("_rank") <= REPORT_FAILURES)
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("_rank").alias("rank"), "source_name", F.left("error", F.lit(ERROR_CHARS)).alias("error")
        ))).alias("failures"))
    )
    failed, ok = F.col("sources_failed"), F.col("sources_succeeded")
    subject = F.when(
        failed > 0, F.concat(failed.cast("string"), F.lit(" of "), (ok + failed).cast("string"), F.lit(" sources failed"))
    ).otherwise(F.concat(F.lit("daily crawl clean ("), ok.cast("string"), F.lit(" sources)")))
    return summary.join(shown, "run_id", "left").select(
        "run_id", subject.alias("subject"), "sources_succeeded", "sources_failed", "documents_found", "diffs_created",
        F.coalesce("failures", F.array().cast("array<struct<rank:int,source_name:string,error:string>>")).alias("failures"),
        F.greatest(failed - REPORT_FAILURES, F.lit(0)).alias("more"),
        ((failed > 0) | F.lit(forced)).alias("send"),
    )


def audit(probes: DataFrame, links: DataFrame) -> DataFrame:
    """Category, detail and recommendation per probed source, with a sample.

    ``probes``: source_id, name, url, http_status, error_class, error_text.
    ``links``: source_id, pos, title, url, document_type of discovered documents.
    """
    counts = links.groupBy("source_id").agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("title", "url", "document_type"), F.struct("pos", "url")).alias("first"),
    )
    df = probes.join(counts, "source_id", "left")
    http, err, n = F.col("http_status"), F.col("error_class"), F.coalesce("n", F.lit(0))
    # Category, detail and recommendation per test, in the order of
    # the tests; the first test that holds decides.
    rules = [
        (err == "SSLError", "dead_links_client",
         F.concat(F.lit("SSL Certificate Failure: "), F.left(F.coalesce("error_text", F.lit("")), F.lit(80))),
         "Municipal server SSL certificate is expired or invalid"),
        (err.isin("ConnectionError", "ConnectTimeout"), "dead_links_client",
         F.lit("Connection Failed / DNS Resolution Error (Dead Domain)"), "Client to replace dead URL"),
        (err.isin("Timeout", "ReadTimeout"), "dead_links_client",
         F.lit("Server Connection Timed Out (>18s)"), "Server is unresponsive or blocking international requests"),
        (err.isNotNull(), "selector_tuning_needed",
         F.concat(F.lit("Crawl Error: "), F.coalesce("error_text", F.lit(""))), "Inspect portal layout"),
        (http == 404, "dead_links_client",
         F.lit("404 Not Found - URL path no longer exists on municipality server"), "Client to provide updated URL"),
        (http.isin(401, 403), "access_restricted_waf",
         F.concat(F.lit("HTTP "), http.cast("string"), F.lit(" - Cloudflare/WAF Bot Challenge")),
         "Run with Playwright Headless Browser Adapter"),
        ((http == 200) & (n > 0), "healthy_success", F.lit(None).cast("string"), "Ready for daily automated ingestion"),
        (http == 200, "selector_tuning_needed",
         F.lit("Page 200 OK, but 0 statutory documents matched generic selector"),
         "Tune specific portal landing sub-path in sites.json"),
        (F.lit(True), "dead_links_client",
         F.concat(F.lit("HTTP "), F.coalesce(http.cast("string"), F.lit("None")), F.lit(" Error")),
         "Client to verify link availability"),
    ]
    category = detail = advice = None
    for test, cat, det, rec in rules:
        category = F.when(test, cat) if category is None else category.when(test, cat)
        detail = F.when(test, det) if detail is None else detail.when(test, det)
        advice = F.when(test, rec) if advice is None else advice.when(test, rec)
    healthy = F.col("category") == "healthy_success"
    return df.withColumn("category", category).select(
        "source_id", "name", "url", "http_status", "category", detail.alias("error_detail"),
        advice.alias("recommendation"),
        F.when(healthy, n).otherwise(F.lit(0)).alias("docs_found"),
        F.when(healthy, F.col("first")).alias("sample_doc"),
    )


def audit_samples(audited: DataFrame) -> DataFrame:
    """First discovered document of every healthy source, title cut to 45."""
    return audited.where("category = 'healthy_success'").select(
        "source_id", "name", "docs_found", F.left("sample_doc.title", F.lit(45)).alias("sample_title"),
        F.col("sample_doc.url").alias("sample_url"), F.col("sample_doc.document_type").alias("sample_type"),
    )


def audit_summary(audited: DataFrame) -> DataFrame:
    """Count and percentage per category, zeros included, from one aggregate row."""
    counts = audited.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("category") == c).alias(c) for c in AUDIT_CATEGORIES]
    )
    rows = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("category"), F.col(c).alias("sources"))
                     for i, c in enumerate(AUDIT_CATEGORIES)])
    share = F.round(F.col("sources").cast("decimal(18,0)") * 100 / F.nullif(F.col("total"), F.lit(0)).cast("decimal(18,0)"), 1)
    return counts.select("total", F.inline(rows)).select(
        "ord", "category", "sources", F.coalesce(share.cast("double"), F.lit(0.0)).alias("percentage")
    )


def export_audit(audited: DataFrame, path: str) -> None:
    """Audit results as JSON, one folder per category."""
    audited.write.partitionBy("category").json(path)


def _challenge(body: Column, status: Column) -> Column:
    page = F.contains(body, F.lit("Just a moment")) | F.contains(body, F.lit("Cloudflare"))
    return F.coalesce(page & status.isin(403, 503), F.lit(False))


def probe_verdicts(probes: DataFrame) -> DataFrame:
    """PASS, FAIL, CLOUDFLARE_CAPTCHA or ERROR per probed url."""
    status = F.col("http_status")
    verdict = (
        F.when(status.isNull(), F.concat(F.lit("ERROR ("), F.coalesce("error_class", F.lit("Unknown")), F.lit(")")))
        .when(_challenge(F.col("body"), status), "CLOUDFLARE_CAPTCHA")
        .when(status >= 400, F.concat(F.lit("FAIL (HTTP "), status.cast("string"), F.lit(")")))
        .otherwise("PASS")
    )
    return probes.select("source_id", "url", "http_status", verdict.alias("verdict"))


def probe_totals(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("verdict") == "PASS").alias("passed"),
        F.count_if(F.col("verdict") != "PASS").alias("failed"),
        F.count("*").alias("total"),
    )


def two_probe_verdicts(http: DataFrame, browser: DataFrame) -> DataFrame:
    """Combine a plain and a browser probe of the same url of a source.

    ``http``: source_id, url, http_status, error_text, body; ``browser``: source_id, url,
    browser_status, browser_error, is_404, is_challenge. Sources may share a url, each has its own
    pair; a url that one probe saw several times keeps the last of them by ``probed_at``, if there is one.
    """
    key = ["source_id", "url"]

    def one_each(probes: DataFrame) -> DataFrame:
        rest = [c for c in probes.columns if c not in key]
        order = F.struct(*(["probed_at"] if "probed_at" in rest else []), *[c for c in rest if c != "probed_at"])
        best = probes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_p"))
        return best.select(*key, *[F.col(f"_p.{c}").alias(c) for c in rest if c != "probed_at"])

    df = one_each(http).join(one_each(browser), key)
    status, shown = F.col("http_status"), F.col("browser_status")
    err, browser_err = F.col("error_text"), F.col("browser_error")
    head = F.left("body", F.lit(1000))
    yes = lambda c: F.coalesce(c, F.lit(False))
    missing = yes(status == 404) | yes(F.contains(head, F.lit("404"))) | yes(F.contains(head, F.lit("Page Not Found")))
    missing = missing | yes(F.col("is_404")) | yes(shown == 404)
    unreachable = F.contains(browser_err, F.lit("net::ERR_NAME_NOT_RESOLVED")) | F.contains(browser_err, F.lit("net::ERR_CONNECTION"))
    silent = F.contains(browser_err, F.lit("Timeout")) & F.contains(err, F.lit("Timeout"))
    challenged = _challenge(F.col("body"), status) | yes(F.col("is_challenge")) | yes(status == 403) | yes(shown == 403)
    word = lambda number, text: F.coalesce(number.cast("string"), non_blank(text), F.lit("None"))
    verdict = (
        F.when(missing, "CONFIRMED_404_DEAD_LINK")
        .when(yes(unreachable), "CONFIRMED_DNS_OR_CONNECTION_DEAD")
        .when(yes(silent), "CONFIRMED_SERVER_DOWN_TIMEOUT")
        .when(challenged, "CONFIRMED_CLOUDFLARE_CAPTCHA")
        .when(yes(status == 200), "OPERATIONAL_PASS")
        .otherwise(F.concat(F.lit("FAILED (Req:"), word(status, err), F.lit(", PW:"), word(shown, browser_err), F.lit(")")))
    )
    return df.select("source_id", "url", "http_status", "browser_status", verdict.alias("verdict"))


def catalogue_checks(sources: DataFrame) -> DataFrame:
    """Violations in the catalogue: check, source_id, detail."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    required = ("id", "name", "base_url", "adapter_type", "is_active")
    adapter = F.lower("adapter_type")
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    found = F.array(
        *[F.when(blank(c), F.struct(F.lit("missing_field").alias("check"), F.lit(c).alias("detail"))) for c in required],
        F.when(~adapter.isin(*ADAPTERS), F.struct(F.lit("unknown_adapter").alias("check"), F.col("adapter_type").alias("detail"))),
        F.when(~F.coalesce("is_active", F.lit(True)) & blank("health_status"),
               F.struct(F.lit("inactive_without_reason").alias("check"), F.lit("health_status").alias("detail"))),
        F.when(F.col("id").rlike(uuid), F.struct(F.lit("uuid_id").alias("check"), F.col("id").alias("detail"))),
    )
    per_row = sources.select(F.col("id").alias("source_id"), F.explode(F.filter(found, lambda v: v.isNotNull())).alias("v")).select(
        "v.check", "source_id", "v.detail"
    )
    for column, check in (("id", "duplicate_id"), ("base_url", "duplicate_url")):
        repeated = sources.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min("id").alias("source_id")).where("n > 1")
        per_row = per_row.unionByName(repeated.select(F.lit(check).alias("check"), "source_id", F.col(column).alias("detail")))
    return per_row
