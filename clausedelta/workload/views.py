"""Input views over the given tables, in the shapes the operators expect.

Every view is row-wise over a whole table, so the work of a query grows with
the tables. The same views in SQL are in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION_WORDS = ("§", "Section", "Article", "Chapter", "Division", "Part")
ADAPTER_CYCLE = (
    "municode", "granicus", "civicplus", "custom", "rest_api", "api", "json", "xml", "atom", "feed",
    "direct_document", "Unlisted",
)
HEALTH_CYCLE = ("operational", "dead_link", "cloudflare_blocked", "unreachable", "blocked_403", "auth_required")
ACCESS_AT = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def after(minutes: Column, days: int = 0) -> Column:
    """2024-01-01 plus minutes and days, without a time zone."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(days), F.lit(0), minutes.cast("int"), F.lit(0)
    )


def document_versions(documents: DataFrame, mixed: bool = True) -> DataFrame:
    """doc_id, v1, v2: a text with section headers, and its amended form."""
    d = F.col("doc_id")
    word = _pick(SECTION_WORDS, F.pmod(d, F.lit(6))) if mixed else F.lit("§")
    df = documents.select("doc_id", "source", F.split("text", "\n", -1).alias("_l"), word.alias("_w"))

    def opened(n: Column) -> Column:
        k = (F.floor(n / 3) + 1).cast("string")
        header = F.concat(F.col("_w"), F.lit(" "), d.cast("string"), F.lit("-"), k, F.lit(". Clause "), k)
        return (
            F.when((n % 3 == 0) & (F.pmod(d, F.lit(4)) != 3), F.array(header))
            .when((n % 3 == 0) & (n > 0), F.array(F.lit("")))
            .otherwise(F.array().cast("array<string>"))
        )

    def amended(line: Column, n: Column) -> Column:
        # A dropped line takes its header with it.
        changed = F.when(n % 5 == 2, F.concat(line, F.lit(" amended"))).otherwise(line)
        return F.when(n % 7 == 5, F.array().cast("array<string>")).otherwise(F.concat(opened(n), F.array(changed)))

    v1 = F.flatten(F.transform("_l", lambda line, n: F.concat(opened(n), F.array(line))))
    v2 = F.flatten(F.transform("_l", lambda line, n: amended(line, n)))
    extra = F.array(
        F.concat(F.col("_w"), F.lit(" "), d.cast("string"), F.lit("-999. Added clause")), F.lit("New text")
    )
    v2 = F.when(F.pmod(d, F.lit(2)) == 0, F.concat(v2, extra)).otherwise(v2)
    v2 = F.when(F.pmod(d, F.lit(10)) == 0, v1).otherwise(v2)
    return df.select("doc_id", "source", F.array_join(v1, "\n").alias("v1"), F.array_join(v2, "\n").alias("v2"))


def snapshots(spark: SparkSession, sf_dir: str, mixed: bool = True) -> DataFrame:
    """id, document_id, version, cleaned_text, crawled_at: two versions each."""
    both = document_versions(table(spark, sf_dir, "documents"), mixed)
    rows = both.select("doc_id", F.posexplode(F.array("v1", "v2")).alias("_i", "cleaned_text"))
    version = (F.col("_i") + 1).cast("int")
    return rows.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("-"), version.cast("string")).alias("id"),
        F.col("doc_id").cast("string").alias("document_id"),
        version.alias("version"),
        "cleaned_text",
        (after(F.col("doc_id")) + F.make_dt_interval(F.col("_i"), F.lit(0), F.lit(0), F.lit(0))).alias("crawled_at"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, source_id, title, url of the tracked documents."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(
        key.alias("document_id"),
        F.concat(F.lit("site-"), F.substring("source", 4, 10)).alias("source_id"),
        F.concat(F.lit("Document "), key).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.gov/doc/"), key, F.lit(".pdf")).alias("url"),
    )


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_rows(table(spark, sf_dir, "documents"))


def fetch_rows(documents: DataFrame) -> DataFrame:
    """Two fetches per document; a third that returns to the first content
    where doc_id % 20 = 5."""
    both = document_versions(documents)
    d = F.col("doc_id")
    bodies = F.when(F.pmod(d, F.lit(20)) == 5, F.array("v1", "v2", "v1")).otherwise(F.array("v1", "v2"))
    rows = both.select("doc_id", "source", F.posexplode(bodies).alias("_i", "body"))
    return rows.select(
        d.cast("string").alias("document_id"),
        F.concat(F.lit("site-"), F.substring("source", 4, 10)).alias("source_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.gov/doc/"), d.cast("string")).alias("url"),
        (d * 10 + F.col("_i")).alias("fetch_id"),
        F.col("_i").alias("round"),
        (after(d) + F.make_dt_interval(F.col("_i"), F.lit(0), F.lit(0), F.lit(0))).alias("fetched_at"),
        "body",
    )


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, source_id, base_url, html; the page's host is its source."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.select("page_id", host.alias("source_id"), F.col("url").alias("base_url"), "html")


def raw_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages with hrefs rewritten by position, to hit every case."""
    from clausedelta.operators.links import extract_links

    links = extract_links(link_pages(spark, sf_dir)).drop("html")
    href, k = F.col("href"), F.col("pos") % 8
    shaped = (
        F.when(k == 1, F.concat(href, F.lit(".pdf")))
        .when(k == 2, F.concat(F.lit("/ordinance"), href))
        .when(k == 3, F.concat(F.lit("//CDN.example.gov"), href, F.lit("?utm_source=x&id=1&q=a%20b*~#top")))
        .when(k == 4, F.concat(F.lit("https://facebook.com"), href))
        .when(k == 5, F.concat(F.lit("/agenda/../minutes"), href))
        .when(k == 6, F.lit("javascript:void(0)"))
        .when(k == 7, F.concat(F.lit("/View.ashx?ID="), F.col("page_id").cast("string")))
        .otherwise(href)
    )
    from clausedelta.functions.stages import with_computed

    return with_computed(links, href=shaped)


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged documents of five pages. Longer pages carry a running header and a
    boilerplate footer; very short ones are left bare."""
    d = table(spark, sf_dir, "documents")
    group = F.floor(F.col("doc_id") / 5).cast("bigint")
    no = (F.pmod("doc_id", F.lit(5)) + 1).cast("int")
    banner = F.concat(F.lit("Board of Group "), group.cast("string"), F.lit(" - Page "), no.cast("string"))
    text = F.when(F.length("text") < 40, F.col("text")).otherwise(
        F.concat(banner, F.lit("\n"), F.col("text"), F.lit("\nAll rights reserved. Clerk"))
    )
    return d.select(
        group.cast("string").alias("document_id"), no.alias("page_no"), text.alias("page_text"),
        F.pmod("doc_id", F.lit(2)).cast("int").alias("image_count"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: one source per supplier."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k = F.col("s_suppkey")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select(
        F.concat(F.lit("site-"), k.cast("string")).alias("id"),
        F.col("s_name").alias("name"),
        F.col("n_name").alias("state"),
        F.concat(F.lit("https://"), k.cast("string"), F.lit(".example.gov")).alias("base_url"),
        _pick(ADAPTER_CYCLE, F.pmod(k, F.lit(12))).alias("adapter_type"),
        F.when(k % 4 == 1, F.concat(F.lit("Register "), k.cast("string"))).alias("document_title"),
        (k % 3 != 0).alias("is_active"),
        F.when(k % 30 != 0, _pick(HEALTH_CYCLE, F.pmod(k, F.lit(6)))).alias("health_status"),
        k.alias("s_suppkey"),
    )


def payment_deliveries(events: DataFrame) -> DataFrame:
    """Raw payment events: delivery_id, received_at, payload, result, error_detail.

    Ids ending in 9 repeat the id before them, every 500th has none.
    """
    e, u = F.col("event_id"), F.col("user_id")
    kind = (
        F.when(F.col("event_type") == "signup", "BILLING.SUBSCRIPTION.ACTIVATED")
        .when(F.col("event_type") == "purchase", "PAYMENT.SALE.COMPLETED")
        .when(F.col("event_type") == "click", "BILLING.SUBSCRIPTION.CANCELLED")
        .when(F.col("event_type") == "error", "BILLING.SUBSCRIPTION.SUSPENDED")
        .otherwise("CUSTOMER.NOTE.CREATED")
    )
    sale, active = F.col("event_type") == "purchase", F.col("event_type") == "signup"
    number = F.when(e % 10 == 9, e - 1).otherwise(e)
    sub = F.concat(F.lit("I-"), u.cast("string"))
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    plan = F.when(k % 3 == 0, "P-MONTH").when(k % 3 == 1, "P-ANNUAL").otherwise("P-RETIRED")
    text = lambda c: c.cast("string")
    resource = F.struct(
        F.when(sale, F.concat(F.lit("SALE-"), text(e))).otherwise(sub).alias("id"),
        F.when(sale, sub).alias("billing_agreement_id"),
        F.when(~sale, plan).alias("plan_id"),
        F.struct(
            F.when(active, F.concat(F.lit("c"), text(u), F.lit("@example.com"))).alias("email_address"),
            F.struct(
                F.when(active & (u % 3 == 0), F.concat(F.lit("Given"), text(u))).alias("given_name"),
                F.when(active & (u % 3 != 2), F.lit("Family")).alias("surname"),
            ).alias("name"),
            F.when(active & (u % 3 == 2), F.concat(F.lit("Firm "), text(u))).alias("business_name"),
        ).alias("subscriber"),
        F.struct(F.when(active & (e % 2 == 0), F.lit("2024-02-01T00:00:00")).alias("next_billing_time")).alias("billing_info"),
        F.struct(
            F.when(sale & (e % 4 != 3), text(F.col("value").cast("decimal(12,2)"))).when(sale, F.lit("n/a")).alias("total"),
            F.when(sale, F.lit("USD")).alias("currency"),
        ).alias("amount"),
    )
    payload = F.to_json(F.struct(
        F.when(number % 500 != 0, F.concat(F.lit("WH-"), text(number))).alias("id"), kind.alias("event_type"), resource.alias("resource")
    ))
    rejected = e % 7 == 3
    return events.select(
        e.alias("delivery_id"), F.col("ts").cast("timestamp_ntz").alias("received_at"), payload.alias("payload"),
        F.when(rejected, "rejected").otherwise("processed").alias("result"),
        F.when(rejected, "Signature verification failed").alias("error_detail"),
    )


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payment_deliveries(table(spark, sf_dir, "events"))


def plans(spark: SparkSession) -> DataFrame:
    """The price list, a two-row configuration."""
    return spark.createDataFrame(
        [("monthly", "Standard", "P-MONTH", "49.00", "month", True), ("annual", "Standard (Annual)", "P-ANNUAL", "468.00", "year", True)],
        "id string, name string, provider_plan_id string, price string, interval string, is_active boolean",
    ).withColumn("price", F.col("price").cast("decimal(12,2)"))


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausedelta.operators.billing import default_next_billing, fold_subscriptions, normalize_events

    return fold_subscriptions(default_next_billing(normalize_events(deliveries(spark, sf_dir))))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ends = after(F.lit(0)) + F.make_dt_interval((k % 40).cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return c.select(
        k.cast("string").alias("id"),
        F.concat(F.lit("c"), k.cast("string"), F.lit("@example.com")).alias("email"),
        (k % 17 != 0).alias("is_active"), (k % 5 != 0).alias("is_verified"),
        F.when(k % 23 == 1, "not a date").when(k % 23 != 2, ends.cast("string")).alias("trial_ends_at"),
    )


def codes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, attempts, users): signups issue codes, clicks try them.

    A click types the code of its user's preceding issue when event_id % 4 > 0.
    """
    from clausedelta.functions.segments import segmented_last

    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    code = F.when(F.col("event_type") == "signup", (F.col("event_id") % 1000).cast("string"))
    marked = e.where(F.col("event_type").isin("signup", "click")).withColumn("_code", code)
    known = segmented_last(marked, ["user_id"], ["at", "event_id"], F.to_date("at"), F.col("_code"), "_known")
    issues = e.where("event_type = 'signup'").select("user_id", "at", "event_id", (F.col("event_id") % 1000).cast("string").alias("code"))
    attempts = known.where("event_type = 'click'").select(
        "user_id", "at", "event_id",
        F.when(F.col("event_id") % 4 == 0, "wrong").otherwise(F.coalesce("_known", F.lit("none"))).alias("code"),
    )
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 11 == 0).alias("is_verified")
    )
    return issues, attempts, people


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log row per event: its day is the run, its user the source."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp_ntz")
    return e.select(
        F.to_date(at).cast("string").alias("run_id"), F.col("user_id").alias("source_id"),
        F.concat(F.lit("Source "), F.col("user_id").cast("string")).alias("source_name"),
        (F.col("event_type") != "error").alias("success"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 != 0), F.concat(F.lit("HTTP error at event "), F.col("event_id").cast("string"))).alias("error"),
        F.floor("value").cast("bigint").alias("documents"),
        at.alias("started_at"),
        (at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 60).cast("decimal(18,6)"))).alias("ended_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All run days and one more that is still open."""
    e = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp_ntz")
    days = e.groupBy(F.to_date(at).alias("day")).agg(F.max(at).alias("finished_at"))
    # The last day has no end row yet.
    newest = e.agg(F.max(F.to_date(at)).alias("last_day"))
    joined = days.join(newest, days["day"] == newest["last_day"], "left")
    return joined.select(
        F.col("day").cast("string").alias("run_id"), F.when(F.col("last_day").isNull(), F.col("finished_at")).alias("finished_at")
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain and a browser probe per source."""
    k = F.col("s_suppkey")
    status = _pick((200, 404, 403, 401, 500, 202, 503, None), k % 8).cast("int")
    err = F.when(status.isNull(), _pick(("SSLError", "ConnectionError", "Timeout", "ValueError"), F.floor(k / 8) % 4))
    body = F.when(k % 16 == 6, "Just a moment...").when(k % 16 == 0, "Page Not Found").otherwise("Welcome")
    browser = _pick((200, None, 404, 403, 200), k % 5).cast("int")
    return sources(spark, sf_dir).select(
        F.col("id").alias("source_id"), "name", F.col("base_url").alias("url"), status.alias("http_status"),
        err.alias("error_class"), F.when(err.isNotNull(), F.concat(err, F.lit(": failed for "), "base_url")).alias("error_text"),
        body.alias("body"), browser.alias("browser_status"),
        F.when(browser.isNull(), _pick(("net::ERR_NAME_NOT_RESOLVED", "Timeout 30000ms", "net::ERR_CONNECTION_RESET", "net::ERR_ABORTED"), F.floor(k / 5) % 4)).alias("browser_error"),
        (k % 9 == 4).alias("is_404"), (k % 10 == 7).alias("is_challenge"),
    )


def probe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered documents of the probed sources; some sources have none."""
    return registry(spark, sf_dir).select(
        "source_id", F.col("document_id").cast("bigint").alias("pos"), "title", "url", F.lit("notice").alias("document_type")
    )


def listing_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON listing per document: keyed, plain array, single object, broken or
    empty, by doc_id."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    key = i.cast("string")
    record = F.to_json(F.struct(i.alias("rid"), F.concat(F.lit("Zoning record "), key).alias("label"), F.col("text").alias("summary"), F.lit("2024-05-01").alias("made")))
    plain = F.to_json(F.struct(F.concat(F.lit("Minutes "), key).alias("title"), F.concat(F.lit("/file/"), key, F.lit("?utm_source=a&p=1#x")).alias("url"), F.col("text").alias("body")))
    unclosed = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("body"))), r"^\{|\}$", "")
    body = (
        F.when(i % 6 == 0, F.concat(F.lit('{"value":['), record, F.lit(","), record, F.lit(",7]}")))
        .when(i % 6 == 1, F.concat(F.lit("["), plain, F.lit(',"text"]')))
        .when(i % 6 == 2, plain)
        .when(i % 6 == 3, F.concat(F.lit('[{"title":"broken",'), unclosed))
        .when(i % 6 == 4, F.to_json(F.array("text")))
        .otherwise(F.to_json(F.struct(F.array("text").alias("other"))))
    )
    keyed = i % 6 == 0
    return d.select(
        key.alias("source_id"), F.concat(F.lit("https://api.example.gov/v1/"), key).alias("endpoint_url"), body.alias("body"),
        F.when(keyed | (i % 6 == 5), "value").alias("items_key"),
        F.when(keyed, "label").alias("title_field"), F.lit(None).cast("string").alias("url_field"),
        F.when(keyed, "https://register.example.gov/{rid}/{made}").alias("url_template"),
        F.lit(None).cast("string").alias("content_field"), F.when(keyed, "made").alias("date_field"),
    )


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed per document: Atom, RSS, index by attribute, HTML page or broken."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    key = i.cast("string")
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = lambda n: F.concat(F.lit(f'<entry><title>Rule {n} of '), key, F.lit(f'</title><updated>2024-03-0{n}</updated><link href="/uksi/'), key, F.lit(f'/{n}#frag"/><summary>'), esc, F.lit("</summary></entry>"))
    atom = F.concat(F.lit('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">'), entry(1), entry(2), entry(1), F.lit("<entry><title>No link</title></entry></feed>"))
    rss = F.concat(F.lit("<rss><channel><item><title>Agenda &amp; notes "), key, F.lit("</title><link>https://Feeds.example.gov/i/"), key, F.lit("</link><description><![CDATA["), F.col("text"), F.lit("]]></description></item><item><title>x</title><link>https://facebook.com/x</link></item></channel></rss>"))
    index = F.concat(F.lit('<index><Act href="/act/'), key, F.lit('"><title>Act '), key, F.lit("</title><note>"), esc, F.lit('</note></Act><Act url="act2.xml"/></index>'))
    body = (
        F.when(i % 5 == 0, atom).when(i % 5 == 1, rss).when(i % 5 == 2, index)
        .when(i % 5 == 3, F.concat(F.lit("<html><body>"), esc, F.lit("</body></html>")))
        .otherwise(F.concat(F.lit("<feed><entry>"), esc))
    )
    none = F.lit(None).cast("string")
    return d.select(
        key.alias("source_id"), F.concat(F.lit("https://feeds.example.gov/a/"), key).alias("endpoint_url"), body.alias("body"),
        none.alias("item_tag"), none.alias("title_tag"), none.alias("link_tag"), F.when(i % 5 == 0, "updated").alias("date_tag"),
    )


def meeting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A meeting calendar per page, with one table row per link of the page."""
    p = link_pages(spark, sf_dir)
    key = F.col("page_id").cast("string")
    words = F.regexp_extract_all("html", F.lit(r'<a href="/([^"]*)">'), F.lit(1))

    def row(word: Column, i: Column) -> Column:
        n = i.cast("string")
        link = (
            F.when(i % 4 == 0, F.concat(F.lit('<a href="View.ashx?M=A&amp;ID='), n, F.lit('">Agenda</a>')))
            .when(i % 4 == 1, F.concat(F.lit('<a href="/docs/'), n, F.lit('.pdf" title="Packet"></a>')))
            .when(i % 4 == 2, F.concat(F.lit('<a id="x_hlMinutes" href="m/'), n, F.lit('">Minutes</a>')))
            .otherwise(F.concat(F.lit('<a href="/other/'), n, F.lit('">Other</a>')))
        )
        return F.concat(F.lit("<tr><td>Council "), word, F.lit("</td><td>2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"), F.lit("</td><td>"), link, F.lit("</td></tr>"))

    rows = F.array_join(F.transform(words, row), "")
    opening = F.when(F.col("page_id") % 3 == 0, '<table class="x rgMasterTable">').when(F.col("page_id") % 3 == 1, '<table id="main_grid">').otherwise("<table>")
    html = F.concat(F.lit('<html><body><a href="/top.pdf">Top</a>'), opening, rows, F.lit("</table></body></html>"))
    return p.select(key.alias("source_id"), F.concat(F.lit("https://meet.example.gov/c/"), key, F.lit("/Calendar.aspx")).alias("base_url"), html.alias("html"))
