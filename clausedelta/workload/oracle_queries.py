"""SQL text per registered query; names match those in ``queries.py``."""

from __future__ import annotations

from clausedelta.workload import oracles as o

# The decorated text of the cleaning queries.
DECORATED = (
    "('Page 1 of 9' || repeat(chr(10), 3) || 'The “ordi-' || chr(10) || 'nance” of ' || doc_id || ' — it’s §' || chr(160) || '4' || chr(10) "
    "|| '  - 3 -' || chr(10) || text || chr(10) || ' ' || chr(9) || repeat(chr(10), 3) || 'DRAFT – subject to change today' "
    "|| chr(10) || 'Crown Copyright 2024 x' || chr(10) || '7 / 12' || chr(10) || 'ALL RIGHTS RESERVED. Clerk' || chr(10) || 'end  ')"
)


def _text(expression: str) -> str:
    return (
        f"SELECT doc_id, md5(t) AS text_md5, length(t) AS chars FROM "
        f"(SELECT doc_id, {expression} AS t FROM (SELECT doc_id, {DECORATED} AS d FROM documents))"
    )


def _unicode(t: str) -> str:
    return f"regexp_replace(translate({t}, chr(160) || '’‘“”', ' ''''\"\"'), '[—–]', ' - ', 'g')"


def _boilerplate(t: str) -> str:
    for p in o.BOILERPLATE:
        t = f"regexp_replace({t}, '(?im)^\\s*{p}', '', 'g')"
    return t


def _phrases(t: str) -> str:
    for p in ("'(?i)the '", "'(?i)la\\.'", "'(?i)de \\(x\\)'", "'(?i)of ' || doc_id"):
        t = f"regexp_replace({t}, {p}, '', 'g')"
    return t




def _stop_list() -> str:
    from clausedelta.operators.search import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


def _postings(source: str, text: str) -> str:
    return (
        f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{Nd}}]+')) AS term "
        f"FROM {source}) WHERE term <> '' AND term NOT IN ({_stop_list()}) GROUP BY id, term"
    )


DIFFS = o.CHANGES + """,
dtext AS (
  SELECT 'd' || p.document_id AS id, p.document_id, p.version,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(p.document_id AS BIGINT)) + to_days(2) AS generated_at,
    concat_ws(chr(10), summary, c.words) AS diff_text
  FROM payload p LEFT JOIN (
    SELECT document_id, string_agg(concat_ws(chr(10), identifier, old_text, new_text), chr(10) ORDER BY ord) AS words
    FROM changes GROUP BY 1) c USING (document_id)),
""" + o.REGISTRY + "," + o.SOURCES + """,
fdiffs AS (
  SELECT d.*, r.title AS doc_title, r.url AS doc_url, r.source_id FROM dtext d JOIN registry r USING (document_id)
  WHERE contains(lower(diff_text), 'amended') ORDER BY generated_at DESC, id LIMIT 30),
fsnaps AS (
  SELECT s.*, r.title AS doc_title, r.url AS doc_url, r.source_id FROM snapshots s JOIN registry r USING (document_id)
  WHERE contains(lower(cleaned_text), 'amended') ORDER BY crawled_at DESC, id LIMIT 30),
cards AS (
  SELECT replace(CASE change_type WHEN 'added' THEN 'add' WHEN 'removed' THEN 'del' ELSE 'diff' END || '-' || f.id || '-' || identifier, ' ', '-') AS card_id,
    'diff' AS type, coalesce(s.name, 'Municipal Regulatory Authority') AS entity, doc_title AS doc, identifier AS section,
    CASE change_type WHEN 'removed' THEN old_text ELSE new_text END AS "full", doc_url AS url, generated_at AS ts,
    0 AS part, f.id AS fid, CASE change_type WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END AS k, ord
  FROM fdiffs f JOIN changes USING (document_id) LEFT JOIN sources s ON f.source_id = s.id
  UNION ALL
  SELECT 'snap-' || f.id, 'snapshot', coalesce(s.name, 'Municipal Regulatory Authority'), doc_title, 'Snapshot v' || version,
    cleaned_text, doc_url, crawled_at, 1, f.id, 0, 0
  FROM fsnaps f LEFT JOIN sources s ON f.source_id = s.id)"""

ACCESS = o.EVENTS + "," + o.USERS + """,
asked AS (
  SELECT CASE WHEN c_custkey % 50 = 49 THEN NULL WHEN c_custkey % 50 = 48 THEN 'ghost-' || c_custkey
    WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN upper('c' || c_custkey || '@example.com')
    ELSE 'c' || c_custkey || '@example.com' END AS user_ref FROM customer),
best AS (
  SELECT lower(email) AS email, arg_max(subscription_id, updated_at) AS subscription_id, arg_max(coalesce(plan_id, ''), updated_at) AS plan_id,
    arg_max(next_billing_at, updated_at) AS next_billing_at
  FROM subs WHERE status IN ('active', 'completed') AND email IS NOT NULL GROUP BY 1),
decided AS (
  SELECT a.user_ref, u.id AS user_id, u.is_active, try_cast(u.trial_ends_at AS TIMESTAMP) AS ends, b.*,
    CASE WHEN a.user_ref IS NULL THEN 'unauthenticated' WHEN u.id IS NULL THEN 'user_not_found'
      WHEN NOT u.is_active THEN 'account_disabled' WHEN NOT u.is_verified THEN 'unverified'
      WHEN try_cast(u.trial_ends_at AS TIMESTAMP) > TIMESTAMP '2024-01-20 00:00:00' THEN 'trial'
      WHEN b.subscription_id IS NOT NULL AND NOT coalesce(epoch(TIMESTAMP '2024-01-20 00:00:00' - b.next_billing_at) > 172800, false)
        THEN 'active_subscription' ELSE 'trial_expired' END AS reason
  FROM asked a LEFT JOIN users u ON lower(a.user_ref) = u.email OR a.user_ref = u.id
  LEFT JOIN best b ON b.email = u.email),
access AS (
  SELECT user_ref, user_id, reason, reason IN ('trial', 'active_subscription') AS has_access,
    CASE WHEN reason = 'trial' THEN CAST(ceil(epoch(ends - TIMESTAMP '2024-01-20 00:00:00') / 86400) AS INT) END AS trial_days_remaining,
    CASE WHEN reason = 'active_subscription' THEN nullif(plan_id, '') END AS plan_id,
    CASE WHEN reason = 'active_subscription' THEN subscription_id END AS subscription_id
  FROM decided)"""

DEDUPED = o.EVENTS + """,
deduped AS (
  SELECT min(delivery_id) AS delivery_id, any_value(event_id) AS event_id, arg_min(event_type, received_at) AS event_type,
    arg_min(subscription_id, received_at) AS subscription_id, arg_min(coalesce(subscriber_name, ''), received_at) AS subscriber_name,
    arg_min(coalesce(amount, -1), received_at) AS amount0, arg_min(coalesce(currency, ''), received_at) AS currency0,
    arg_max(result, received_at) AS result, nullif(arg_max(coalesce(error_detail, ''), received_at), '') AS error_detail,
    min(received_at) AS received_at, count(*) AS deliveries
  FROM norm GROUP BY coalesce(event_id, 'd' || delivery_id))"""

# Ingest: two rounds of fetches; the text is what the page holds.
INGESTED = o.CLAUSES.replace(
    "snapshots AS (",
    "fetches AS (SELECT doc_id, 0 AS i, v1 AS b FROM ver UNION ALL SELECT doc_id, 1, v2 FROM ver "
    "UNION ALL SELECT doc_id, 2, v1 FROM ver WHERE doc_id % 20 = 5),\n"
    "lagged AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY i) AS pb FROM fetches),\n"
    "stored AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS version, "
    + o.clean("trim(b, ' ' || chr(10) || chr(9))") + " AS cleaned_text FROM lagged WHERE b IS DISTINCT FROM pb),\n"
    "snapshots AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, version, cleaned_text FROM stored),\nunused AS (",
) + """,
pairs AS (SELECT document_id, version FROM snapshots WHERE version > 1),
sides AS (
  SELECT p.document_id, p.version, u.key, u.text, u.strategy, u.version = p.version AS is_new
  FROM pairs p JOIN uniq u ON u.document_id = p.document_id AND u.version IN (p.version, p.version - 1)),
matched AS (
  SELECT document_id, version, key, max(text) FILTER (NOT is_new) AS o, max(text) FILTER (is_new) AS n FROM sides GROUP BY 1, 2, 3),
counted AS (
  SELECT document_id, version, count(*) FILTER (o IS NULL) AS a, count(*) FILTER (n IS NULL) AS r, count(*) FILTER (o <> n) AS m
  FROM matched GROUP BY 1, 2),
strategies AS (
  SELECT document_id, version, CASE WHEN bool_or(strategy = 'section') THEN 'section' ELSE 'paragraph' END AS strategy_used
  FROM sides GROUP BY 1, 2),
ingested AS (
  SELECT document_id, version, coalesce(strategy_used, 'paragraph') AS strategy_used, CAST(coalesce(a, 0) AS INT) AS total_added,
    CAST(coalesce(r, 0) AS INT) AS total_removed, CAST(coalesce(m, 0) AS INT) AS total_modified,
    coalesce(nullif(concat_ws(', ', CASE WHEN a > 0 THEN a || ' clause(s) added' END,
      CASE WHEN r > 0 THEN r || ' clause(s) removed' END, CASE WHEN m > 0 THEN m || ' clause(s) modified' END), ''),
      'No statutory changes detected') AS summary
  FROM pairs LEFT JOIN counted USING (document_id, version) LEFT JOIN strategies USING (document_id, version))"""

CODES = r"""
issues AS (SELECT user_id, ts AS tried, event_id, CAST(event_id % 1000 AS VARCHAR) AS code FROM events WHERE event_type = 'signup'),
clicks AS (SELECT user_id, ts AS tried, event_id FROM events WHERE event_type = 'click'),
placed AS (SELECT c.*, i.code, i.tried AS issued FROM clicks c ASOF LEFT JOIN issues i ON c.user_id = i.user_id AND c.tried >= i.tried),
judged AS (
  SELECT *, CASE WHEN event_id % 4 = 0 OR code IS NULL THEN 'invalid_code' WHEN tried > issued + INTERVAL 15 MINUTE THEN 'code_expired'
    ELSE 'verified' END AS verdict FROM placed),
firsts AS (SELECT user_id, min(tried) AS f FROM judged WHERE verdict = 'verified' GROUP BY 1),
outcomes AS (
  SELECT event_id, j.user_id, tried, CASE WHEN c_custkey IS NULL THEN 'user_not_found'
    WHEN c_custkey % 11 = 0 OR f < tried THEN 'already_verified' ELSE verdict END AS outcome
  FROM judged j LEFT JOIN customer ON c_custkey = j.user_id LEFT JOIN firsts USING (user_id))"""

REDACT = "The text and its changes are shown to readers with access. A trial or a subscription opens them."


def all_queries() -> dict[str, str]:
    w, q = o._with, {}

    # --- sources and sinks
    q["q01_source_catalogue"] = w(o.SOURCES, "SELECT * EXCLUDE (s_suppkey) FROM sources")
    q["q02_link_list_to_sources"] = r"""
      WITH u AS (
        SELECT page_id, regexp_replace(regexp_extract(page_id + 1 || '. ' || url || '/  listed', '^\d+\.\s*(https?://\S+)', 1), '/+$', '') AS base_url
        FROM pages WHERE page_id % 7 <> 6),
      n AS (SELECT *, row_number() OVER (ORDER BY page_id) AS k,
        regexp_extract(replace(regexp_extract(base_url, '^https?://([^/?#]*)', 1), 'www.', ''), '^([^.]*)', 1) AS label FROM u)
      SELECT 'site-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k || '-' || label AS id,
        upper(label[1]) || lower(label[2:]) || ' Statutory Monitor' AS name, base_url,
        CASE WHEN contains(base_url, 'municode') THEN 'municode' WHEN contains(base_url, 'legistar') OR contains(base_url, 'granicus') THEN 'granicus'
          WHEN contains(base_url, 'civicplus') THEN 'civicplus' ELSE 'custom' END AS adapter_type FROM n"""
    q["q03_catalogue_new_sources"] = w(o.SOURCES, "SELECT id, base_url FROM sources WHERE NOT is_active")
    q["q03_new_source_counts"] = w(o.SOURCES, """SELECT count(*) AS configured, count(*) FILTER (is_active) AS stored,
      count(*) FILTER (NOT is_active) AS new FROM sources""")
    q["q04_json_listing_ingest"] = """
      SELECT CAST(doc_id AS VARCHAR) AS source_id, pos, 'Zoning record ' || doc_id AS title,
        'https://register.example.gov/' || doc_id || '/2024-05-01' AS url, 'zoning_code' AS document_type,
        md5(text) AS snippet, '2024-05-01' AS date, 'rest_api_json' AS source_format
      FROM documents, (VALUES (0), (1)) AS t(pos) WHERE doc_id % 6 = 0
      UNION ALL
      SELECT CAST(doc_id AS VARCHAR), 0, 'Minutes ' || doc_id, 'https://api.example.gov/file/' || doc_id || '?p=1', 'meeting_minutes',
        md5(text), '', 'rest_api_json'
      FROM documents WHERE doc_id % 6 IN (1, 2)"""
    q["q04_json_listing_templates"] = """
      SELECT CAST(doc_id AS VARCHAR) AS source_id, pos, printf('https://register.example.gov/%07d-%x/2024/________________________Zoning', doc_id, doc_id) AS url
      FROM documents, (VALUES (0), (1)) AS t(pos) WHERE doc_id % 6 = 0
      UNION ALL
      SELECT CAST(doc_id AS VARCHAR), 0, 'https://api.example.gov/file/' || doc_id || '?p=1' FROM documents WHERE doc_id % 6 IN (1, 2)"""
    q["q04_json_listing_results"] = """
      SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id % 6 <> 3 AS success,
        list_extract([2, 1, 1, 0, 0, 0], CAST(doc_id % 6 AS INT) + 1) AS items_found,
        CASE WHEN doc_id % 6 = 3 THEN 'Expected JSON from https://api.example.gov/v1/' || doc_id || ' but could not parse it' END AS error
      FROM documents"""
    q["q05_feed_ingest"] = """
      SELECT CAST(doc_id AS VARCHAR) AS source_id, pos, 'Rule ' || pos + 1 || ' of ' || doc_id AS title,
        'https://feeds.example.gov/uksi/' || doc_id || '/' || pos + 1 AS url, 'ordinance' AS document_type,
        '2024-03-0' || pos + 1 AS date, 'xml_feed' AS source_format
      FROM documents, (VALUES (0), (1)) AS t(pos) WHERE doc_id % 5 = 0
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 'Agenda & notes ' || doc_id, 'https://feeds.example.gov/i/' || doc_id, 'meeting_minutes', NULL, 'xml_feed'
      FROM documents WHERE doc_id % 5 = 1
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 'Act ' || doc_id, 'https://feeds.example.gov/act/' || doc_id, 'notice', NULL, 'xml_feed'
      FROM documents WHERE doc_id % 5 = 2
      UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 'Statutory Record', 'https://feeds.example.gov/a/act2.xml', 'notice', NULL, 'xml_feed'
      FROM documents WHERE doc_id % 5 = 2"""
    q["q05_feed_results"] = """
      SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id % 5 < 3 AS success,
        list_extract([4, 2, 2, 0, 0], CAST(doc_id % 5 AS INT) + 1) AS items_found FROM documents"""
    q["q06_direct_document_register"] = w(o.PROBES, f"""
      SELECT s.id AS source_id, coalesce(http_status = 200, false) AS success,
        CASE WHEN http_status = 200 THEN coalesce(document_title, s.name) END AS title,
        CASE WHEN http_status = 200 THEN base_url END AS url,
        CASE WHEN http_status = 200 THEN {o.CLASSIFY.format(t="coalesce(document_title, s.name)", u="base_url")} END AS document_type,
        CASE WHEN http_status = 200 THEN 'application/xml' END AS content_type,
        CASE WHEN http_status IS DISTINCT FROM 200 THEN coalesce(error_text, 'HTTP ' || http_status) END AS error
      FROM sources s JOIN probes p ON s.id = p.source_id WHERE adapter_type = 'direct_document'""")
    q["q07_page_landing_scan"] = "SELECT page_id, url, length(html) AS body_chars FROM pages WHERE length(html) >= 1"
    q["q08_page_text_scan"] = w(o.PAGES, "SELECT document_id, page_no, image_count, length(page_text) AS text_chars FROM ptexts")
    q["q09_snapshot_append"] = w(o.SNAPSHOTS, """SELECT document_id, version, sha256(cleaned_text) AS text_hash,
      CAST(CAST(crawled_at AS DATE) AS VARCHAR) AS crawl_date FROM snapshots""")
    q["q10_diff_append"] = w(o.CHANGES, """SELECT document_id, document_id || '-1' AS previous_snapshot_id, document_id || '-2' AS current_snapshot_id,
      total_added AS added_clauses_count, total_removed AS removed_clauses_count, total_modified AS modified_in_payload, summary FROM payload""")
    q["q11_report_export"] = w(o.PROBES, "SELECT source_id, name, http_status, recommendation, docs_found, category FROM audited")

    # --- link discovery
    q["q12_extract_links"] = w(o.ANCHORS, "SELECT page_id, pos, href, text, '' AS link_title, '' AS link_id, '' AS link_class FROM links0")
    q["q13_selector_filter"] = w(o.ANCHORS, """SELECT page_id, pos, href FROM links
      WHERE contains(href, '.pdf') OR contains(href, 'notice') OR contains(href, 'ordinance')""")
    # The place of a link counts, not its markup: so many links stand before the element, so many in it.
    count = """len(regexp_extract_all({}, '<a href="[^"]*">[^<]*</a>'))"""
    q["q13_scoped_selector"] = w(o.ANCHORS + rf""",
      cut AS (SELECT page_id, html, regexp_extract(html, '(?s)<nav[^>]*>.*?</nav>') AS nav, regexp_extract(html, '(?s)<footer[^>]*>.*?</footer>') AS foot FROM pages),
      scope AS (SELECT page_id, {count.format("nav")} AS nav_n, {count.format("foot")} AS foot_n,
        {count.format("left(html, strpos(html, nav) - 1)")} AS nav_at, {count.format("left(html, strpos(html, foot) - 1)")} AS foot_at FROM cut)""",
      """SELECT a.page_id, CAST(pos AS INT) AS pos, regexp_extract(a, 'href="([^"]*)"', 1) AS href FROM anchors a JOIN scope USING (page_id)
      WHERE (pos >= nav_at AND pos < nav_at + nav_n AND contains(regexp_extract(a, 'href="([^"]*)"', 1), 'th'))
        OR (pos >= foot_at AND pos < foot_at + foot_n AND regexp_extract(a, 'href="([^"]*)"', 1) LIKE '/%')""")
    q["q14_meeting_table_links"] = r"""
      WITH w AS (
        SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)">', 1)) AS word,
          generate_subscripts(regexp_extract_all(html, '<a href="/([^"]*)">', 1), 1) - 1 AS i FROM pages),
      r AS (
        SELECT CAST(page_id AS VARCHAR) AS source_id, page_id, 'Council ' || word AS meeting, '2024-01-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') AS d,
          CASE i % 4 WHEN 0 THEN 'https://meet.example.gov/c/' || page_id || '/View.ashx?M=A&ID=' || i
            WHEN 1 THEN 'https://meet.example.gov/docs/' || i || '.pdf' WHEN 2 THEN 'https://meet.example.gov/c/' || page_id || '/m/' || i END AS url,
          CASE i % 4 WHEN 0 THEN 'Agenda' WHEN 1 THEN 'Packet' ELSE 'Minutes' END AS label, i FROM w WHERE i % 4 < 3),
      a AS (SELECT source_id, url, trim(meeting) || ' - ' || label AS title, d FROM r
        UNION ALL SELECT CAST(page_id AS VARCHAR), 'https://meet.example.gov/top.pdf', 'Top', NULL FROM pages WHERE page_id % 3 = 2)
      SELECT source_id, url, title, d AS published_date, """ + o.CLASSIFY.format(t="title", u="url") + " AS document_type FROM a"
    q["q15_drop_nonnavigable"] = w(o.ANCHORS, """SELECT page_id, pos, href FROM links
      WHERE href <> '' AND href NOT LIKE 'javascript:%' AND href NOT LIKE 'mailto:%' AND href <> '#'""")
    q["q16_statutory_heuristic"] = w(o.ANCHORS, f"SELECT page_id, pos, href, text FROM links WHERE regexp_matches(href || ' ' || text, '{o.HEURISTIC}')")
    q["q17_normalize_url"] = w(o.ANCHORS, "SELECT page_id, pos, url FROM urls")
    path = "lower(regexp_extract(url, '^[a-z]+:(?://[^/?#]*)?([^?#]*)', 1))"
    is_pdf = f"({path} LIKE '%.pdf' OR contains({path}, 'view.ashx') OR contains({path}, 'viewfile') OR contains({path}, 'documentcenter'))"
    q["q18_is_pdf"] = w(o.ANCHORS, f"SELECT page_id, pos, {is_pdf} AS by_url, pos % 3 = 0 OR {is_pdf} AS by_type_or_url FROM urls")
    q["q19_ingest_route"] = w(o.ANCHORS, "SELECT page_id, pos, CASE WHEN contains(lower(url), 'pdf') THEN 'pdf' ELSE 'html' END AS route FROM urls")
    q["q20_exclude_domains"] = w(o.ANCHORS, f"SELECT page_id, pos, url FROM urls WHERE NOT ({o.BLOCKED})")
    q["q21_classify_document"] = w(o.ANCHORS, f"SELECT page_id, pos, {o.CLASSIFY.format(t='text', u='url')} AS document_type FROM urls")
    q["q22_classify_basic"] = w(o.ANCHORS + r""",
      full_urls AS (
        SELECT page_id, pos, text, CASE WHEN href LIKE 'javascript:%' OR href LIKE 'http%' THEN href
          WHEN href LIKE '//%' THEN regexp_extract(base_url, '^(https?:)', 1) || href
          WHEN href LIKE '/agenda/../%' THEN regexp_extract(base_url, '^(https?://[^/]+)', 1) || substring(href, 11)
          ELSE regexp_extract(base_url, '^(https?://[^/]+)', 1) || href END AS full_url FROM links)""",
      """SELECT page_id, pos, full_url, CASE WHEN contains(lower(text), 'minute') OR contains(lower(full_url), 'minute') THEN 'meeting_minutes'
        WHEN contains(lower(text), 'ordinance') OR contains(lower(full_url), 'ordinance') THEN 'ordinance' ELSE 'notice' END AS document_type FROM full_urls""")
    q["q23_link_title"] = w(o.ANCHORS, """SELECT page_id, pos, coalesce(CASE WHEN pos % 3 <> 1 THEN nullif(text, '') END, CASE WHEN pos % 2 = 0 THEN 'Title ' || pos END,
      list_extract(['Municipal Document', 'Legistar Document', 'Municode Statutory Item', 'CivicPlus Document', 'Notice Document'], CAST(pos % 5 AS INT) + 1)) AS title FROM links""")
    q["q24_dedupe_links"] = w(o.ANCHORS, """SELECT source_id, url, pos, text FROM (
        SELECT source_id, url, page_id * 1000 + pos AS pos, text,
          row_number() OVER (PARTITION BY source_id, url ORDER BY page_id * 1000 + pos) AS k FROM urls) WHERE k = 1""")
    q["q24_discover_documents"] = w(o.ANCHORS, f"""
      SELECT source_id, url, pos, title, document_type, 'custom_heuristic' AS platform FROM (
        SELECT *, {o.CLASSIFY.format(t='title', u='url')} AS document_type, row_number() OVER (PARTITION BY source_id, url ORDER BY pos) AS k FROM (
          SELECT CAST(page_id AS VARCHAR) AS source_id, pos, coalesce(nullif(text, ''), 'Municipal Document') AS title,
            regexp_extract(base_url, '^(https?://[^/]+)', 1) || '/notices' || href AS url
          FROM links0 WHERE regexp_matches('/notices' || href || ' ' || text, '{o.HEURISTIC}')) WHERE NOT ({o.BLOCKED})) WHERE k = 1""")
    q["q25_adapter_route"] = w(o.SOURCES, """SELECT id, CASE WHEN adapter_type IN ('municode', 'granicus', 'civicplus', 'custom', 'rest_api', 'direct_document') THEN adapter_type
      WHEN adapter_type IN ('api', 'json') THEN 'rest_api' WHEN adapter_type IN ('xml', 'atom', 'feed') THEN 'xml_feed' ELSE 'custom' END AS adapter FROM sources""")
    q["q26_infer_adapter"] = r"""
      SELECT page_id, list_extract(['municode', 'granicus', 'granicus', 'civicplus', 'custom'], CAST(page_id % 5 AS INT) + 1) AS adapter,
        regexp_extract(replace(regexp_extract(url, '^https?://([^/?#]*)', 1), 'www.', ''), '^([^.]*)', 1) AS label FROM pages"""
    q["q27_static_else_rendered"] = w(o.ANCHORS, """
      SELECT source_id, url, 'static' AS origin FROM urls WHERE base_url LIKE 'http:%'
      UNION ALL SELECT source_id, url, 'rendered' FROM urls WHERE base_url LIKE 'https:%'
        AND source_id NOT IN (SELECT source_id FROM urls WHERE base_url LIKE 'http:%')""")
    q["q28_link_metadata"] = w(o.ANCHORS, """SELECT page_id, pos, '{' || concat_ws(',', CASE WHEN pos % 2 = 0 THEN '"platform":"custom_heuristic"' END,
      CASE WHEN pos % 2 = 1 THEN '"source_format":"xml_feed"' END,
      CASE WHEN pos % 3 = 0 THEN '"date":"2024-01-' || lpad(CAST(pos % 28 + 1 AS VARCHAR), 2, '0') || '"' END) || '}' AS metadata FROM links""")
    q["q29_unsafe_url_flag"] = w(o.ANCHORS, "SELECT page_id, pos, pos % 8 BETWEEN 1 AND 6 AS unsafe FROM urls")

    # --- extraction and cleaning
    q["q30_html_to_lines"] = f"SELECT page_id, md5(t) AS text_md5, len(string_split(t, chr(10))) AS lines FROM (SELECT page_id, {o.html_text('html')} AS t FROM pages)"
    q["q31_normalize_unicode"] = _text(_unicode("d"))
    q["q32_dehyphenate"] = _text("regexp_replace(d, '(\\b[A-Za-z]+)-\\n([A-Za-z]+\\b)', '\\1\\2', 'g')")
    q["q33_strip_boilerplate"] = _text(_boilerplate("d"))
    q["q34_strip_source_disclaimers"] = _text(_phrases("d"))
    q["q35_collapse_blank_lines"] = _text(o.collapse("d"))
    q["q36_clean_text"] = _text(o.clean("d"))
    q["q37_repeated_lines"] = w(o.PAGES, "SELECT * FROM repeated")
    cleaned = o.PAGES + f""",
      kept AS (
        SELECT l.document_id, l.page_no, string_agg(line, chr(10) ORDER BY n) AS t FROM pnorm l
        WHERE NOT EXISTS (SELECT 1 FROM repeated r WHERE r.document_id = l.document_id AND r.line = l.norm) GROUP BY 1, 2),
      cpages AS (SELECT document_id, page_no, {o.clean('t')} AS c FROM kept),
      joined AS (
        SELECT document_id, coalesce(string_agg(c, chr(10) || chr(10) ORDER BY page_no) FILTER (c <> ''), '') AS t
        FROM (SELECT DISTINCT document_id FROM ptexts) LEFT JOIN cpages USING (document_id) GROUP BY 1)"""
    q["q38_clean_multipage"] = w(cleaned, "SELECT document_id, md5(t) AS text_md5, length(t) AS chars FROM joined")
    q["q39_raw_text_join"] = w(o.PAGES, f"""SELECT document_id, count(*) AS page_count,
      md5(string_agg(trim(page_text, {o.WS}), chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no)) AS text_md5 FROM ptexts GROUP BY 1""")
    sparse = f"length(trim(page_text, {o.WS})) < 40 AND (image_count > 0 OR trim(page_text, {o.WS}) = '')"
    q["q40_low_density_pages"] = w(o.PAGES, f"SELECT document_id, page_no, length(trim(page_text, {o.WS})) AS text_length, image_count, {sparse} AS needs_ocr FROM ptexts")
    q["q40_ocr_documents"] = w(o.PAGES, f"SELECT document_id, bool_or({sparse}) AS needs_ocr, count(*) FILTER ({sparse}) AS low_density_pages FROM ptexts GROUP BY 1")
    q["q41_extraction_metrics"] = w(o.PAGES, f"""SELECT document_id, page_no, raw_chars, clean_chars,
        CASE WHEN raw_chars > 0 THEN CAST(round(CAST((raw_chars - clean_chars) * 1000 AS DECIMAL(18,4)) / raw_chars) / 10 AS DOUBLE) ELSE 0 END AS reduction_pct
      FROM (SELECT document_id, page_no, length(page_text) AS raw_chars, length({o.clean('page_text')}) AS clean_chars FROM ptexts)""")

    # --- clauses and changes
    q["q42_split_sections"] = w(o.CLAUSES, "SELECT * REPLACE (md5(text) AS text) FROM sections")
    q["q43_split_paragraphs"] = w(o.CLAUSES, "SELECT * EXCLUDE (line_start, line_end) REPLACE (md5(text) AS text) FROM paragraphs")
    q["q44_split_clauses"] = w(o.CLAUSES, "SELECT document_id, version, strategy, pos, identifier, section_number, title FROM clauses")
    q["q47_clause_key"] = w(o.CLAUSES, "SELECT document_id, version, pos, key AS clause_key FROM keyed")
    twice = o.CLAUSES.replace(
        "snapshots AS (",
        "snapshots AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS version, v1 || chr(10) || v2 AS cleaned_text FROM ver),\nunused AS (",
    )
    q["q48_clause_last_wins"] = w(twice, "SELECT document_id, key, ord, md5(text) AS text_md5 FROM uniq")
    q["q49_clause_changes"] = w(o.CHANGES, """SELECT document_id, version, ord, change_type, clause_key, identifier, section_number,
      md5(old_text) AS old_md5, md5(new_text) AS new_md5 FROM changes""")
    q["q50_diff_payload"] = w(o.CHANGES, "SELECT document_id, version, total_added, total_removed, total_modified, summary FROM payload")
    q["q51_diff_strategy"] = w(o.CHANGES, "SELECT document_id, version, strategy_used FROM payload")

    # --- versions
    q["q52_content_hash"] = w(o.FETCHES, f"SELECT document_id, fetch_id, {o._ts('fetched_at')}, content_hash FROM fetches")
    q["q53_latest_snapshot"] = w(o.SNAPSHOTS, f"""SELECT document_id, id, version, {o._ts('crawled_at')}, sha256(cleaned_text) AS text_hash FROM (
      SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version DESC) AS k FROM snapshots) WHERE k = 1""")
    q["q54_detect_changes"] = w(o.FETCHES, "SELECT document_id, fetch_id, content_hash, previous_hash FROM kept")
    q["q55_assign_versions"] = w(o.FETCHES, "SELECT document_id, fetch_id, version FROM kept")
    q["q56_snapshot_pairs"] = w(o.FETCHES, """SELECT * FROM (SELECT document_id, version, lag(fetch_id) OVER v AS previous_fetch, fetch_id AS current_fetch,
      lag(content_hash) OVER v AS previous_hash, content_hash AS current_hash FROM kept WINDOW v AS (PARTITION BY document_id ORDER BY version))
      WHERE previous_fetch IS NOT NULL""")
    q["q57_register_documents"] = w(o.ANCHORS + f""",
      seen AS (SELECT source_id, url, text AS title, {o.CLASSIFY.format(t='text', u='url')} AS document_type, page_id * 1000 + pos AS seen_at FROM urls),
      first AS (SELECT *, row_number() OVER (PARTITION BY source_id, url ORDER BY seen_at) AS k FROM seen)""",
      """SELECT sha256(source_id || chr(1) || url) AS document_id, source_id, url, title, document_type, seen_at AS created_at FROM first f WHERE k = 1
        AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.source_id = f.source_id AND s.url = f.url AND s.document_type = 'meeting_minutes')""")
    q["q58_upsert_sources"] = w(o.SOURCES, """
      SELECT CASE WHEN st THEN id ELSE 'new-' || id END AS id, base_url, CASE WHEN inc THEN name || ' v2' ELSE name END AS name, adapter_type,
        CASE WHEN inc THEN 'a[href*=''.pdf'']' END AS link_selector, CASE WHEN st THEN state ELSE 'changed' END AS state, is_active, health_status,
        CAST(NULL AS VARCHAR) AS status_detail, CASE WHEN NOT st THEN 'inserted' WHEN inc THEN 'updated' ELSE 'unchanged' END AS action
      FROM (SELECT *, coalesce(health_status <> 'operational', false) AS st, is_active AS inc FROM sources) WHERE st OR inc""")
    q["q59_document_status"] = w(o.FETCHES, """SELECT document_id, arg_max(k.content_hash, version) AS current_content_hash, CAST(any_value(last) AS VARCHAR) AS last_crawled_at,
      CAST(max(fetched_at) AS VARCHAR) AS last_changed_at, max(version) AS versions
      FROM kept k JOIN (SELECT document_id, max(fetched_at) AS last FROM fetches GROUP BY 1) USING (document_id) GROUP BY document_id""")
    q["q60_ingest_batch"] = w(INGESTED, "SELECT * FROM ingested")
    q["q101_page_stream_ingest"] = q["q60_ingest_batch"]
    q["q60_crawl_run"] = w(o.FETCHES + """,
      tried AS (SELECT CAST(least(fetch_id % 10, 1) AS VARCHAR) AS run_id, source_id, bool_and(fetch_id % 97 <> 5) AS ok,
        count(*) FILTER (fetch_id % 97 <> 5) AS n FROM fetches GROUP BY 1, 2),
      made AS (SELECT CAST(least(fetch_id % 10, 1) AS VARCHAR) AS run_id, count(*) FILTER (version > 1) AS diffs, count(DISTINCT CASE WHEN version = 1 THEN document_id END) AS new
        FROM kept GROUP BY 1)""", """
      SELECT run_id, count(*) AS total_sources, count(*) FILTER (ok) AS sources_succeeded, count(*) FILTER (NOT ok) AS sources_failed,
        CAST(sum(n) AS BIGINT) AS documents_found, any_value(diffs) AS diffs_created, any_value(new) AS documents_registered,
        CASE WHEN bool_and(ok) THEN 'completed' WHEN bool_or(ok) THEN 'partial_failure' ELSE 'failed' END AS status
      FROM tried JOIN made USING (run_id) GROUP BY run_id""")

    # --- search
    q["q61_search_snapshots_substring"] = w(DIFFS, f"""SELECT f.id, document_id, version, doc_title, doc_url, s.name AS source_name, s.state AS source_state,
      {o._ts('crawled_at')} FROM fsnaps f LEFT JOIN sources s ON f.source_id = s.id""")
    q["q62_search_diffs_substring"] = w(DIFFS, f"""SELECT d.id, document_id, title AS doc_title, s.name AS source_name, {o._ts('generated_at')}
      FROM dtext d JOIN registry r USING (document_id) LEFT JOIN sources s ON r.source_id = s.id
      WHERE contains(lower(diff_text), 'added clause') ORDER BY d.generated_at DESC, d.id LIMIT 30""")
    q["q63_term_index"] = w(o.SNAPSHOTS, _postings("snapshots", "cleaned_text"))
    q["q65_diff_term_index"] = w(DIFFS, _postings("dtext", "diff_text"))
    q["q66_search_all_terms"] = w(o.SNAPSHOTS + f""",
      postings AS ({_postings('snapshots', 'cleaned_text')}),
      hit AS (SELECT id FROM postings WHERE term IN ('amended', 'clause', '5') GROUP BY 1 HAVING count(*) = 3),
      """ + o.REGISTRY + "," + o.SOURCES, f"""
      SELECT f.id, document_id, version, r.title AS doc_title, s.name AS source_name, {o._ts('crawled_at')}
      FROM snapshots f SEMI JOIN hit USING (id) JOIN registry r USING (document_id) LEFT JOIN sources s ON r.source_id = s.id
      ORDER BY f.crawled_at DESC, f.id LIMIT 30""")
    q["q66_search_diff_terms"] = w(DIFFS + f""",
      dpostings AS ({_postings('dtext', 'diff_text')}),
      dhit AS (SELECT id FROM dpostings WHERE term IN ('new', 'clause', 'modified') GROUP BY 1 HAVING count(*) = 3)""", f"""
      SELECT d.id, document_id, version, title AS doc_title, s.name AS source_name, {o._ts('generated_at')}
      FROM dtext d SEMI JOIN dhit USING (id) JOIN registry r USING (document_id) LEFT JOIN sources s ON r.source_id = s.id
      ORDER BY d.generated_at DESC, d.id LIMIT 30""")
    q["q67_result_cards"] = w(DIFFS, f'SELECT card_id, type, entity, doc, section, md5("full") AS full_md5, url, {o._ts("ts")} FROM cards')
    q["q68_snapshot_preview"] = w(o.SNAPSHOTS, """SELECT id, CASE WHEN length(cleaned_text) > 240 THEN left(cleaned_text, 240) || '...' ELSE cleaned_text END AS card_preview,
      CASE WHEN length(cleaned_text) > 300 THEN left(cleaned_text, 300) || '...' ELSE cleaned_text END AS page_preview FROM snapshots""")
    q["q69_filter_by_type"] = w(DIFFS, "SELECT card_id, type, section FROM cards WHERE type = 'diff'")
    q["q70_search_totals"] = w(DIFFS, "SELECT (SELECT count(*) FROM fsnaps) AS total_snapshots, (SELECT count(*) FROM fdiffs) AS total_diffs")
    q["q71_gate_results"] = w(DIFFS + "," + ACCESS, f"""
      SELECT card_id, type, section, CASE WHEN ok THEN "full" ELSE '{REDACT}' END AS "full", NOT ok AS is_locked FROM (
        SELECT *, row_number() OVER (ORDER BY part, ts DESC, fid, k, ord) AS place,
          (SELECT coalesce(bool_or(has_access), false) FROM access WHERE user_id = '17') AS ok FROM cards) WHERE ok OR place <= 2""")
    q["q71_open_results"] = w(DIFFS, """SELECT card_id, md5("full") AS full_md5, false AS is_locked FROM cards WHERE type = 'snapshot'""")
    q["q72_diff_display"] = w(o.CHANGES, """SELECT document_id, version, ord, CASE change_type WHEN 'added' THEN 'Added' WHEN 'removed' THEN 'Removed' ELSE 'Modified' END AS badge,
      identifier, md5(CASE change_type WHEN 'removed' THEN old_text ELSE new_text END) AS shown_md5 FROM changes""")

    # --- billing
    q["q73_normalize_events"] = w(o.EVENTS, f"""SELECT delivery_id, event_id, event_type, status, subscription_id, email, subscriber_name,
      {o._ts('next_billing_at')}, plan_id FROM norm""")
    q["q74_payment_amounts"] = w(o.EVENTS, "SELECT delivery_id, CAST(amount AS DOUBLE) AS amount, currency FROM norm")
    q["q75_dedupe_events"] = w(DEDUPED, "SELECT delivery_id, event_id, event_type, subscription_id, result, error_detail, deliveries FROM deduped")
    q["q102_event_stream_outcomes"] = q["q75_dedupe_events"]
    q["q76_truncate_payload"] = """SELECT doc_id, md5(CASE WHEN length(j) <= 20000 THEN j ELSE '{}' END) AS payload_md5
      FROM (SELECT doc_id, '{"doc_id":' || doc_id || ',"text":' || to_json(text) || '}' AS j FROM documents)"""
    q["q77_default_next_billing"] = w(o.EVENTS, f"SELECT delivery_id, status, plan_id, {o._ts('next_billing_at')} FROM billed")
    state = f"SELECT subscription_id, status, email, subscriber_name, plan_id, {o._ts('next_billing_at', 'created_at', 'updated_at')} FROM subs"
    q["q78_fold_subscriptions"] = w(o.EVENTS, state)
    q["q103_subscription_state_stream"] = w(o.EVENTS, state)
    priced = o.EVENTS + "," + o.PLANS
    q["q79_subscriber_list"] = w(priced, f"""SELECT subscription_id, coalesce(subscriber_name, email, 'Unknown subscriber') AS name, email, status,
      {o._ts('next_billing_at', 'created_at')}, p.id AS plan, coalesce(p.name, 'Unrecognised plan') AS plan_name, CAST(p.price AS DOUBLE) AS plan_price, p.interval AS plan_interval
      FROM subs LEFT JOIN plans p ON plan_id = provider_plan_id""")
    q["q80_plan_counts"] = w(priced, """SELECT id, p.name, CAST(price AS DOUBLE) AS price, interval, provider_plan_id, is_active,
      (SELECT count(*) FROM subs WHERE plan_id = provider_plan_id AND status = 'active') AS subscribers FROM plans p""")
    q["q81_public_plans"] = w(priced, """SELECT id, name, CAST(price AS DOUBLE) AS price, interval FROM plans
      WHERE is_active AND provider_plan_id IN (SELECT plan_id FROM norm)""")
    mrr = "SELECT sum(CASE WHEN p.interval = 'year' THEN price ELSE price * 12 END) AS y FROM subs JOIN plans p ON plan_id = provider_plan_id WHERE status = 'active'"
    q["q82_revenue"] = w(priced, f"SELECT CAST(round(coalesce(y, 0) / 12, 2) AS DOUBLE) AS mrr, CAST(coalesce(y, 0) AS DOUBLE) AS arr FROM ({mrr})")
    q["q83_subscriber_buckets"] = w(o.EVENTS, """SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
      count(*) FILTER (status IN ('past_due', 'suspended')) AS past_due, count(*) FILTER (status IN ('cancelled', 'expired')) AS cancelled FROM subs""")
    q["q84_access_status"] = w(ACCESS, "SELECT * FROM access")
    q["q85_trial_activation"] = w(CODES, """SELECT event_id, user_id, CAST(tried AS VARCHAR) AS tried_at, outcome,
      CASE WHEN outcome = 'verified' THEN CAST(tried AS VARCHAR) END AS trial_started_at,
      CASE WHEN outcome = 'verified' THEN CAST(tried + INTERVAL 14 DAY AS VARCHAR) END AS trial_ends_at FROM outcomes""")
    q["q86_event_log"] = w(DEDUPED, f"""SELECT delivery_id, event_id, event_type, coalesce(nullif(subscriber_name, ''), subscription_id, 'Unknown') AS display_name,
      CAST(nullif(amount0, -1) AS DOUBLE) AS amount, nullif(currency0, '') AS currency, result, error_detail, {o._ts('received_at')}
      FROM deduped ORDER BY deduped.received_at DESC, delivery_id DESC LIMIT 50""")
    q["q86_event_log_totals"] = w(DEDUPED, """SELECT count(*) AS count, count(*) FILTER (result <> 'processed') AS failed
      FROM (SELECT * FROM deduped ORDER BY received_at DESC, delivery_id DESC LIMIT 200)""")
    q["q102_event_stream_dedupe"] = w(o.EVENTS, "SELECT DISTINCT coalesce(event_id, CAST(delivery_id AS VARCHAR)) AS event_key, 1 AS kept FROM norm")

    # --- health and runs
    q["q87_active_sources"] = w(o.SOURCES, "SELECT id, name, is_active FROM sources WHERE is_active ORDER BY name")
    q["q88_all_sources"] = w(o.SOURCES, "SELECT id, name, is_active, health_status FROM sources ORDER BY is_active DESC, name")
    health = """SELECT count(*) AS total, count(*) FILTER (health_status = 'operational') AS operational,
      count(*) FILTER (health_status = 'cloudflare_blocked') AS cloudflare_blocked, count(*) FILTER (health_status = 'dead_link') AS dead_link FROM sources"""
    q["q89_health_counts"] = w(o.SOURCES, health)
    q["q90_source_results"] = w(o.CRAWL, "SELECT * FROM results")
    q["q91_run_summary"] = w(o.CRAWL, f"""SELECT run_id, {o._ts('finished_at')}, total_sources, sources_succeeded, sources_failed, documents_found,
      coalesce(n, 0) AS diffs_created, status FROM summary LEFT JOIN (
        SELECT CAST(CAST(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_days(2) AS DATE) AS VARCHAR) AS run_id, count(*) AS n FROM documents GROUP BY 1)
      USING (run_id)""")
    q["q92_run_failures"] = w(o.CRAWL, "SELECT run_id, source_id, source_name, error FROM results WHERE NOT success")
    q["q93_run_report"] = w(o.CRAWL + """,
      ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY source_name, source_id) AS k FROM results WHERE NOT success),
      shown AS (SELECT run_id, string_agg(source_name || '|' || left(error, 160), chr(10) ORDER BY k) AS f FROM ranked WHERE k <= 25 GROUP BY 1)""", """
      SELECT run_id, CASE WHEN sources_failed > 0 THEN sources_failed || ' of ' || (sources_succeeded + sources_failed) || ' sources failed'
          ELSE 'daily crawl clean (' || sources_succeeded || ' sources)' END AS subject, sources_succeeded, sources_failed, documents_found,
        CAST(0 AS BIGINT) AS diffs_created, md5(coalesce(f, '')) AS failures, greatest(sources_failed - 25, 0) AS more, sources_failed > 0 AS send
      FROM summary LEFT JOIN shown USING (run_id)""")
    q["q94_audit_category"] = w(o.PROBES, "SELECT source_id, name, http_status, category, error_detail, recommendation, docs_found FROM audited")
    q["q95_audit_sample"] = w(o.PROBES, """SELECT source_id, name, docs_found, left(title, 45) AS sample_title, durl AS sample_url, 'notice' AS sample_type
      FROM audited WHERE category = 'healthy_success'""")
    q["q96_audit_summary"] = w(o.PROBES, """SELECT ord, c.category, count(a.source_id) AS sources,
        CAST(round(count(a.source_id) * 100.0 / (SELECT count(*) FROM audited), 1) AS DOUBLE) AS percentage
      FROM (VALUES (1, 'healthy_success'), (2, 'dead_links_client'), (3, 'access_restricted_waf'), (4, 'selector_tuning_needed')) AS c(ord, category)
      LEFT JOIN audited a USING (category) GROUP BY ALL""")
    verdict = """SELECT source_id, url, http_status, CASE WHEN http_status IS NULL THEN 'ERROR (' || error_class || ')'
      WHEN contains(body, 'Just a moment') AND http_status IN (403, 503) THEN 'CLOUDFLARE_CAPTCHA'
      WHEN http_status >= 400 THEN 'FAIL (HTTP ' || http_status || ')' ELSE 'PASS' END AS verdict FROM probes"""
    q["q97_probe_verdict"] = w(o.PROBES, verdict)
    q["q97_probe_totals"] = w(o.PROBES, f"SELECT count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict <> 'PASS') AS failed, count(*) AS total FROM ({verdict})")
    q["q98_two_probe_verdict"] = w(o.PROBES, """SELECT url, http_status, browser_status, CASE
        WHEN http_status = 404 OR browser_status = 404 OR is_404 OR contains(body, 'Page Not Found') THEN 'CONFIRMED_404_DEAD_LINK'
        WHEN browser_error LIKE '%net::ERR_NAME_NOT_RESOLVED%' OR browser_error LIKE '%net::ERR_CONNECTION%' THEN 'CONFIRMED_DNS_OR_CONNECTION_DEAD'
        WHEN browser_error LIKE '%Timeout%' AND error_text LIKE '%Timeout%' THEN 'CONFIRMED_SERVER_DOWN_TIMEOUT'
        WHEN is_challenge OR http_status = 403 OR browser_status = 403 OR (contains(body, 'Just a moment') AND http_status IN (403, 503)) THEN 'CONFIRMED_CLOUDFLARE_CAPTCHA'
        WHEN http_status = 200 THEN 'OPERATIONAL_PASS'
        ELSE 'FAILED (Req:' || coalesce(CAST(http_status AS VARCHAR), error_text) || ', PW:' || coalesce(CAST(browser_status AS VARCHAR), browser_error) || ')' END AS verdict FROM probes""")
    q["q99_catalogue_checks"] = w(o.SOURCES + """,
      s AS (SELECT id, CASE WHEN s_suppkey % 9 <> 2 THEN name END AS name, CASE WHEN s_suppkey % 8 = 3 THEN 'https://shared.example.gov' ELSE base_url END AS base_url,
        adapter_type, is_active, CASE WHEN s_suppkey % 10 <> 0 THEN health_status END AS health_status FROM sources)""", """
      SELECT 'missing_field' AS "check", id AS source_id, 'name' AS detail FROM s WHERE name IS NULL
      UNION ALL SELECT 'unknown_adapter', id, adapter_type FROM s WHERE adapter_type = 'Unlisted'
      UNION ALL SELECT 'inactive_without_reason', id, 'health_status' FROM s WHERE NOT is_active AND health_status IS NULL
      UNION ALL SELECT 'duplicate_url', min(id), base_url FROM s GROUP BY base_url HAVING count(*) > 1""")
    q["q100_overview"] = w(priced + "," + o.SOURCES, f"""
      SELECT total AS total_sources, operational, cloudflare_blocked, dead_link, total_subscribers, active_subscribers, past_due_subscribers, cancelled_subscribers,
        CAST(round(coalesce(y, 0) / 12, 2) AS DOUBLE) AS mrr, CAST(coalesce(y, 0) AS DOUBLE) AS arr
      FROM ({health}), ({mrr}), (SELECT count(*) AS total_subscribers, count(*) FILTER (status = 'active') AS active_subscribers,
        count(*) FILTER (status IN ('past_due', 'suspended')) AS past_due_subscribers,
        count(*) FILTER (status IN ('cancelled', 'expired')) AS cancelled_subscribers FROM subs)""")
    return q
