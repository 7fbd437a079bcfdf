"""URL columns: resolving, normalising and classifying document links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.stages import with_computed
from clausedelta.functions.text import strip

# Query parameters dropped from links.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
)

# A link is dropped when its host contains one of these.
EXCLUDED_HOSTS = (
    "instagram.com", "facebook.com", "twitter.com", "x.com", "youtube.com",
    "linkedin.com", "pinterest.com", "tiktok.com", "google.com", "apple.com",
    "cloudflare.com", "cookiebot.com", "schema.org", "w3.org", "recaptcha.net",
    "doubleclick.net", "googletagmanager.com", "onetrust.com", "trustarc.com",
)

# Terms that make a link worth keeping when no selector is set.
STATUTORY_TERMS = (
    r"\.pdf", r"\.ashx", r"\.aspx", "notice", "minute", "agenda", "ordinance", "bylaw", "by-law",
    "zoning", "statut", "regulation", "gazette", "rule", "plan", "code", "legislation", "act",
    "permit", "report", "document", "view", "hearing", "bylaws", "ordinances",
)

# Words that decide a document's type, tested in this order.
DOCUMENT_TYPES = (
    ("meeting_minutes", ("minute", "agenda", "calendar", "board-meeting", "session")),
    ("ordinance", ("ordinance", "amendment", "statute", "rule")),
    ("bylaw", ("bylaw", "by-law", "land-use")),
    ("zoning_code", ("zoning", "code-of-ordinances", "municode", "ecode360")),
)

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def hostname(url: Column) -> Column:
    """Host without user info and port, lowercase."""
    host = F.regexp_replace(netloc(url), r"^.*@", "")
    return F.lower(F.regexp_replace(host, r":[^:\]]*$", ""))


def _resolve_segments(joined: Column) -> Column:
    """Remove '.', '..' and empty inner segments from a rooted path array."""
    last = F.element_at(joined, -1)
    n = F.size(joined)
    inner = F.filter(joined, lambda s, i: (s != "") | (i == 0) | (i == n - 1))
    kept = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    text = F.array_join(closed, "/")
    return F.when(text == "", "/").otherwise(text)


def _clean_query(raw: Column) -> Column:
    """Drop tracking parameters, decode and re-encode the rest."""

    def decode(part: Column) -> Column:
        # A '%' that starts no escape stands for itself.
        return F.url_decode(F.regexp_replace(part, r"%(?![0-9A-Fa-f]{2})", "%25"))

    def encode(part: Column) -> Column:
        return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    pairs = F.transform(
        F.filter(F.split(raw, "&", -1), lambda p: p != ""),
        lambda p: F.struct(
            decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
            decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS))
    joined = F.array_join(F.transform(kept, lambda p: F.concat(encode(p["k"]), F.lit("="), encode(p["v"]))), "&")
    return F.when(raw == "", "").otherwise(joined)


def with_resolved_url(df: DataFrame, base: Column, href: Column, out: str, normalize: bool = True) -> DataFrame:
    """Resolve ``href`` against ``base``.

    ``normalize`` also lowers the host, forces http(s), drops the fragment and
    tracking parameters and re-encodes the query; an empty href gives ''.
    The steps are staged as columns so that no part is evaluated twice.
    """
    link = F.translate(strip(F.coalesce(href, F.lit(""))), "\t\r\n", "")
    base = F.coalesce(base, F.lit(""))
    df = with_computed(df, _base=base, _href=link)
    b, h = F.col("_base"), F.col("_href")
    parts = lambda u: F.struct(
        scheme(u).alias("scheme"), netloc(u).alias("netloc"), path(u).alias("path"), query(u).alias("query")
    )
    df = with_computed(df, _b=parts(b), _h=parts(h))
    bs, own = F.col("_b.scheme"), F.col("_h.scheme")
    default = F.when(bs == "", "https").otherwise(bs) if normalize else bs
    full_scheme = F.when(own != "", own).when(F.startswith(h, F.lit("//")), default).otherwise(bs)
    foreign = (full_scheme != bs) | (F.col("_h.netloc") != "") | (b == "")
    same_page = (F.col("_h.path") == "")
    base_dir = F.split(F.regexp_replace(F.col("_b.path"), r"[^/]*$", ""), "/", -1)
    own_parts = F.split(F.col("_h.path"), "/", -1)
    base_kept = F.when(
        F.size(base_dir) > 1, F.slice(base_dir, 1, F.size(base_dir) - 1)
    ).otherwise(F.when(F.col("_b.path") == "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    segments = F.when(F.startswith(F.col("_h.path"), F.lit("/")), own_parts).otherwise(F.concat(base_kept, own_parts))
    df = with_computed(df, _seg=F.when(~foreign & ~same_page, segments))
    simple = F.array_join("_seg", "/")
    needs_walk = simple.rlike(r"(^|/)\.\.?(/|$)|.//")
    resolved = F.when(needs_walk, _resolve_segments(F.col("_seg"))).when(simple == "", "/").otherwise(simple)
    df = with_computed(
        df,
        _u=F.struct(
            full_scheme.alias("scheme"),
            F.when(foreign, F.col("_h.netloc")).otherwise(F.col("_b.netloc")).alias("netloc"),
            F.regexp_replace(
                F.when(foreign, F.col("_h.path")).when(same_page, F.col("_b.path")).otherwise(resolved),
                r"^((?:.*/)?[^/;]*);$", "$1",
            ).alias("path"),
            F.when(~foreign & same_page & (F.col("_h.query") == ""), F.col("_b.query"))
            .otherwise(F.col("_h.query")).alias("query"),
        ),
    )
    if normalize:
        sch = F.when(F.col("_u.scheme").isin("http", "https"), F.col("_u.scheme")).otherwise(F.lit("https"))
        host, q = F.lower(F.col("_u.netloc")), _clean_query(F.col("_u.query"))
        fragment = F.lit("")
    else:
        sch, host, q = F.col("_u.scheme"), F.col("_u.netloc"), F.col("_u.query")
        fragment = F.when(F.contains(h, F.lit("#")), F.regexp_extract(h, r"(?s)(#.+)$", 1)).otherwise("")
    p = F.col("_u.path")
    rooted = F.when((p != "") & ~F.startswith(p, F.lit("/")), F.concat(F.lit("/"), p)).otherwise(p)
    located = (
        F.when(host != "", F.concat(F.lit("//"), host, rooted))
        .when(F.startswith(p, F.lit("//")), F.concat(F.lit("//"), p))
        .when(sch.isin("http", "https") & ((p == "") | F.startswith(p, F.lit("/"))), F.concat(F.lit("//"), p))
        .otherwise(p)
    )
    url = F.concat(
        F.when(sch == "", "").otherwise(F.concat(sch, F.lit(":"))),
        located,
        F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)),
        fragment,
    )
    if not normalize:
        # A link with a scheme of its own is taken as it stands.
        url = F.when(h == "", b).when((own != "") & (own != bs), h).otherwise(url)
    else:
        url = F.when(h == "", "").otherwise(url)
    return with_computed(df, **{out: url}).drop("_base", "_href", "_b", "_h", "_seg", "_u")


def is_pdf(url: Column, content_type: Column | None = None) -> Column:
    p = F.lower(path(url))
    by_path = F.endswith(p, F.lit(".pdf")) | contains_any(p, ("view.ashx", "viewfile", "documentcenter"))
    if content_type is None:
        return by_path
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("application/pdf")) | by_path


def ingest_route(url: Column) -> Column:
    return F.when(F.contains(F.lower(url), F.lit("pdf")), "pdf").otherwise("html")


def is_allowed_host(url: Column) -> Column:
    """False when the host contains a blocked string, as a substring."""
    return ~contains_any(F.lower(netloc(url)), EXCLUDED_HOSTS)


def classify_document(title: Column, url: Column) -> Column:
    text = F.concat(F.lower(title), F.lit(" "), F.lower(url))
    kind = F.when(F.lit(False), "")
    for name, words in DOCUMENT_TYPES:
        kind = kind.when(contains_any(text, words), name)
    return kind.otherwise("notice")


def classify_basic(title: Column, url: Column) -> Column:
    either = lambda word: F.contains(F.lower(title), F.lit(word)) | F.contains(F.lower(url), F.lit(word))
    return F.when(either("minute"), "meeting_minutes").when(either("ordinance"), "ordinance").otherwise("notice")


def is_statutory(href: Column, text: Column) -> Column:
    pattern = "(?i)" + "|".join(STATUTORY_TERMS)
    return F.concat(href, F.lit(" "), text).rlike(pattern)


def is_unsafe(url: Column) -> Column:
    host = hostname(url)
    private = host.isin("127.0.0.1", "localhost", "169.254.169.254")
    private = private | F.startswith(host, F.lit("192.168.")) | F.startswith(host, F.lit("10."))
    return ~scheme(url).isin("http", "https") | private


def site_label(url: Column) -> Column:
    """Host without 'www.' up to its first dot."""
    return F.regexp_extract(F.replace(netloc(url), F.lit("www."), F.lit("")), r"^([^.]*)", 1)


def infer_adapter(url: Column) -> Column:
    return (
        F.when(F.contains(url, F.lit("municode")), "municode")
        .when(contains_any(url, ("legistar", "granicus")), "granicus")
        .when(F.contains(url, F.lit("civicplus")), "civicplus")
        .otherwise("custom")
    )
