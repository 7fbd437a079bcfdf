"""Search over snapshots and diffs, and the shape of its results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.stages import exploded, with_computed
from clausedelta.functions.stems import stem_column
from clausedelta.functions.text import non_blank
from clausedelta.operators.changes import diff_summary, score_changes

DEFAULT_LIMIT = 30
TEASER_CARDS = 2
PREVIEW_CHARS = 240
UNKNOWN_ENTITY = "Municipal Regulatory Authority"
LOCKED_TEXT = (
    "The text and its changes are shown to readers with access. "
    "A trial or a subscription opens them."
)

# English words too common to index.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to",
    "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then",
    "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few",
    "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)


def tokens(text: Column) -> Column:
    """Lowercase words of a text, stop words removed."""
    return F.filter(_words(text), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}\p{Nd}]+")


def term_index(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    """Postings: one row per term of a row, with its number of occurrences.

    Counted inside the row by sorting its words, so building the index needs
    no shuffle and a very common term gathers nowhere.
    """
    df = with_computed(rows.select(*key, text), _t=F.sort_array(_words(F.col(text))))
    words = F.col("_t")
    n = F.size(words)
    # Where the run of each word ends; one step per word. Stop words leave once per row, after the counting.
    ends = F.filter(F.sequence(F.lit(1), n), lambda e: (e == n) | (F.get(words, e) != F.get(words, e - 1)))
    df = with_computed(df, _e=F.when(n > 0, ends))
    counted = F.transform(
        F.col("_e"),
        lambda e, j: F.struct(F.get(words, e - 1).alias("term"), (e - F.coalesce(F.get(F.col("_e"), j - 1), F.lit(0))).alias("tf")),
    )
    postings = df.select(*key, F.inline_outer(counted))
    return postings.where(F.col("term").isNotNull() & (F.col("term") != "") & ~F.col("term").isin(*STOP_WORDS))


def write_index(postings: DataFrame, path: str, key: str, buckets: int = 64, spread: int = 4) -> None:
    """Store postings by term bucket; a hot term's rows go to ``spread`` files."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")
    salt = F.pmod(F.xxhash64(key), F.lit(spread)).cast("int")
    (
        postings.withColumn("bucket", bucket).repartition(buckets * spread, "bucket", salt)
        .sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    )


def stem_postings(postings: DataFrame) -> DataFrame:
    """Postings by stem. Stems are computed once per distinct term."""
    vocabulary = postings.select("term").distinct()
    stems = vocabulary.select("term", stem_column(F.col("term")).alias("stem"))
    keys = [c for c in postings.columns if c not in ("term", "tf")]
    return postings.join(stems, "term").groupBy(*keys, "stem").agg(F.sum("tf").alias("tf"))


def term_stems(postings: DataFrame) -> DataFrame:
    return postings.select("term").distinct().select("term", stem_column(F.col("term")).alias("stem"))


def matching_all_terms(postings: DataFrame, key: str, query: str, stemmed: bool = False) -> DataFrame:
    """Keys in which every term of the query occurs; no terms, no rows."""
    spark = postings.sparkSession
    wanted = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t"))
    column = "term"
    if stemmed:
        # Distinct stems of the few words of one query.
        column = "stem"
        words = wanted.select(F.explode("t").alias("w")).select(stem_column(F.col("w")).alias("w")).distinct()
        wanted = words.agg(F.collect_set("w").alias("t"))
    terms = wanted.select(F.explode("t").alias(column), F.size("t").alias("_wanted"))
    # One query's terms: at most the words a user typed.
    hits = postings.join(F.broadcast(terms), column)
    return (
        # A term occurs once per key in the postings, so rows are terms.
        hits.groupBy(key).agg(F.count("*").alias("_n"), F.max("_wanted").alias("_wanted"))
        .where("_n = _wanted").select(key)
    )


def _located(
    keys: DataFrame, rows: DataFrame, documents: DataFrame, sources: DataFrame, at: str, limit: int
) -> DataFrame:
    """The newest ``limit`` of the found keys (id, document_id, time), with their
    documents, sources and whole rows.

    Only keys take part in the join and the top-k; texts are fetched for the
    rows that are shown.
    """
    docs = documents.select("document_id", F.col("title").alias("doc_title"), F.col("url").alias("doc_url"), "source_id")
    src = sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("state").alias("source_state")
    )
    newest = keys.join(docs, "document_id").orderBy(F.desc(at), "id").limit(limit)
    shown = newest.join(src, "source_id", "left")
    return rows.drop("document_id", at).join(shown, "id")


def search_snapshots(
    snapshots: DataFrame, documents: DataFrame, sources: DataFrame, query: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Newest snapshots whose text contains the query, ignoring case."""
    wanted = F.lower(F.trim(F.lit(query)))
    found = snapshots.where(F.contains(F.lower("cleaned_text"), wanted)).select("id", "document_id", "crawled_at")
    return _located(found, snapshots, documents, sources, "crawled_at", limit)


def diff_text(diffs: DataFrame) -> DataFrame:
    """Add ``diff_text``: summary, identifiers and clause texts of a diff."""
    words = F.flatten(F.transform(F.col("changes"), lambda c: F.array(c["identifier"], c["old_text"], c["new_text"])))
    count = lambda kind: F.size(F.filter(F.col("changes"), lambda c: c["change_type"] == kind))
    text = F.concat_ws("\n", diff_summary(count("added"), count("removed"), count("modified")), F.array_join(words, "\n"))
    return diffs.withColumn("diff_text", text)


def search_diffs(
    diffs: DataFrame, documents: DataFrame, sources: DataFrame, query: str, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Newest diffs whose summary or clause texts contain the query."""
    wanted = F.lower(F.trim(F.lit(query)))
    found = diff_text(diffs).where(F.contains(F.lower("diff_text"), wanted)).select("id", "document_id", "generated_at")
    return _located(found, diffs, documents, sources, "generated_at", limit)


def search_index(
    postings: DataFrame, rows: DataFrame, documents: DataFrame, sources: DataFrame, query: str, at: str,
    limit: int = DEFAULT_LIMIT, stemmed: bool = False,
) -> DataFrame:
    """Newest rows in which every query term occurs; ``rows`` has an id column."""
    ids = matching_all_terms(postings, "id", query, stemmed)
    found = rows.select("id", "document_id", at).join(ids, "id", "left_semi")
    return _located(found, rows, documents, sources, at, limit)


def preview(text: Column, length: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def _card_id(prefix: Column, id_: Column, section: Column | None = None) -> Column:
    parts = [prefix, F.lit("-"), id_.cast("string")]
    if section is not None:
        parts += [F.lit("-"), section]
    return F.replace(F.concat(*parts), F.lit(" "), F.lit("-"))


def result_cards(diffs: DataFrame, snapshots: DataFrame, scored: bool = False) -> DataFrame:
    """Cards of found diffs and snapshots, with what ordered_cards sorts by.

    With ``scored`` the segments of modified clauses are their word changes, compared for the clauses of the
    found diffs; otherwise the whole new text.
    Order: diffs newest first, in each modified, added, removed; then snapshots.
    """
    c = (
        exploded(diffs, "changes", "_pos", "c", ["id", "generated_at", "doc_title", "doc_url", "source_name"])
        .select("*", "c.change_type", "c.identifier", "c.section_number", "c.old_text", "c.new_text").drop("c")
    )
    none = F.lit(None).cast("array<struct<op:string,text:string>>")
    c = score_changes(c) if scored else c.withColumn("word_deltas", none)
    kind = F.col("change_type")
    section = F.coalesce(non_blank(F.col("identifier")), non_blank(F.col("section_number")), F.lit("Section"))
    shown = F.coalesce(F.when(kind == "removed", F.col("old_text")).otherwise(F.col("new_text")), F.lit(""))
    op = lambda word: F.when(word == "insert", "add").when(word == "delete", "del").otherwise("eq")
    deltas = F.transform("word_deltas", lambda d: F.struct(op(d["op"]).alias("op"), d["text"].alias("text")))
    mark = F.when(kind == "added", "add").when(kind == "removed", "del").otherwise("eq")
    whole = F.array(F.struct(mark.alias("op"), shown.alias("text")))
    prefix = F.when(kind == "added", "add").when(kind == "removed", "del").otherwise("diff")
    rank = F.when(kind == "modified", 0).when(kind == "added", 1).otherwise(2)
    entity = F.coalesce(non_blank(F.col("source_name")), F.lit(UNKNOWN_ENTITY))
    segments = "array<struct<op:string,text:string>>"
    from_diffs = c.select(
        _card_id(prefix, F.col("id"), section).alias("card_id"),
        F.lit("diff").alias("type"), entity.alias("entity"), F.col("doc_title").alias("doc"), section.alias("section"),
        F.when((kind == "modified") & (F.size("word_deltas") > 0), deltas).otherwise(whole).cast(segments).alias("segments"),
        F.lit(None).cast("string").alias("text"), shown.alias("full"), F.col("doc_url").alias("url"),
        F.col("generated_at").alias("ts"), F.lit(0).alias("_part"), F.col("id").alias("_id"),
        rank.alias("_kind_ord"), "_pos",
    )
    from_snapshots = snapshots.select(
        _card_id(F.lit("snap"), F.col("id")).alias("card_id"),
        F.lit("snapshot").alias("type"), entity.alias("entity"), F.col("doc_title").alias("doc"),
        F.concat(F.lit("Snapshot v"), F.col("version").cast("string")).alias("section"),
        F.lit(None).cast(segments).alias("segments"),
        preview(F.col("cleaned_text")).alias("text"), F.col("cleaned_text").alias("full"), F.col("doc_url").alias("url"),
        F.col("crawled_at").alias("ts"), F.lit(1).alias("_part"), F.col("id").alias("_id"),
        F.lit(0).alias("_kind_ord"), F.lit(0).alias("_pos"),
    )
    return from_diffs.unionByName(from_snapshots)


def ordered_cards(cards: DataFrame) -> DataFrame:
    return cards.orderBy("_part", F.desc("ts"), "_id", "_kind_ord", "_pos")


def filter_by_type(cards: DataFrame, kind: str = "all") -> DataFrame:
    """``all``, ``diffs`` or ``snapshots``."""
    if kind == "all":
        return cards
    return cards.where(F.col("type") == {"diffs": "diff", "snapshots": "snapshot"}[kind])


def search_totals(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row: snapshots and diffs found."""
    tagged = snapshots.select(F.lit(1).alias("s"), F.lit(0).alias("d")).unionAll(diffs.select(F.lit(0), F.lit(1)))
    return tagged.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("total_snapshots"), F.coalesce(F.sum("d"), F.lit(0)).alias("total_diffs")
    )


def gate_results(cards: DataFrame, has_access: bool | Column) -> DataFrame:
    """All cards with access; else the first two with their full text locked.

    ``has_access`` may be a scalar subquery over the access decision. Locked
    cards carry no segments either.
    """
    opened = cards.withColumn("is_locked", F.lit(False))
    teaser = ordered_cards(cards).limit(TEASER_CARDS)
    locked = teaser.withColumns({
        "full": F.lit(LOCKED_TEXT),
        "is_locked": F.lit(True),
        "segments": F.lit(None).cast("array<struct<op:string,text:string>>"),
    })
    if isinstance(has_access, bool):
        return opened if has_access else locked
    return opened.where(has_access).unionByName(locked.where(~has_access))


def diff_display(changes: DataFrame) -> DataFrame:
    """Badge, identifier and shown text of changed clauses."""
    kind = F.col("change_type")
    badge = F.when(kind == "added", "Added").when(kind == "removed", "Removed").otherwise("Modified")
    shown = F.when(kind == "removed", F.col("old_text")).otherwise(F.col("new_text"))
    return changes.select(
        "document_id", "version", "ord", badge.alias("badge"), "identifier", F.coalesce(shown, F.lit("")).alias("shown_text")
    )
