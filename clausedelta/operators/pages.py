"""Paged documents: running headers, joined text and low-density pages.

Input rows: document_id, page_no, page_text, image_count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.stages import let, with_computed
from clausedelta.functions.text import PAGE_BREAK, clean_text, comparable_lines, split_lines, strip


def repeated_lines(pages: DataFrame) -> DataFrame:
    """Lines that recur on at least max(2, 60 %) of a document's pages.

    Counted per (document, line), so a document with very many pages is spread
    by its lines. Equal lines of one page count once, dropped within the row.
    """
    lines = F.array_distinct(comparable_lines(F.col("page_text")))
    usable = F.filter(lines, lambda v: (F.length(v) > 3) & (F.length(v) < 140))
    counts = (
        pages.select("document_id", F.explode_outer(usable).alias("line")).where("line is not null")
        .groupBy("document_id", "line")
        .agg(F.count("*").alias("pages_with_line"))
        .where("pages_with_line >= 2")
    )
    totals = pages.groupBy("document_id").agg(F.count("*").alias("total_pages")).where("total_pages > 1")
    enough = F.greatest(F.lit(2), F.floor(F.col("total_pages") * F.lit(6) / F.lit(10)))
    return counts.join(totals, "document_id").where(F.col("pages_with_line") >= enough)


def clean_pages(pages: DataFrame, phrases: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Each page without its document's repeated lines, cleaned; empty pages drop.

    A document has at most (mean lines per page / 0.6) repeated lines, whatever
    its number of pages, so the list per document is small.
    """
    repeated = repeated_lines(pages).groupBy("document_id").agg(F.collect_set("line").alias("_repeated"))
    df = pages.join(repeated, "document_id", "left")
    recurs = lambda v: F.coalesce(F.array_contains(F.col("_repeated"), v), F.lit(False))
    kept = let(comparable_lines(F.col("page_text")), lambda lines: F.filter(
        split_lines(F.col("page_text")), lambda _, i: ~recurs(F.get(lines, i))
    ))
    # Pages of one-page documents are cleaned as they are.
    body = F.when(F.col("_repeated").isNull(), F.col("page_text")).otherwise(F.array_join(kept, "\n"))
    cleaned = clean_text(body, F.col(phrases) if phrases else None)
    df = with_computed(df, cleaned_page=cleaned).drop("_repeated")
    return df if keep_empty else df.where("cleaned_page <> ''")


def clean_multipage(pages: DataFrame, phrases: str | None = None) -> DataFrame:
    """Cleaned text per document, pages in order; documents left empty give ''."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", "cleaned_page")))
    texts = F.filter(F.transform(ordered, lambda p: p["cleaned_page"]), lambda t: t != "")
    return clean_pages(pages, phrases, keep_empty=True).groupBy("document_id").agg(
        F.array_join(texts, "\n\n").alias("cleaned_text"), F.count("*").alias("page_count")
    )


def raw_text(pages: DataFrame) -> DataFrame:
    """Trimmed pages of a document joined by the page break mark."""
    ordered = F.sort_array(F.collect_list(F.struct("page_no", strip(F.col("page_text")).alias("t"))))
    return pages.groupBy("document_id").agg(
        F.array_join(F.transform(ordered, lambda p: p["t"]), PAGE_BREAK).alias("raw_text"),
        F.count("*").alias("page_count"),
    )


def low_density(pages: DataFrame) -> DataFrame:
    """Pages with so little text that they should go through recognition."""
    n = F.length(strip(F.col("page_text")))
    sparse = (n < 40) & ((F.col("image_count") > 0) | (n == 0))
    return pages.select("document_id", "page_no", n.alias("text_length"), "image_count", sparse.alias("needs_ocr"))


def ocr_documents(pages: DataFrame) -> DataFrame:
    flags = low_density(pages)
    return flags.groupBy("document_id").agg(
        F.bool_or("needs_ocr").alias("needs_ocr"), F.count_if("needs_ocr").alias("low_density_pages")
    )
