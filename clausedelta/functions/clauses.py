"""Clause splitting and matching inside one row.

A text is one cell, so its clauses are cut with array functions in the same
task: no explode, no window and no shuffle before the clauses exist.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.stages import let, with_computed
from clausedelta.functions.text import LINE_BREAK, SPACE, strip

# Words that open a numbered section.
_NUMBER_TAIL = r"[A-Za-z0-9._/\-]*"
_HEADER = (
    r"^WS*+(?:(?=§)"
    r"|(?i:section|sec\.|division|div\.)WS*(?=\p{Nd})"
    r"|(?i:article|art\.|chapter|chap\.)WS*(?=[IVXLCDMivxlcdm\p{Nd}])"
    r"|(?:Part|PART)WS*(?=[IVXLCDM\p{Nd}]))"
    r"(§+WS*\p{Nd}TAIL|[A-Za-z\p{Nd}]TAIL)"
    r"(?:WS*[:.\-–—]?WS*(.*))?$"
).replace("WS", SPACE).replace("TAIL", _NUMBER_TAIL)

PREAMBLE = "Preamble & Enacting Clause"

CLAUSE = (
    "struct<identifier:string,section_number:string,title:string,"
    "text:string,line_start:int,line_end:int>"
)


def header_number(line: Column) -> Column:
    """Section number of a header line, '' for any other line; white space around it does not count."""
    return F.regexp_extract(line, _HEADER, 1)


def header_title(line: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(line, _HEADER, 2)), F.lit(""))


def clause_key(identifier: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(identifier)), rf"(?:{SPACE}|[:.\-_–—])+", " "))


def _sections() -> Column:
    """Sections from the columns _lines and _marks (start line, header, number)."""
    lines, marks = F.col("_lines"), F.col("_marks")

    def section(mark: Column, k: Column) -> Column:
        end = F.coalesce(F.get(marks, k + 1)["at"], F.size(lines))
        text = strip(F.array_join(F.slice(lines, mark["at"] + 1, end - mark["at"]), "\n"))
        preamble = mark["number"] == ""
        return F.struct(
            F.when(preamble, PREAMBLE).otherwise(mark["head"]).alias("identifier"),
            F.when(preamble, "0").otherwise(mark["number"]).alias("section_number"),
            F.when(preamble, "Preamble").otherwise(header_title(mark["head"])).alias("title"),
            text.alias("text"),
            (mark["at"] + 1).cast("int").alias("line_start"),
            end.cast("int").alias("line_end"),
        )

    return F.filter(F.transform(marks, section), lambda c: c["text"] != "")


def with_sections(df: DataFrame, text: str, out: str = "sections") -> DataFrame:
    """Add the array of numbered sections; text before the first one is the preamble."""
    # A trimmed text ends in no line break, so a plain split gives its lines.
    df = with_computed(df, _lines=F.split(strip(F.coalesce(F.col(text), F.lit(""))), LINE_BREAK, -1))
    probe = F.transform(F.col("_lines"), lambda line, i: F.struct(i.alias("at"), header_number(line).alias("number")))
    # The first line always opens a unit: a header or the preamble.
    marks = F.filter(probe, lambda m, i: (m["number"] != "") | (i == 0))
    # Stripping is slow, so only headers are stripped.
    headed = F.transform(
        marks, lambda m: F.struct(m["at"].alias("at"), strip(F.get(F.col("_lines"), m["at"])).alias("head"), m["number"].alias("number"))
    )
    df = with_computed(df, _marks=headed)
    return with_computed(df, **{out: _sections().cast(f"array<{CLAUSE}>")}).drop("_lines", "_marks")


def with_paragraphs(df: DataFrame, text: str, out: str = "paragraphs") -> DataFrame:
    """Add the array of blank-line separated paragraphs, numbered from 1."""
    body = strip(F.coalesce(F.col(text), F.lit("")))

    def paragraph(content: Column, i: Column) -> Column:
        first = strip(F.regexp_extract(content, r"^[^\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]*", 0))
        number = (i + 1).cast("string")
        return F.struct(
            F.concat(F.lit("Paragraph "), number).alias("identifier"),
            number.alias("section_number"),
            let(first, lambda f: F.when(F.length(f) < 60, f)).alias("title"),
            content.alias("text"),
            F.lit(None).cast("int").alias("line_start"),
            F.lit(None).cast("int").alias("line_end"),
        )

    parts = F.transform(F.transform(F.split(body, rf"\n{SPACE}*\n+", -1), strip), paragraph)
    kept = F.filter(parts, lambda c: c["text"] != "").cast(f"array<{CLAUSE}>")
    return with_computed(df, **{out: kept})


def with_clauses(df: DataFrame, text: str, out: str = "clauses", strategy: str = "strategy") -> DataFrame:
    """Sections when there are at least two of them, else paragraphs."""
    df = with_sections(df, text, "_sec")
    by_section = F.size("_sec") >= 2
    # Only texts without sections are cut into paragraphs.
    df = df.withColumn("_rest", F.when(~by_section, F.col(text)))
    df = with_paragraphs(df, "_rest", "_par")
    return with_computed(df, **{
        strategy: F.when(by_section, "section").otherwise("paragraph"),
        out: F.when(by_section, F.col("_sec")).otherwise(F.col("_par")),
    }).drop("_sec", "_par", "_rest")


def with_unique_clauses(df: DataFrame, clauses: str, out: str = "unique_clauses") -> DataFrame:
    """Of clauses with the same key keep the last content at the first position.

    Sorting (key, position) pairs makes equal keys neighbours, so the first and
    last of each run are found in O(n log n) without leaving the row.
    """
    pairs = F.sort_array(
        F.transform(
            F.col(clauses), lambda c, i: F.struct(clause_key(c["identifier"]).alias("key"), i.alias("pos"))
        )
    )
    df = with_computed(df, _pairs=pairs)
    all_pairs = F.col("_pairs")
    firsts = F.filter(
        all_pairs, lambda x, i: (i == 0) | (F.get(all_pairs, i - 1)["key"] != x["key"])
    )
    lasts = F.filter(
        all_pairs,
        lambda x, i: (i == F.size(all_pairs) - 1) | (F.get(all_pairs, i + 1)["key"] != x["key"]),
    )
    df = with_computed(df, _first=firsts, _last=lasts)
    unique = F.transform(
        F.col("_first"),
        lambda f, j: F.struct(
            f["key"].alias("key"),
            f["pos"].alias("ord"),
            F.get(F.col(clauses), F.get(F.col("_last"), j)["pos"]).alias("clause"),
        ),
    )
    return with_computed(df, **{out: unique}).drop("_pairs", "_first", "_last")


def with_clause_diff(df: DataFrame, old: str, new: str, out: str = "changes") -> DataFrame:
    """Match two arrays of unique clauses by key and keep what changed.

    A full outer match on the key within the row: both sides are sorted into
    one array by (key, side), where a matched pair is two neighbours.
    """
    side = lambda col, tag: F.transform(
        F.col(col),
        lambda u: F.struct(
            u["key"].alias("key"),
            F.lit(tag).alias("side"),
            u["ord"].alias("ord"),
            u["clause"]["identifier"].alias("identifier"),
            u["clause"]["section_number"].alias("section_number"),
            u["clause"]["text"].alias("text"),
        ),
    )
    df = with_computed(df, _all=F.sort_array(F.concat(side(old, 0), side(new, 1))))
    every = F.col("_all")

    def change(x: Column, i: Column) -> Column:
        after, before = F.get(every, i + 1), F.get(every, i - 1)
        paired = (x["side"] == 0) & (after["key"] == x["key"])
        paired = F.coalesce(paired, F.lit(False))
        second = (x["side"] == 1) & (i > 0) & F.coalesce(before["key"] == x["key"], F.lit(False))
        kind = (
            F.when(second, F.lit(None))
            .when(paired, F.when(x["text"] != after["text"], "modified"))
            .when(x["side"] == 0, "removed")
            .otherwise("added")
        )
        return F.struct(
            # Keys of the old side come first, in their own order.
            x["side"].alias("side"),
            x["ord"].alias("ord"),
            kind.alias("change_type"),
            x["key"].alias("clause_key"),
            F.when(paired, after["identifier"]).otherwise(x["identifier"]).alias("identifier"),
            F.when(paired, after["section_number"]).otherwise(x["section_number"]).alias("section_number"),
            F.when(x["side"] == 0, x["text"]).alias("old_text"),
            F.when(paired, after["text"]).when(x["side"] == 1, x["text"]).alias("new_text"),
        )

    changed = F.filter(F.transform(every, change), lambda c: c["change_type"].isNotNull())
    return with_computed(df, **{out: F.sort_array(changed)}).drop("_all")
