from __future__ import annotations

import re

from pyspark.sql import functions as F

from clausedelta.functions import text as tx


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


ODD = [
    "", "a", "a\n", "a\n\n", "a\r\nb\rc", "x\x0by\x0cz\x1cq\x1dr\x1es\x85t u v", "\r\n\r\n", "\n", "  a  ",
    "tab\tin", "a\x1fb\n",
]


def test_split_lines_equals_python(spark):
    assert values(spark, ODD, tx.split_lines) == [t.splitlines() for t in ODD]


def test_strip_equals_python(spark):
    assert values(spark, ODD, tx.strip) == [t.strip() for t in ODD]


def test_clean_text(spark):
    raw = (
        "Page 1 of 4\nZONING BYLAW\n\n\n\nThe ordi-\nnance takes effect — ‘now’.\n - 2 -\n"
        "This document is provided for informational purposes only. Ask us.\nDraft – Subject to Approval 2024\nlast line  "
    )
    assert values(spark, [raw, ""], tx.clean_text) == [
        "ZONING BYLAW\n\nThe ordinance takes effect  -  'now'.\n\nlast line", "",
    ]


def test_boilerplate_keeps_ordinary_lines(spark):
    kept = "Page of history\nAll rights are reserved to nobody\nSection 3 / 4 rule"
    assert values(spark, [kept], tx.clean_text) == [kept]


def test_source_phrases_are_literal(spark):
    phrases = F.array(F.lit("(c) Town."), F.lit("a.b"))
    out = values(spark, ["x (C) TOWN. y axb A.B z"], lambda t: tx.clean_text(t, phrases))
    assert out == ["x  y axb  z"]
    quoted = values(spark, [r"keep \E gone"], lambda t: tx.strip_phrases(t, F.array(F.lit(r"\E gone"))))
    assert quoted == ["keep "]


def test_collapse_equals_line_rule(spark):
    texts = ["a\n \n\t\n b \n\n\n\nc\n", "  \n\n x", "a\x0cb\r\n\r\n\r\nc"]

    def rule(t):
        out, gap = [], False
        for line in (x.strip() for x in t.splitlines()):
            if line or not gap:
                out.append(line)
            gap = not line
        return "\n".join(out).strip()

    assert values(spark, texts, tx.collapse_blank_lines) == [rule(t) for t in texts]


def test_comparable_line(spark):
    lines = ["  Minutes - Page 12 ", "minutes -  page 7", "Total 1,250"]
    expected = [re.sub(r"\s+", " ", re.sub(r"\d+", "#", x.strip().lower())) for x in lines]
    assert values(spark, lines, tx.comparable_line) == expected
    assert expected[0] == expected[1]


def test_comparable_lines_equal_those_of_each_line(spark):
    texts = [*ODD, "ΟΔΟΣ\nΑΣ β  x\u00a0\u2003y\nPage ٣ of 12 ", " a  b\tc \r\n12/34\u3000", "İ I\x85ΣΑΣ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = F.transform(tx.split_lines(F.col("t")), tx.comparable_line)
    for r in df.select(one.alias("a"), tx.comparable_lines(F.col("t")).alias("b"), "t").collect():
        assert r.a == r.b, r.t


def test_long_texts_are_split_and_searched_once(spark):
    """Each repeat is a pass over the text: lines are cut once, marks are looked for before a pattern runs."""
    assert str(tx.split_lines(F.col("t"))).count("split(") == 1
    cleaned = str(tx.clean_text(F.col("t")))
    assert "translate(" not in cleaned and cleaned.count("regexp_replace(") <= cleaned.count("contains(")
    marked = ["PAGE 3\nx", "x\n 3 / 4 \ny", "- 7 -", "draft - subject to APPROVAL z\nq", "crown  copyright", "Crown Copyright 2020 w", "re-\nopen - \n x", "a—b – c\u00a0‘d’"]
    want = ["x", "x\n\ny", "", "q", "crown  copyright", "", "reopen -\nx", "a - b  -  c 'd'"]
    assert values(spark, marked, tx.clean_text) == want


def test_reduction(spark):
    df = spark.createDataFrame([(200, 133), (0, 0), (3, 2)], "a int, b int")
    assert [r[0] for r in df.select(tx.reduction_pct(F.col("a"), F.col("b"))).collect()] == [33.5, 0.0, 33.3]
