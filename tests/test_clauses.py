from __future__ import annotations

import difflib
from collections import Counter


from clausedelta.operators import changes as ch
from clausedelta.workload import views

SECTIONS = (
    "WHEREAS the town meets\n§ 12-4. Solar panels\nPanels are allowed.\nSection 5: Fences\nTwo metres.\n"
    "ARTICLE IV - Signs\nNo signs.\nChap. 3 Trees\nKeep trees.\nDiv. 2\nParks.\nPart II – Roads\nRoads.\nparticular text"
)
REST = "Intro line\n\nSecond paragraph\nmore\n \n\nThird"


def snaps(spark, *texts, doc="a"):
    return spark.createDataFrame([(doc, v + 1, t) for v, t in enumerate(texts)], "document_id string, version int, cleaned_text string")


def pairs(spark, *rows):
    data = [(str(i), v, t) for i, r in enumerate(rows) for v, t in ((1, r[0]), (2, r[1]))]
    return spark.createDataFrame(data, "document_id string, version int, cleaned_text string")


def test_sections(spark):
    rows = ch.split_clauses(snaps(spark, SECTIONS)).orderBy("pos").collect()
    assert {r.strategy for r in rows} == {"section"}
    assert [(r.section_number, r.title) for r in rows] == [
        ("0", "Preamble"), ("§ 12-4.", "Solar panels"), ("5", "Fences"), ("IV", "Signs"), ("3", "Trees"), ("2", None), ("II", "Roads"),
    ]
    assert rows[0].identifier == "Preamble & Enacting Clause"
    assert rows[1].text == "§ 12-4. Solar panels\nPanels are allowed."
    assert [(r.line_start, r.line_end) for r in rows[:2]] == [(1, 1), (2, 3)]
    assert rows[-1].text.endswith("particular text") and rows[-1].line_end == 14


def test_a_word_after_article_is_a_number(spark):
    rows = ch.split_sections(snaps(spark, "Article Committee\nx\nSection one\ny")).orderBy("pos").collect()
    assert [(r.identifier, r.section_number) for r in rows] == [("Article Committee", "Committee")]


def test_paragraph_fallback_and_blank(spark):
    rows = ch.split_clauses(snaps(spark, REST)).orderBy("pos").collect()
    assert [(r.identifier, r.title, r.text) for r in rows] == [
        ("Paragraph 1", "Intro line", "Intro line"), ("Paragraph 2", "Second paragraph", "Second paragraph\nmore"),
        ("Paragraph 3", "Third", "Third"),
    ]
    assert ch.split_clauses(snaps(spark, " \n ", None)).count() == 0


def test_last_content_first_position(spark):
    rows = ch.unique_clauses(snaps(spark, "§ 1 A\nold\n§ 2 B\nx\n§  1: a\nnew")).orderBy("ord").collect()
    assert [(r.key, r.ord, r.text) for r in rows] == [("§ 1 a", 0, "§  1: a\nnew"), ("§ 2 b", 1, "§ 2 B\nx")]


def test_changes_of_a_pair(spark):
    old = "§ 1 A\none\n§ 2 B\ntwo\n§ 3 C\nthree"
    new = "§ 1 A\none\n§ 4 D\nfour\n§ 3 C\nthree changed"
    rows = ch.clause_changes(ch.snapshot_diffs(snaps(spark, old, new))).orderBy("ord").collect()
    assert [(r.change_type, r.clause_key) for r in rows] == [("removed", "§ 2 b"), ("modified", "§ 3 c"), ("added", "§ 4 d")]
    payload = ch.diff_payload(ch.snapshot_diffs(snaps(spark, old, new, new))).orderBy("version").collect()
    assert payload[0].summary == "1 clause(s) added, 1 clause(s) removed, 1 clause(s) modified"
    assert payload[1].summary == "No statutory changes detected"


def test_mixed_strategies_never_match(spark):
    row = ch.diff_payload(ch.snapshot_diffs(snaps(spark, REST, "§ 1 A\na\n§ 2 B\nb"))).first()
    assert (row.strategy_used, row.total_added, row.total_removed, row.total_modified) == ("section", 2, 3, 0)


def test_swapping_sides_swaps_added_and_removed(spark):
    texts = [SECTIONS, REST, SECTIONS.replace("Two metres.", "Three metres."), "§ 1 A\na\n§ 2 B\nb", ""]
    combos = [(a, b) for a in texts for b in texts]
    forward = {r.document_id: r for r in ch.diff_payload(ch.snapshot_diffs(pairs(spark, *combos))).collect()}
    back = {r.document_id: r for r in ch.diff_payload(ch.snapshot_diffs(pairs(spark, *[(b, a) for a, b in combos]))).collect()}
    for k, (a, b) in enumerate(combos):
        f, g = forward[str(k)], back[str(k)]
        assert (f.total_added, f.total_removed, f.total_modified) == (g.total_removed, g.total_added, g.total_modified)
        if a == b:
            assert f.total_added + f.total_removed + f.total_modified == 0


def test_scores_equal_difflib(spark):
    long = " ".join(f"word{i} of clause" for i in range(60))
    combos = [("§ 1 A\n" + a + "\n§ 2 B\nsame", "§ 1 A\n" + b + "\n§ 2 B\nsame") for a, b in (("one two three", "one 2 three"), (long, long + " end"), ("a\nb", "b"))]
    rows = ch.score_changes(ch.clause_changes(ch.snapshot_diffs(pairs(spark, *combos)))).collect()
    assert len(rows) == 3
    for r in rows:
        assert r.similarity_score == round(difflib.SequenceMatcher(None, r.old_text, r.new_text).ratio(), 3)
        side = lambda keep: " ".join(d.text for d in r.word_deltas if d.op in keep).split()
        assert side(("equal", "delete")) == r.old_text.split()
        assert side(("equal", "insert")) == r.new_text.split()
    loose = ch.score_changes(ch.clause_changes(ch.snapshot_diffs(pairs(spark, combos[1]))), autojunk=False).first()
    assert loose.similarity_score > 0.9


def test_known_totals(spark):
    df = ch.clause_changes(ch.snapshot_diffs(views.snapshots(spark, "/root/testdata/sf0.01", mixed=False)))
    counts = Counter({r.change_type: r["count"] for r in df.groupBy("change_type").count().collect()})
    assert counts == {"added": 480, "removed": 309, "modified": 2294}


def test_unchanged_rows_do_not_reach_python(spark):
    scored = ch.score_changes(ch.clause_changes(ch.snapshot_diffs(snaps(spark, SECTIONS, REST))))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "CartesianProduct" not in plan
    assert all(r.similarity_score == 0.0 and not r.word_deltas for r in scored.collect())


def test_pairs_need_one_shuffle(spark):
    plan = ch.snapshot_diffs(snaps(spark, SECTIONS, REST))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan


def test_key_column(spark):
    df = spark.createDataFrame([("  § 1_2 –  A: b. ",)], "identifier string")
    assert ch.keyed(df).first().clause_key == "§ 1 2 a b"
