from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from clausedelta.functions.stems import stem
from clausedelta.operators import changes as ch
from clausedelta.operators import search as se
from clausedelta.operators import stored_search as stored
from clausedelta.plans.search_request import search_request, stored_search_request
from clausedelta.session import work_path
from clausedelta.sources.sinks import batch_ids

OLD, NEW = "§ 1 Parking\nStreet parking is free.\n§ 2 Trees\nKeep.", "§ 1 Parking\nStreet parking costs 100% more_.\n§ 3 Bees\nAllowed."


def tables(spark):
    at = dt.datetime(2024, 1, 1)
    snaps = spark.createDataFrame(
        [("a-1", "a", 1, OLD, at), ("a-2", "a", 2, NEW, at + dt.timedelta(days=1)), ("b-1", "b", 1, "Parking " * 50, at), ("x-1", "x", 1, "parking", at)],
        "id string, document_id string, version int, cleaned_text string, crawled_at timestamp_ntz",
    )
    docs = spark.createDataFrame([("a", "s1", "Doc A", "u/a"), ("b", "gone", "Doc B", "u/b")], "document_id string, source_id string, title string, url string")
    src = spark.createDataFrame([("s1", "Town", "CA")], "id string, name string, state string")
    diffs = ch.snapshot_diffs(snaps).select(F.lit("d a").alias("id"), "*", F.lit(at + dt.timedelta(days=2)).cast("timestamp_ntz").alias("generated_at"))
    return snaps, diffs, docs, src


def test_substring_search(spark):
    snaps, diffs, docs, src = tables(spark)
    ids = lambda q, n=30: [r.id for r in se.search_snapshots(snaps, docs, src, q, n).orderBy(F.desc("crawled_at"), "id").collect()]
    assert ids("PARKING") == ["a-2", "a-1", "b-1"] and ids("parking", 1) == ["a-2"]
    assert ids("100%") == ["a-2"] and ids("%") == ["a-2"] and ids("") == ["a-2", "a-1", "b-1"]
    assert se.search_diffs(diffs, docs, src, "§ 3 bees").count() == 1
    assert se.search_diffs(diffs, docs, src, "identifier").count() == 0


def test_terms(spark):
    snaps, _, docs, src = tables(spark)
    postings = se.term_index(snaps, ["id"], "cleaned_text")
    tf = {(r.id, r.term): r.tf for r in postings.collect()}
    assert tf[("b-1", "parking")] == 50 and tf[("a-1", "parking")] == 2 and ("a-1", "is") not in tf
    hits = lambda q, p=postings, **k: {r.id for r in se.matching_all_terms(p, "id", q, **k).collect()}
    assert hits("the Street parking") == {"a-1", "a-2"} and hits("the of") == set() and hits("parking zebra") == set()
    stems = se.stem_postings(postings)
    assert hits("parked streets", stems, stemmed=True) == {"a-1", "a-2"}
    found = se.search_index(postings, snaps, docs, src, "parking", "crawled_at", limit=2)
    assert {r.id for r in found.collect()} == {"a-2", "a-1"}
    path = work_path(spark, "index")
    se.write_index(postings, path, "id", buckets=4)
    assert spark.read.parquet(path).drop("bucket").exceptAll(postings).count() == 0


def test_stems_of_published_examples():
    pairs = "consign consign consigned consign consigning consign consignment consign consist consist consistency consist knack knack knackeries knackeri kneel kneel knees knee happy happi generously generous ties tie cries cri gas gas hopping hop hoping hope relational relat skies sky dying die national nation"
    words = pairs.split()
    assert {w: stem(w) for w in words[::2]} == dict(zip(words[::2], words[1::2]))


def test_cards_and_gate(spark):
    snaps, diffs, docs, src = tables(spark)
    cards = se.result_cards(se.search_diffs(diffs, docs, src, "parking"), se.search_snapshots(snaps, docs, src, "parking"), scored=True)
    rows = se.ordered_cards(cards).collect()
    assert [r.card_id for r in rows] == ["diff-d-a-§-1-Parking", "add-d-a-§-3-Bees", "del-d-a-§-2-Trees", "snap-a-2", "snap-a-1", "snap-b-1"]
    assert {s.op for s in rows[0].segments} == {"eq", "add", "del"}
    assert [tuple(s) for s in rows[2].segments] == [("del", "§ 2 Trees\nKeep.")]
    assert rows[5].entity == se.UNKNOWN_ENTITY and rows[5].text.endswith("...") and len(rows[5].text) == 243
    closed = search_request(snaps, diffs, docs, src, "parking", False).collect()
    assert [(r.card_id, r.full, r.segments, r.is_locked) for r in se.ordered_cards(search_request(snaps, diffs, docs, src, "parking", False)).collect()] == [
        (rows[0].card_id, se.LOCKED_TEXT, None, True), (rows[1].card_id, se.LOCKED_TEXT, None, True),
    ] and len(closed) == 2
    assert search_request(snaps, diffs, docs, src, "parking", True, "snapshots").count() == 3
    totals = se.search_totals(se.search_diffs(diffs, docs, src, "parking"), se.search_snapshots(snaps, docs, src, "parking")).first()
    assert (totals.total_snapshots, totals.total_diffs) == (3, 1)
    shown = {r.badge: r.shown_text for r in se.diff_display(ch.clause_changes(diffs)).collect()}
    assert shown["Removed"].startswith("§ 2") and shown["Modified"].endswith("more_.")


def search_store(spark, **options):
    snaps, diffs, docs, src = tables(spark)
    store = stored.SearchStore(spark, work_path(spark, "store"), **options)
    store.add(0, snaps.where("version = 1"), diffs.limit(0))
    store.add(1, snaps.where("version = 2"), diffs)
    store.add(1, snaps.where("version = 2"), diffs)  # a repeated batch replaces its rows
    return store, snaps, diffs, docs, src


def test_stored_index_finds_what_the_postings_do(spark, monkeypatch):
    monkeypatch.setattr(stored, "SLICE_ROWS", 2)
    store, snaps, diffs, docs, src = search_store(spark, buckets=4)
    for merged in (False, True):
        if merged:
            store.merge_lists(stored.SNAPSHOTS, 1)
            assert [b for b in batch_ids(spark, f"{store.root}/snapshots_index")] == [1]
        for side, rows in ((stored.SNAPSHOTS, snaps), (stored.DIFFS, se.diff_text(diffs))):
            postings = se.term_index(rows, ["id"], side.text)
            assert sorted(map(tuple, store.postings(side).collect())) == sorted(map(tuple, postings.select("id", "term", "tf").collect()))
            for query in ("the Street parking", "the of", "parking zebra", "bees allowed"):
                want = {r.id for r in se.matching_all_terms(postings, "id", query).collect()}
                assert {r.id for r in store.ids_with_terms(side, query).collect()} == want, query
    shown = store.with_terms(stored.SNAPSHOTS, "parking", docs, src, limit=2).collect()
    assert sorted((r.id, r.source_name, r.cleaned_text) for r in shown) == [("a-1", "Town", OLD), ("a-2", "Town", NEW)]
    assert store.with_terms(stored.DIFFS, "bees", docs, src).first().changes is not None


def test_lists_are_shuffled_once_and_written_where_they_are(spark, monkeypatch):
    taken = []
    write = stored.SearchStore.write_lists
    monkeypatch.setattr(stored.SearchStore, "write_lists", lambda self, side, batch, lists: (taken.append(lists), write(self, side, batch, lists)))
    snaps, *_ = tables(spark)
    odd = snaps.limit(1).select(F.explode(F.array(F.lit("o"), F.lit("o"), F.lit(None))).alias("id"), F.lit("o").alias("document_id"), F.lit(1).alias("version"), F.lit("b the a b Ä 1").alias("cleaned_text"), "crawled_at")
    blank = snaps.limit(2).withColumn("cleaned_text", F.when(F.col("id") == "a-1", F.lit("")))
    store = stored.SearchStore(spark, work_path(spark, "search"), 4)
    store.add(0, snaps.unionByName(odd).unionByName(blank))
    dealt = taken[0].sortWithinPartitions("bucket", "term")
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = sorted((r.term, r.tf) for r in store.postings(stored.SNAPSHOTS).where("id = 'o' or id is null").collect())
    assert found == [("1", 1)] * 3 + [("b", 2)] * 3 + [("ä", 1)] * 3  # equal ids stay two rows, "a" and "the" are stop words


def test_stored_search_reads_named_buckets_and_texts_once(spark):
    store, *_, docs, src = search_store(spark, buckets=64)
    words = dict(store.words("parking bees"))
    plan = store.ids_with_terms(stored.SNAPSHOTS, "parking bees")._jdf.queryExecution().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert set(words) == {"parking", "bees"} and all(str(b) in filters for b in words.values()) and "In(term" in plan.replace(" ", "")
    found = store.containing(stored.SNAPSHOTS, "PARKING", docs, src)
    text_scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Scan parquet" in x and "cleaned_text" in x]
    assert len(text_scans) == 1 and {r.id for r in found.collect()} == {"a-1", "a-2", "b-1"}
    keys = store.newest(stored.SNAPSHOTS, store.keys_with_terms(stored.SNAPSHOTS, "parking"), docs, 30)
    assert "cleaned_text" not in keys._jdf.queryExecution().executedPlan().toString()


def test_stored_requests_equal_plain_ones(spark):
    store, snaps, diffs, docs, src = search_store(spark)
    cases = [("parking", True, "all"), ("100%", False, "all"), ("§ 3", True, "diffs"), ("", True, "snapshots"), ("nothing at all", True, "all")]
    for query, access, kind in cases:
        plain = search_request(snaps, diffs, docs, src, query, access, kind)
        mine = stored_search_request(store, docs, src, query, access, kind)
        assert mine.columns == plain.columns and sorted(map(str, mine.collect())) == sorted(map(str, plain.collect()))
    totals = se.search_totals(se.search_diffs(diffs, docs, src, "parking"), se.search_snapshots(snaps, docs, src, "parking")).first()
    assert store.totals("parking", docs).first() == totals
    assert store.totals("street bees", docs, by_terms=True).first().total_snapshots == 1
