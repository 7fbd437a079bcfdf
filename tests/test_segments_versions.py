from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausedelta.functions.segments import segmented_last, segmented_row_number
from clausedelta.operators import versions as vs
from clausedelta.operators.changes import snapshot_pairs
from clausedelta.plans.ingest import ingest_batch
from clausedelta.session import work_path
from clausedelta.sources.sinks import read_batches
from clausedelta.streaming.ingest import stream_ingest


def skewed(spark):
    """One key holds most rows; some values and one key are null."""
    rnd = random.Random(3)
    keys = ["hot"] * 700 + ["b", "c", None] * 100
    rows = [(k, rnd.randrange(5000), i, rnd.choice([None, "x", "y", "z"])) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "k string, t int, i int, v string")


def test_segmented_functions_equal_plain_windows(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "i")
    seg = F.floor(F.col("t") / 97)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select(
        "i", F.last("v", True).over(up_to).alias("a"), F.last("v", True).over(before).alias("b"), F.row_number().over(w).alias("n")
    )
    out = segmented_last(df, ["k"], ["t", "i"], seg, F.col("v"), "a")
    out = segmented_last(out, ["k"], ["t", "i"], seg, F.col("v"), "b", include_current=False)
    out = segmented_row_number(out, ["k"], ["t", "i"], seg, "n").select("i", "a", "b", "n")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_global_numbering(spark):
    df = spark.range(1000).where("id % 3 = 0")
    out = segmented_row_number(df, [], ["id"], F.floor(F.col("id") / 50), "n")
    assert out.where("n <> id / 3 + 1").count() == 0


def fetches(spark, rows):
    return spark.createDataFrame(rows, "document_id string, fetch_id bigint, day string, body string, url string").withColumn(
        "fetched_at", F.col("day").cast("timestamp_ntz")
    )


A, B = "§ 1 A\none\n§ 2 B\ntwo", "§ 1 A\none\n§ 2 B\nchanged"
ROWS = [
    ("d", 1, "2024-01-01", A, "https://t.gov/d"), ("d", 2, "2024-01-02", A, "https://t.gov/d"), ("d", 3, "2024-01-03", B, "https://t.gov/d"),
    ("d", 4, "2024-01-04", A, "https://t.gov/d"), ("e", 5, "2024-01-01", A, "https://t.gov/e"), ("f", 6, "2024-01-01", "", "https://t.gov/f"),
]


def test_return_to_old_content_is_a_version(spark):
    hashes = vs.hashed(fetches(spark, ROWS))
    out = vs.assign_versions(vs.detect_changes(hashes)).orderBy("fetch_id").collect()
    assert [(r.fetch_id, r.version) for r in out] == [(1, 1), (3, 2), (4, 3), (5, 1), (6, 1)]
    pairs = snapshot_pairs(vs.assign_versions(vs.detect_changes(hashes)), ["fetch_id"]).orderBy("version").collect()
    assert [(r.version, r.old.fetch_id, r.new.fetch_id) for r in pairs] == [(2, 1, 3), (3, 3, 4)]


def test_stored_state_continues(spark):
    hashes = vs.hashed(fetches(spark, [("d", 9, "2024-02-01", A, "u"), ("d", 10, "2024-02-02", B, "u")]))
    latest = vs.hashed(fetches(spark, [ROWS[0]])).select("document_id", "content_hash", F.lit(4).alias("version"))
    out = vs.assign_versions(vs.detect_changes(hashes, latest), latest).collect()
    assert [(r.fetch_id, r.version) for r in out] == [(10, 5)]


def summary(spark, store):
    diffs = spark.read.parquet(f"{store}/diffs").orderBy("document_id", "version").collect()
    return [(r.document_id, r.version, r.summary) for r in diffs]


def test_batches_and_rerun(spark):
    store = work_path(spark, "t")
    df = fetches(spark, ROWS)
    ingest_batch(spark, df.where("fetch_id in (1, 5, 6)"), store, 0)
    ingest_batch(spark, df.where("fetch_id in (2, 3, 4)"), store, 1)
    expected = [("d", 2, "1 clause(s) modified"), ("d", 3, "1 clause(s) modified")]
    assert summary(spark, store) == expected
    ingest_batch(spark, df.where("fetch_id in (2, 3, 4)"), store, 1)
    assert summary(spark, store) == expected
    assert read_batches(spark, f"{store}/snapshots").count() == 4
    assert [(r.document_id, r.reason) for r in read_batches(spark, f"{store}/rejects").collect()] == [("f", "empty body")]


def test_paged_documents_use_their_page_texts(spark):
    store = work_path(spark, "t")
    row = ("p", 1, "2024-01-01", "%PDF", "https://t.gov/p.pdf")
    pages = spark.createDataFrame(
        [("p", 1, i, f"Head {i}\nbody {'ab'[i]} text") for i in range(2)], "document_id string, fetch_id bigint, page_no int, page_text string"
    )
    ingest_batch(spark, fetches(spark, [row, ROWS[0]]), store, 0, pages)
    texts = {r.document_id: r.cleaned_text for r in read_batches(spark, f"{store}/snapshots").collect()}
    assert texts == {"p": "body a text\n\nbody b text", "d": A}


def test_no_fetch_is_lost(spark):
    store = work_path(spark, "t")
    rows = [("p", 1, "2024-01-01", "%PDF", "https://t.gov/p.pdf"), ("q", 2, "2024-01-01", "%PDF", "https://t.gov/q.pdf"), ROWS[0],
            ("h", 7, "2024-01-01", "<p>bad &#9999999; &#xD800; reference</p>", "u"), ("n", 8, "2024-01-01", None, "u")]
    pages = spark.createDataFrame([("p", 1, 1, "page one text")], "document_id string, fetch_id bigint, page_no int, page_text string")
    ingest_batch(spark, fetches(spark, rows), store, 0, pages)
    kept = {r.document_id for r in read_batches(spark, f"{store}/snapshots").collect()}
    aside = {(r.document_id, r.reason) for r in read_batches(spark, f"{store}/rejects").collect()}
    assert kept == {"p", "d", "h"} and aside == {("q", "no page texts"), ("n", "no body")}
    # The page texts arrive: the same fetch becomes version 1.
    late = spark.createDataFrame([("q", 2, 1, "late text")], "document_id string, fetch_id bigint, page_no int, page_text string")
    ingest_batch(spark, fetches(spark, rows[1:2]), store, 1, late)
    got = {r.document_id: (r.version, r.cleaned_text) for r in read_batches(spark, f"{store}/snapshots").collect()}
    assert got["q"] == (1, "late text")
    ingest_batch(spark, fetches(spark, rows[1:2]), f"{store}/other", 0)
    assert [r.reason for r in read_batches(spark, f"{store}/other/rejects").collect()] == ["no page texts"]


def test_stream_equals_batch(spark):
    landing, store = work_path(spark, "landing"), work_path(spark, "t")
    df = fetches(spark, ROWS)
    for part in ("(1, 5, 6)", "(2, 3)", "(4)"):
        df.where(f"fetch_id in {part}").coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(df.schema).parquet(landing)
        stream_ingest(stream, store, f"{store}/_check").awaitTermination(120)
    assert summary(spark, store) == [("d", 2, "1 clause(s) modified"), ("d", 3, "1 clause(s) modified")]


def test_register_and_status(spark):
    links = spark.createDataFrame([("s", "u", "b", "notice", 2), ("s", "u", "a", "bylaw", 1), ("s", "v", "c", "notice", 1)], "source_id string, url string, title string, document_type string, seen_at int")
    new = vs.register_documents(links, links.where("url = 'v'")).collect()
    assert [(r.url, r.title, r.document_type, r.created_at) for r in new] == [("u", "a", "bylaw", 1)]
    hashes = vs.hashed(fetches(spark, ROWS[:3]))
    row = vs.document_status(hashes, vs.assign_versions(vs.detect_changes(hashes))).first()
    assert (str(row.last_crawled_at), str(row.last_changed_at), row.versions) == ("2024-01-03 00:00:00", "2024-01-03 00:00:00", 2)


def files_of(df):
    return {f.rsplit("batch_id=", 1)[1].split("/")[0] for f in df.inputFiles()}


def test_history_is_neither_read_nor_written_again(spark, monkeypatch):
    """Three batches: the third reads the folder that holds the previous version, and no file of the first two changes."""
    import glob
    import os

    from clausedelta.plans import ingest

    store = work_path(spark, "t")
    url = "https://t.gov/d"
    batches = [
        [("a", 1, "2024-01-01", A, url), ("b", 2, "2024-01-01", A, url), ("c", 3, "2024-01-01", A, url)],
        [("a", 4, "2024-01-02", B, url), ("b", 5, "2024-01-02", A, url)],
        [("a", 6, "2024-01-03", A, url), ("b", 7, "2024-01-03", A, url)],
    ]
    read = []
    plain = ingest.previous_texts
    monkeypatch.setattr(ingest, "previous_texts", lambda *a: read.append(plain(*a)) or read[-1])
    state = lambda: {f: (os.stat(f).st_mtime_ns, os.stat(f).st_size) for f in glob.glob(f"{store}/**/*.parquet", recursive=True)}
    for i, rows in enumerate(batches):
        before = {f: x for f, x in state().items() if "/waiting/" not in f}
        ingest_batch(spark, fetches(spark, rows), store, i)
        assert before.items() <= state().items()
    stored = [p for p in (r.inputFiles() for r in read) if p]
    assert len(stored) == 2 and all("batch_id=0" in f for f in stored[0] if "/snapshots/" in f)
    assert {f.split("batch_id=")[1][0] for f in stored[1] if "/snapshots/" in f} == {"1"}
    assert [x[:2] for x in summary(spark, store)] == [("a", 2), ("a", 3)]
    latest = {r.document_id: (r.version, r.in_batch) for r in ingest.latest_state(spark, store).read(3, fetches(spark, sum(batches, []))).collect()}
    assert latest == {"a": (3, 2), "b": (1, 0), "c": (1, 0)}


def test_state_folds_generations(spark, monkeypatch):
    """A part with many generations is folded; a batch that is run again gives the same; folders no manifest names go."""
    import glob

    from clausedelta.sources import state as st

    monkeypatch.setattr(st, "MOST_GENERATIONS", 3)
    path = work_path(spark, "state")
    state = st.KeyedState(spark, path, "k string, v int, x string", "k", "v", parts=2)
    want = {}
    for i in range(9):
        rows = [(f"k{j}", i, f"x{i}") for j in range(i, i + 5)]
        want |= {r[0]: r[1:] for r in rows}
        for _ in range(2):
            state.write(i, spark.createDataFrame(rows, "k string, v int, x string"))
        before = state.read(i, spark.createDataFrame(rows, "k string, v int, x string"))
        assert {(r.k, r.v) for r in before.collect()} == {(f"k{j}", i - 1) for j in range(i, i + 4) if i}
    keys = spark.createDataFrame([(k,) for k in [*want, "none"]], "k string")
    assert {r.k: (r.v, r.x) for r in state.read(9, keys).collect()} == want
    assert len(state.places(8)) <= 2 * 3 and len(glob.glob(f"{path}/rows/*/part=0")) < 9


PAGE = "document_id string, fetch_id bigint, page_no int, page_text string, page_count int"


def test_late_pages_meet_their_waiting_fetch_in_the_stream(spark):
    """Two stream inputs: a fetch waits for its last page, pages wait for their fetch, nothing is handed in again."""
    landing, texts, store = work_path(spark, "landing"), work_path(spark, "texts"), work_path(spark, "t")
    late = [("p", 1, "2024-01-01", "%PDF", "https://t.gov/p.pdf"), ("q", 2, "2024-01-01", "%PDF", "https://t.gov/q.pdf")]
    steps = [
        ([late[0], ROWS[0]], [("p", 1, 1, "page one", 2), ("q", 2, 1, "early page", 1)]),
        ([ROWS[2]], [("x", 9, 1, "no fetch yet", None)]),
        ([late[1]], [("p", 1, 2, "page two", 2), ("p", 1, 1, "page one", 2)]),
        ([("p", 3, "2024-02-01", "%PDF2", "https://t.gov/p.pdf")], [("p", 3, 1, "page one changed", None)]),
    ]
    seen = []
    for rows, pages in steps:
        df, page = fetches(spark, rows), spark.createDataFrame(pages, PAGE)
        df.coalesce(1).write.mode("append").parquet(landing)
        page.coalesce(1).write.mode("append").parquet(texts)
        streams = (spark.readStream.schema(x.schema).parquet(p) for x, p in ((df, landing), (page, texts)))
        first, second = streams
        stream_ingest(first, store, f"{store}/_check", second).awaitTermination(180)
        seen.append({(r.document_id, r.version) for r in read_batches(spark, f"{store}/snapshots").collect()})
    assert seen == [{("d", 1)}, {("d", 1), ("d", 2)}, {("d", 1), ("d", 2), ("p", 1), ("q", 1)}, {("d", 1), ("d", 2), ("p", 1), ("p", 2), ("q", 1)}]
    got = {(r.document_id, r.version): r.cleaned_text for r in read_batches(spark, f"{store}/snapshots").collect()}
    assert got["p", 1] == "page one\n\npage two" and got["q", 1] == "early page" and got["p", 2] == "page one changed"
    newest = max(r.batch_id for r in read_batches(spark, f"{store}/pages").select("batch_id").distinct().collect())
    left = read_batches(spark, f"{store}/pages").where(F.col("batch_id") == newest).collect()
    assert [r.document_id for r in left] == ["x"]
    assert [(r.document_id, r.reason) for r in read_batches(spark, f"{store}/rejects").orderBy("document_id").collect()] == [("p", "no page texts")]


def test_table_streams_of_either_layout(spark):
    import glob
    import shutil

    from clausedelta.streaming.ingest import table_stream

    root = work_path(spark, "layout")
    df = spark.range(100).selectExpr("id", "cast(id as string) as s")
    df.repartition(4).write.parquet(f"{root}/folder.parquet")
    df.coalesce(1).write.parquet(f"{root}/one")
    shutil.copy(glob.glob(f"{root}/one/part-*.parquet")[0], f"{root}/single.parquet")
    shutil.copy(f"{root}/single.parquet", f"{root}/a-single.parquet")  # a neighbour with a like name
    for name in ("folder", "single"):
        stream = table_stream(spark, f"{root}/{name}.parquet", df.schema, maxFilesPerTrigger="1")
        out = f"{root}/out-{name}"
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-check").trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.parquet(out).orderBy("id").collect() == df.collect()


def test_crawl_runs_keep_one_catalogue_and_count_what_they_made(spark):
    from clausedelta.plans.crawl_run import crawl_run

    store = work_path(spark, "run")
    site = "id string, name string, base_url string, adapter_type string, link_selector string, is_active boolean"
    link = "source_id string, url string, title string, document_type string, seen_at timestamp_ntz"
    line = "run_id string, source_id string, source_name string, success boolean, error string, documents bigint, started_at timestamp_ntz, ended_at timestamp_ntz"
    day = ["2024-01-01", "2024-01-03"]
    sites = [[("s1", "Town", "https://t.gov", "custom", None, True)], [("other", "Town 2", "https://t.gov", "custom", None, True), ("s2", "City", "https://c.gov", "custom", None, True)]]
    seen = [["https://t.gov/d", "https://t.gov/e"], ["https://t.gov/d", "https://t.gov/new"]]
    logs = [[("0", "s1", "Town", True, None, 2)], [("1", "s1", "Town 2", True, None, 2), ("1", "s2", "City", False, "timeout", 0)]]
    rows = [[ROWS[0], ROWS[4]], [ROWS[2], ("n", 9, "2024-01-03", A, "https://t.gov/new")]]

    def run(i):
        at = F.lit(day[i]).cast("timestamp_ntz")
        links = spark.createDataFrame([("s1", u, "t", "notice") for u in seen[i]], link.rsplit(",", 1)[0]).withColumn("seen_at", at)
        log = spark.createDataFrame(logs[i], line.rsplit(",", 2)[0]).withColumn("started_at", at).withColumn("ended_at", at)
        return crawl_run(spark, store, i, spark.createDataFrame(sites[i], site), links, fetches(spark, rows[i]), log).first()

    first, second, again = run(0), run(1), run(1)
    assert (first.status, first.documents_registered, first.diffs_created, first.documents_found) == ("completed", 2, 0, 2)
    assert (second.status, second.documents_registered, second.diffs_created, second.sources_failed) == ("partial_failure", 1, 1, 1) and again == second
    stored = {r.base_url: (r.id, r.name) for r in spark.read.parquet(f"{store}/sources/batch_id=1").collect()}
    assert stored == {"https://t.gov": ("s1", "Town 2"), "https://c.gov": ("s2", "City")}
    assert sorted(r.url for r in read_batches(spark, f"{store}/documents").collect()) == ["https://t.gov/d", "https://t.gov/e", "https://t.gov/new"]
    assert [(r.source_name, r.error) for r in read_batches(spark, f"{store}/run_failures").collect()] == [("City", "timeout")]
