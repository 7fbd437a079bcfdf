from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from clausedelta.operators import billing as bl
from clausedelta.operators import health as hl
from clausedelta.session import work_path
from clausedelta.sources import catalogue as cat
from clausedelta.sources import sinks
from clausedelta.streaming import ingest as st
from clausedelta.workload.views import plans

ACT, CAN, SALE = "BILLING.SUBSCRIPTION.ACTIVATED", "BILLING.SUBSCRIPTION.CANCELLED", "PAYMENT.SALE.COMPLETED"


def delivery(n, kind, resource, event_id="auto", result="processed"):
    payload = json.dumps({"id": f"E{n}" if event_id == "auto" else event_id, "event_type": kind, "resource": resource})
    return (n, dt.datetime(2024, 1, 1) + dt.timedelta(days=n), payload, result, None if result == "processed" else "bad signature")


ROWS = [
    delivery(1, ACT, {"id": "S1", "plan_id": "P-MONTH", "subscriber": {"email_address": "A@x.org", "name": {"given_name": "Ann", "surname": "Lee"}}, "billing_info": {"next_billing_time": "2024-03-01T00:00:00Z"}}),
    delivery(2, CAN, {"id": "S1"}),
    delivery(3, ACT, {"id": "S2", "plan_id": "P-ANNUAL", "subscriber": {"email_address": "b@x.org", "business_name": "Firm"}}),
    delivery(4, SALE, {"id": "SALE-1", "billing_agreement_id": "S2", "amount": {"value": "39.00", "currency_code": "USD"}}),
    delivery(5, SALE, {"id": "SALE-2", "billing_agreement_id": "S3", "amount": {"total": "x"}}),
    delivery(6, ACT, {"id": "S4", "plan_id": "P-OLD"}),
    delivery(7, "OTHER", {"id": "S4"}),
    delivery(8, ACT, {"id": "S5", "plan_id": "P-MONTH"}, event_id="E3", result="rejected"),
    delivery(9, ACT, {"id": "S6", "plan_id": "P-MONTH"}, event_id=None), delivery(10, ACT, {"id": "S6", "plan_id": "P-MONTH"}, event_id=None),
]
SCHEMA = "delivery_id bigint, received_at timestamp_ntz, payload string, result string, error_detail string"


def raw(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def folded(spark, rows=ROWS):
    return bl.fold_subscriptions(bl.default_next_billing(bl.normalize_events(raw(spark, rows))))


def test_events(spark):
    rows = {r.delivery_id: r for r in bl.normalize_events(raw(spark)).collect()}
    assert [rows[i].status for i in (1, 2, 4, 7)] == ["active", "cancelled", "active", "unknown"]
    assert (rows[1].subscriber_name, rows[3].subscriber_name, rows[2].subscriber_name) == ("Ann Lee", "Firm", None)
    assert (rows[4].subscription_id, float(rows[4].amount), rows[4].currency, rows[5].amount) == ("S2", 39.0, "USD", None)
    strict = bl.normalize_events(raw(spark), own_id_first=True).where("delivery_id = 4").first()
    assert strict.subscription_id == "SALE-1"


def test_redelivery_keeps_first_data_and_last_outcome(spark):
    rows = {r.delivery_id: r for r in bl.dedupe_events(bl.normalize_events(raw(spark))).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7, 9, 10]
    assert (rows[3].subscription_id, rows[3].result, rows[3].error_detail) == ("S2", "rejected", "bad signature")


def test_fold_does_not_depend_on_arrival_order(spark):
    shuffled = ROWS[:]
    random.Random(1).shuffle(shuffled)
    a, b = (sorted(map(tuple, folded(spark, r).collect())) for r in (ROWS, shuffled))
    assert a == b
    state = {r.subscription_id: r for r in folded(spark).collect()}
    assert (state["S1"].status, state["S1"].email, state["S1"].plan_id, str(state["S1"].next_billing_at)) == ("cancelled", "A@x.org", "P-MONTH", "2024-03-01 00:00:00")
    assert str(state["S2"].next_billing_at) == "2024-02-04 00:00:00"  # the later sale, + 30 days
    assert state["S4"].status == "unknown"


def test_streams_equal_batch(spark):
    landing, out, dedup = work_path(spark, "in"), work_path(spark, "out"), work_path(spark, "dd")
    for part in (ROWS[6:], ROWS[:3], ROWS[3:6]):  # late events come last
        raw(spark, part).coalesce(1).write.mode("append").parquet(landing)
        stream = lambda: spark.readStream.schema(raw(spark).schema).parquet(landing)
        st.stream_subscriptions(stream(), out, f"{out}-c").awaitTermination(120)
        st.stream_deduped_events(stream(), dedup, f"{dedup}-c", "30 days").awaitTermination(120)
    batch = sorted(map(tuple, folded(spark).select(*sorted(folded(spark).columns)).collect()), key=str)
    live = st.current_subscriptions(spark, out)
    assert sorted(map(tuple, live.select(*sorted(live.columns)).collect()), key=str) == batch
    assert spark.read.parquet(dedup).groupBy("event_id").count().where("event_id is not null and count > 1").count() == 0
    assert spark.read.parquet(dedup).count() == 9


def test_outcomes_follow_every_delivery_within_the_watermark(spark):
    """Repeats in any order over many batches: the view is the batch operator's rows, column by column, and each batch
    shows what it changed; state of a key goes once the watermark has passed it."""
    at = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
    body = lambda i, plan: '{"id":%s,"event_type":"BILLING.SUBSCRIPTION.ACTIVATED","resource":{"id":"S","plan_id":"%s","amount":{"total":"9.90"}}}' % (i, plan)
    batches = [
        [(2, at(1, 2), body('"a"', "later"), "failed", "db down"), (3, at(1, 3), body('"b"', "x"), "processed", None), (9, at(1), body("null", "n"), "processed", None)],
        [(1, at(1, 1), body('"a"', "first"), "failed", "too early"), (4, at(1, 4), body('"a"', "x"), "processed", None)],
        [(5, at(1, 9), body('"b"', "x"), "rejected", "seen"), (10, at(1, 1), body("null", "n"), "processed", None), (6, at(1, 5), body('"c"', "x"), "processed", None)],
        [(7, at(20), body('"d"', "x"), "processed", None)],
        [(8, at(20, 1), body('"d"', "x"), "failed", "again"), (11, at(20, 2), body('"a"', "new"), "processed", None), (12, at(2), body('"c"', "x"), "failed", "far too late")],
    ]
    columns = "delivery_id bigint, received_at timestamp_ntz, payload string, result string, error_detail string"
    landing, path = work_path(spark, "in"), work_path(spark, "outcomes")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(columns).parquet(landing)
        st.stream_event_outcomes(stream, path, f"{path}-c", "3 days", every=2).awaitTermination(120)
        if i < 4:
            want = bl.dedupe_events(bl.normalize_events(spark.createDataFrame(sum(batches[: i + 1], []), columns)))
            mine = st.current_outcomes(spark, path)
            assert sorted(mine.columns) == sorted(want.columns)
            order = sorted(want.columns)
            assert sorted(map(str, mine.select(*order).collect())) == sorted(map(str, want.select(*order).collect()))
    last = {(r.event_id, r.delivery_id): (r.result, r.error_detail, r.deliveries) for r in st.current_outcomes(spark, path).collect()}
    assert last["d", 7] == ("failed", "again", 2) and last["c", 6] == ("processed", None, 1)
    assert last["a", 11] == ("processed", None, 1)  # its state had gone: the id counts as new


def test_outcomes_keep_no_state_per_event(spark):
    """A batch is an aggregate and costs its own rows; one that is run again replaces what it added."""
    columns = "delivery_id bigint, received_at timestamp_ntz, payload string, result string, error_detail string"
    rows = [(i, dt.datetime(2024, 1, 1, i % 20), '{"id":"e%d","event_type":"x"}' % (i % 7), f"r{i}", None) for i in range(40)]
    rows.append((40, None, '{"event_type":"x"}', "no time", None))
    landing, path = work_path(spark, "in"), work_path(spark, "outcomes")
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(landing)
    query = st.stream_event_outcomes(spark.readStream.schema(columns).parquet(landing), path, f"{path}-c", "3 days")
    query.awaitTermination(120)
    assert not any(p["stateOperators"] for p in query.recentProgress)
    again = st.stream_event_outcomes(spark.readStream.schema(columns).parquet(landing), path, f"{path}-c2", "3 days")
    again.awaitTermination(120)  # another checkpoint: the same batch number
    want = bl.dedupe_events(bl.normalize_events(spark.createDataFrame(rows, columns)))
    mine = st.current_outcomes(spark, path).select(*want.columns)
    assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect()))


def test_changelog_reads_keys_not_batches(spark):
    path = work_path(spark, "log")
    log, want = sinks.Changelog(spark, path, "k", every=3), {}
    for i in range(11):
        rows = [(f"k{(i + j) % 6}", i * 10 + j) for j in range(2)]
        want |= dict(rows)
        for _ in range(2):  # a batch that is run again, also one that wrote a base
            log.append(spark.createDataFrame(rows, "k string, v int"), i)
        assert {r.k: r.v for r in log.current().collect()} == want
    folders = [len(sinks.batch_ids(spark, f"{path}/{t}")) for t in ("base", "changes")]
    assert folders[0] <= 2 and folders[1] <= 6 and len(log.current().inputFiles()) < 20


def test_revenue_and_plans(spark):
    subs, price = folded(spark), plans(spark)
    row = bl.revenue(subs, price).first()
    assert (row.mrr, row.arr) == (39.0 + 49.0 * 2, (39.0 + 49.0 * 2) * 12)
    assert {r.id: r.subscribers for r in bl.plan_counts(subs, price).collect()} == {"monthly": 2, "annual": 1}
    listed = {r.subscription_id: (r.name, r.plan_name) for r in bl.subscriber_list(subs, price).collect()}
    assert listed["S1"] == ("Ann Lee", "Standard") and listed["S4"] == ("Unknown subscriber", "Unrecognised plan")
    empty = bl.revenue(subs.where("false"), price).first()
    assert (empty.mrr, empty.arr) == (0.0, 0.0)
    b = bl.subscriber_buckets(subs).first()
    assert (b.total, b.active, b.cancelled) == (6, 4, 1)


def test_payload_cut(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":"' + "x" * 20_000 + '"}',), ("nope",)], "p string")
    assert [r[0] for r in df.select(bl.stored_payload(F.col("p"), 20_000)).collect()] == ['{"a":1}', "{}", "{}"]
    assert [len(r[0]) for r in df.select(bl.stored_payload(F.col("p"))).collect()] == [7, 20_008, 2]


def test_times_do_not_depend_on_the_session(spark):
    texts = ["2024-02-01T00:00:00Z", "2024-02-01", "2024-02-01T02:30:00+02:30", "2024-03-10T02:30:00.250Z", "junk", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    users = [("U-7", "A@b.c", True, True, "2024-03-11T00:00:00Z"), ("u-8", "x@y.z", True, True, None)]
    people = spark.createDataFrame(users, "id string, email string, is_active boolean, is_verified boolean, trial_ends_at string")
    subs = spark.createDataFrame(
        [("S1", "P", "x@y.z", "active")], "subscription_id string, plan_id string, email string, status string"
    ).selectExpr("*", "timestamp_ntz'2024-03-08 00:00:00' next_billing_at", "timestamp_ntz'2024-01-01 00:00:00' updated_at")
    asked = spark.createDataFrame([("U-7",), (" a@B.c",), ("u-7",), ("u-8",)], "user_ref string")
    seen = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        times = [str(r[0]) for r in df.select(bl.utc_time(F.col("t"))).collect()]
        rows = [tuple(r) for r in bl.access_status(asked, people, subs, "2024-03-10 00:00:00").orderBy("user_ref").collect()]
        seen.append((times, rows))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1]
    assert seen[0][0] == ["2024-02-01 00:00:00", "2024-02-01 00:00:00", "2024-02-01 00:00:00", "2024-03-10 02:30:00.250000", "None", "None"]
    assert [(r[0], r[2], r[4]) for r in seen[0][1]] == [
        (" a@B.c", "trial", 1), ("U-7", "trial", 1), ("u-7", "user_not_found", None), ("u-8", "active_subscription", None),
    ]


def test_event_log_limit(spark):
    with pytest.raises(ValueError, match="limit"):
        bl.event_log(spark.range(1), 0)


def test_access(spark):
    users = spark.createDataFrame([
        ("1", "t@x.org", True, True, "2024-01-11T06:00:00+00:00"), ("2", "a@x.org", True, True, "2024-01-01"), ("3", "b@x.org", True, True, "junk"),
        ("4", "off@x.org", False, True, None), ("5", "new@x.org", True, False, None), ("6", "late@x.org", None, True, None),
    ], "id string, email string, is_active boolean, is_verified boolean, trial_ends_at string")
    subs = spark.createDataFrame([
        ("S1", "P", "cancelled", "a@x.org", dt.datetime(2024, 9, 1), dt.datetime(2024, 1, 1)), ("S2", "P", "active", "B@X.org", None, dt.datetime(2024, 1, 1)),
        ("S3", "P", "active", "late@x.org", dt.datetime(2024, 1, 7, 23, 59, 59), dt.datetime(2024, 1, 1)),
    ], "subscription_id string, plan_id string, status string, email string, next_billing_at timestamp_ntz, updated_at timestamp_ntz")
    asked = spark.createDataFrame([(v,) for v in (None, "", "who", " T@x.org ", "2", "b@x.org", "4", "5", "6")], "user_ref string")
    out = {r.user_ref: (r.reason, r.has_access, r.trial_days_remaining) for r in bl.access_status(asked, users, subs, "2024-01-10 00:00:00").collect()}
    assert out == {
        None: ("unauthenticated", False, None), "": ("unauthenticated", False, None), "who": ("user_not_found", False, None),
        " T@x.org ": ("trial", True, 2), "2": ("trial_expired", False, None), "b@x.org": ("active_subscription", True, None),
        "4": ("account_disabled", False, None), "5": ("unverified", False, None), "6": ("trial_expired", False, None),
    }
    grace = bl.access_status(asked.where("user_ref = '6'"), users, subs, "2024-01-09 23:59:59").first()
    assert grace.reason == "active_subscription"


def test_trial_activation(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    schema = "user_id bigint, at timestamp_ntz, event_id bigint, code string"
    issues = spark.createDataFrame([(1, at(0), 1, "111"), (1, at(20), 2, "222"), (2, at(0), 3, "333")], schema)
    attempts = spark.createDataFrame([
        (1, at(16), 10, "111"), (1, at(21), 11, "111"), (1, at(22), 12, " 222 "), (1, at(23), 13, "222"), (2, at(15), 14, "333"), (3, at(1), 15, "x"), (4, at(1), 16, "x"),
    ], schema)
    users = spark.createDataFrame([(1, False), (2, False), (4, True)], "user_id bigint, is_verified boolean")
    out = {r.event_id: r for r in bl.trial_activation(attempts, issues, users).collect()}
    assert {k: r.outcome for k, r in out.items()} == {
        10: "code_expired", 11: "invalid_code", 12: "verified", 13: "already_verified", 14: "verified", 15: "user_not_found", 16: "already_verified",
    }
    assert out[12].trial_ends_at - out[12].trial_started_at == dt.timedelta(days=14)


def log(spark, rows):
    t = dt.datetime(2024, 1, 1)
    data = [(run, s, f"Source {s}", ok, err, n, t, t + dt.timedelta(seconds=3)) for run, s, ok, err, n in rows]
    return spark.createDataFrame(data, "run_id string, source_id bigint, source_name string, success boolean, error string, documents bigint, started_at timestamp_ntz, ended_at timestamp_ntz")


def test_runs_and_report(spark):
    rows = [("a", i, False, "e" * 200, 0) for i in range(60)] + [("a", 100, True, None, 7), ("b", 1, True, None, 2), ("c", 1, False, None, 9)]
    results = hl.source_results(log(spark, rows))
    runs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", None), ("e", "x")], "run_id string, finished_at string")
    summary = {r.run_id: (r.status, r.sources_failed, r.documents_found) for r in hl.run_summary(results, runs).collect()}
    assert summary == {"a": ("partial_failure", 60, 7), "b": ("completed", 0, 2), "c": ("failed", 1, 0), "d": ("running", 0, 0), "e": ("completed", 0, 0)}
    report = {r.run_id: r for r in hl.run_report(results, hl.run_summary(results)).collect()}
    assert report["a"].subject == "60 of 61 sources failed" and len(report["a"].failures) == 25 and report["a"].more == 35
    assert all(len(f.error) == 160 for f in report["a"].failures)
    assert report["b"].subject == "daily crawl clean (1 sources)" and not report["b"].send and report["c"].failures[0].error == "Unknown failure"


def test_report_takes_top_rows_before_the_shuffle(spark):
    results = hl.source_results(log(spark, [("a", 1, False, "e", 0)]))
    plan = hl.run_report(results, hl.run_summary(results))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_catalogue(spark, tmp_path):
    src = [{"id": "site-01-a", "name": "A", "base_url": "https://a.gov", "adapter_type": "ATOM", "is_active": True, "selectors_config": {"date_tag": "updated"}}]
    (tmp_path / "s.json").write_text(json.dumps(src))
    (tmp_path / "s.yaml").write_text("sources:\n- id: y\n  base_url: https://y.gov\n  adapter_type: nope\n  is_active: false\n")
    (tmp_path / "bad.json").write_text("{oops")
    df = cat.load_catalogue(spark, str(tmp_path / "s.json"))
    assert df.select("id", "selectors_config.date_tag").first() == ("site-01-a", "updated")
    yml = cat.load_catalogue(spark, str(tmp_path / "none.json"), str(tmp_path / "s.yaml"))
    assert yml.first().base_url == "https://y.gov"
    assert cat.load_catalogue(spark, str(tmp_path / "bad.json")).count() == 0
    assert [r.record for r in cat.catalogue_rejects(spark, str(tmp_path / "bad.json")).collect()] == ["{oops"]
    (tmp_path / "odd.json").write_text('[{"id": "a", "is_active": "perhaps"}, {"id": "b", "is_active": true}]')
    assert {"a", "b"} == {r.id for r in cat.load_catalogue(spark, str(tmp_path / "odd.json")).collect()}
    assert all("perhaps" in r.record for r in cat.catalogue_rejects(spark, str(tmp_path / "odd.json")).collect())
    assert cat.load_catalogue(spark, str(tmp_path / "none.json")).count() == 0
    both = df.unionByName(yml)
    assert {r[0] for r in both.select(cat.adapter_for(F.col("adapter_type"))).collect()} == {"xml_feed", "custom"}
    checks = {(r.check, r.source_id, r.detail) for r in hl.catalogue_checks(both.unionByName(df)).collect()}
    assert checks == {("missing_field", "y", "name"), ("unknown_adapter", "y", "nope"), ("inactive_without_reason", "y", "health_status"),
                      ("duplicate_id", "site-01-a", "site-01-a"), ("duplicate_url", "site-01-a", "https://a.gov")}
    lines = spark.createDataFrame([(1, "1. https://www.Legistar-x.gov/a/"), (2, "note"), (3, " 12. http://municode.com")], "line_no bigint, line string")
    made = cat.sources_from_links(lines).orderBy("id").collect()
    assert [(r.id, r.name, r.base_url, r.adapter_type) for r in made] == [
        ("site-01-Legistar-x", "Legistar-x Statutory Monitor", "https://www.Legistar-x.gov/a", "custom"),
        ("site-02-municode", "Municode Statutory Monitor", "http://municode.com", "municode"),
    ]
