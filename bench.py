"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from clausedelta.session import local_session
from clausedelta.workload.queries import REGISTERED

HEADLINE = (
    "q17_normalize_url", "q24_discover_documents", "q30_html_to_lines", "q36_clean_text", "q37_repeated_lines",
    "q38_clean_multipage", "q44_split_clauses", "q49_clause_changes", "q50_diff_payload",
    "q55_assign_versions", "q60_ingest_batch", "q61_search_snapshots_substring", "q63_term_index",
    "q66_search_all_terms", "q75_dedupe_events", "q78_fold_subscriptions", "q84_access_status",
    "q85_trial_activation", "q91_run_summary", "q96_audit_summary", "q100_overview", "q103_subscription_state_stream",
)


def split_tables(spark, sf_dir: str, parts: int) -> str:
    """The tables in as many files as there are cores, as large tables come; the given ones are one row group each.

    Not timed. The queries read them as they are: nothing in the library deals small scans out anew.
    """
    out = tempfile.mkdtemp(prefix="bench-")
    for name in sorted({n.split(".")[0] for n in os.listdir(sf_dir) if n.endswith(".parquet")}):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (rows.repartition(parts) if name in ("documents", "pages") else rows).write.parquet(f"{out}/{name}.parquet")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    given, sf_dir = sf_dir, split_tables(spark, sf_dir, spark.sparkContext.defaultParallelism)
    REGISTERED["q07_page_landing_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, failed = {}, {}
    for name in HEADLINE:
        if only and only not in name:
            continue
        start = time.time()
        try:
            REGISTERED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # noqa: BLE001
            failed[name] = str(exc)[:300]
            continue
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(given.rstrip("/")), **({"failed": failed} if failed else {}),
    }))
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
