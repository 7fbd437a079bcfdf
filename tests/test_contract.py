from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check import TABLES, plain

SF = "/root/testdata/sf0.001"
CHECKED = (
    "q02_link_list_to_sources", "q17_normalize_url", "q30_html_to_lines", "q38_clean_multipage", "q49_clause_changes",
    "q55_assign_versions", "q75_dedupe_events", "q93_run_report",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_names():
    queries, sql = ({n: q for n, q in x.items() if n.startswith("q")} for x in (entry.queries(), entry.oracle_sql()))
    assert set(sql) <= set(queries)
    assert set(queries) == set(sql)
    # Difflib scores and word stems are per-row Python and therefore no queries of their own.
    assert {int(n[1:].split("_")[0]) for n in queries} == set(range(1, 104)) - {45, 46, 64}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["document_id", "version", "total_added", "total_removed", "total_modified", "summary"]
    assert df.count() == 200


def test_every_sql_runs(duck):
    for name, sql in entry.oracle_sql().items():
        assert duck.sql(sql).columns, name


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, duck, name):
    df, rel = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(rel.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())
    assert mine and mine == theirs
