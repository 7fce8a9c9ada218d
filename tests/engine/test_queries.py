import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(plain(v) for v in value) if isinstance(value, (list, tuple)) else value


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.LLM_QUERIES])
def test_query_against_sql(spark, oracle, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((plain(tuple(r[c] for c in columns)) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = oracle.sql(sql)
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    assert rows == sorted((plain(tuple(r[i] for i in place)) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_scan_once_and_push_down(spark):
    plan = lambda name: entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan("facet_multi").count("FileScan") == 1 and plan("field_drilldown").count("FileScan") == 1
    assert "TakeOrderedAndProject" in plan("page_slice") and "EqualTo(lang,fr)" in plan("search_exact")
    assert "WindowGroupLimit" in plan("facet_terms")
