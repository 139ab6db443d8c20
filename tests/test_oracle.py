"""Registered queries against their DuckDB oracles on the smallest driver tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from veridata.plans.views import TABLES

SF = "/root/testdata/sf0.001"
KEYS = ["profile", "eda_nulls", "eda_corr", "eda_describe_text", "clean_default", "clean_log",
        "quality_factors", "throttle_batch", "throttle_classes", "doc_summary", "doc_entities",
        "url_public", "scan_csv", "scan_json", "page_tables", "sql_grouping_sets", "chart_hist",
        "eval_classes", "candidate_keys"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr(list(v))
    return v


def _canon(names, rs):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return ([names[i] for i in order],
            sorted((tuple(_norm(r[i]) for i in order) for r in rs), key=repr))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    cur = con.execute(E.oracle_sql()[key])
    a = _canon(df.columns, [tuple(r) for r in df.collect()])
    b = _canon([d[0] for d in cur.description], cur.fetchall())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() == 11 and "median" in out.columns
