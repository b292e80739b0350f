"""Registered queries against their DuckDB twins on the smallest tables."""
import math

import duckdb
import pytest

from conftest import SF
import __spark_entry__ as entry
from flowlens.sources.tables import TABLES

FAST = ["f2_sessionize", "f12_first_syn", "c26_firewall_flows", "a2_dedupe_flows", "m1_stratified_split",
        "j3_enrich_ips", "m3_risk_scoring", "p1_normalize_records", "d6_feature_drift", "d6_state_quantiles"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, df.collect()) == _rows(dcols, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0


def test_every_query_has_an_oracle_or_is_known():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
