"""Queries of the library proper against their SQL twins on the smallest tables, and the entry point."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from flowlens.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
SAMPLE = "dix_daily fwd_returns contributors_top residual_diff deciles_pooled histogram trailing_decile pooled_decile band_sweep backtest_equity sector_bands alias_join nearest_match asof_session event_table set_ops sector_constituents grid_table backtest_hedged study_full upsert_keep_last bootstrap_ci study_relations study_cuts reaction_anchor sector_crossings event_drift_excess matched_drift_excess band_sweep_excess split_detect backtest_stats welch_p".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rel = duck.sql(catalogue.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_placebo_and_bootstrap_are_repeatable(spark):
    a, b = (catalogue.QUERIES["bootstrap_ci"](spark, SF).collect() for _ in range(2))
    assert a == b
