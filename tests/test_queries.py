"""Registered queries of the engine against DuckDB over the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from tracework.plans import catalog

SF = "/root/testdata/sf0.001"
SOME = ["b_assessment", "m8_metric_rows", "t6_ladder_relabel", "o2_sorted_sink", "p1_enabled_times", "f3_split_into_subsets", "f4_snapshot_subsets", "c2_wip3", "c5_n_ongoing", "a7_utilisation", "d4_n_gram_3", "d7_circadian_workforce", "m7_all_state_distances", "b1_b6_scores", "t5_drift_case_types", "t11_front_back_load", "l5_l6_by_activity", "r5_rankings", "p8_repaired_state", "p11_enabled_gateways", "x1_fractional_seconds", "s1_read_event_log", "t6_m8_drift", "l11_kmeans_groups", "s7_read_model", "o2_time_range", "b9_interpretation"]


def plain(v):
    if v is None or v != v:
        return "-"
    return f"{float(v):.5f}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    a = sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect())
    b = sorted(tuple(plain(v) for _, v in sorted(zip(names, row, strict=True))) for row in want.fetchall())
    assert a == b


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and os.path.exists("__spark_entry__.py")
