"""Every registered query over the smallest tables; those with SQL against DuckDB."""

import duckdb
import pytest

from shoal.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def value(v):
    if v is None or v != v:
        return None
    return v if isinstance(v, (str, bool)) else round(float(v), 5) + 0.0


@pytest.mark.parametrize("name", ["account_scores", "burst_candidates", "hour_histogram", "reciprocity", "connected_components_core", "roles", "engagement_summary", "country_resolve_free", "creation_bursts", "follower_map_bands", "behavior_signals", "engagement_signals", "neighborhood_signals", "candidate_ranking", "list_overlap"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda rows, names: sorted(str([value(r[names.index(c)]) for c in cols]) for r in rows)
    assert key([tuple(r) for r in got.collect()], got.columns) == key(want.fetchall(), want.columns)


def test_names():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
