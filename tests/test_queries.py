"""Every registered query against its SQL twin on DuckDB over the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from lodeloom import registry

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "date": "DATE"}


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def compare(name, spark, sf, duck):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == expected


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_matches_sql(name, spark, sf, duck):
    compare(name, spark, sf, duck)


#: Joins by distance, whose order among near-equal distances shows on larger tables only.
SPATIAL = ("jn2_places_in_radius", "jn3_same_place", "jn8_task_pairs", "jn21_known_location", "win3_nearest_candidate", "top7_hero", "biz1_proximity", "agg17_bundle_anchors", "agg18_bundle_sets", "biz2_errand_bundles", "top2_bundle_rank")


@pytest.mark.parametrize("name", SPATIAL)
def test_spatial_joins_match_on_larger_tables(name, spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in ("customer", "part", "orders", "supplier", "events"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    compare(name, spark, sf, con)
