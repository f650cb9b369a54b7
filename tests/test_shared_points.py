"""Joins by distance where many users and places share few points: right results, and points that meet once."""

from __future__ import annotations

import duckdb
import pytest

from lodeloom.functions import geo
from lodeloom.operators import joins
from tests.test_queries import compare

NAMES = (
    "agg18_bundle_sets",
    "biz1_proximity",
    "jn10_not_dismissed_today",
    "top8_learned_hero",
    "top7_hero",
    "win3_nearest_candidate",
    "jn3_same_place",
    "jn21_known_location",
    "jn2_places_in_radius",
    "top2_bundle_rank",
    "biz2_errand_bundles",
    "agg17_bundle_anchors",
    "jn8_task_pairs",
)
USERS, PLACES = 40, 60


@pytest.fixture(scope="module")
def crowded(tmp_path_factory, sf):
    """Users at two points; places at two points with three types, a few metres from the users."""
    folder = str(tmp_path_factory.mktemp("crowded"))
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(f"create table customer as select 1 + i % 2 + 2001 * i as c_custkey, concat('c', i) as c_name from range({USERS}) r(i)")
    # 7919 x 1811 and 104729 x 1811 put places near the first users; 2001 x 16 steps keep point and type, 2001 steps change the type alone
    con.execute(f"create table part as select CAST(k AS BIGINT) as p_partkey, concat(['red', 'blue'][1 + k % 2], ' bolt') as p_name from (select (select arg_min(p, abs((p * 7919) % 2001 - 6151 % 2001) + abs((p * 104729) % 2001 - 3571 % 2001)) from range(1, 2001) x(p)) + 2001 * (16 * (i // 3) + i % 3) as k from range({PLACES}) r(i))")
    con.execute(f"create table orders as select i as o_orderkey, 1 + u % 2 + 2001 * u as o_custkey, 'O' as o_orderstatus from (select i, i // 32 as u from range({USERS} * 32) r(i))")
    con.execute(f"create table supplier as select * from '{sf}/supplier.parquet'")
    for name in ("customer", "part", "orders", "supplier"):
        con.execute(f"copy {name} to '{folder}/{name}.parquet' (format parquet)")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_points_meet_once(name, spark, crowded, monkeypatch):
    met, plain = [], joins.near_pairs

    def counted(points, places, *args):
        met.append((points.count(), places.count()))
        return plain(points, places, *args)

    monkeypatch.setattr(joins, "near_pairs", counted)
    folder, con = crowded
    compare(name, spark, folder, con)
    assert met and all(a <= 2 * 3 and b <= 2 * 3 for a, b in met)
    assert con.execute(joins_sql(name)).fetchone()[0] > 0


@pytest.mark.parametrize("name", ("jn8_task_pairs", "agg17_bundle_anchors", "agg18_bundle_sets", "biz2_errand_bundles"))
def test_points_stay_where_they_are(name, spark, crowded, monkeypatch):
    """What is grouped and joined by the point isn't dealt again, and candidates are found once; the plan had 47 shuffles or more."""
    from lodeloom import registry

    monkeypatch.setattr(joins, "point_candidates", lambda d, found=joins.point_candidates: found(d).hint("coalesce", 7))
    plan = registry.queries()[name](spark, crowded[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Coalesce 7") == 1
    assert 0 < plan.count("Exchange hashpartitioning(point") <= 2
    assert plan.count("Exchange hashpartitioning(") + plan.count("BroadcastExchange") <= 30


@pytest.mark.parametrize("name", ("biz1_proximity", "top7_hero", "top8_learned_hero"))
def test_points_meet_once_for_all_types(name, spark, crowded, monkeypatch):
    """Each point of places met users' points once a type."""
    from lodeloom import registry
    from lodeloom.binding import Domain

    met, plain = [], joins.near_pairs

    def counted(points, places, *args):
        met.append(places.count())
        return plain(points, places, *args)

    monkeypatch.setattr(joins, "near_pairs", counted)
    registry.queries()[name](spark, crowded[0])
    assert set(met) == {Domain(spark, crowded[0]).places.select("lat", "lng").distinct().count()}


def test_visits_are_not_dealt_out_each(spark, crowded):
    """Of the places learned at a point each task has only the best left; all of them were grouped by place first."""
    from lodeloom import registry

    plan = registry.queries()["top8_learned_hero"](spark, crowded[0])._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line and "odd" in line.split("),")[0]]
    assert grouped and not any("place_id" in line for line in grouped)


def test_pairs_are_made_last(spark, crowded):
    """Lists of users and places meet and are taken apart as the last step; users were joined to points and then places, pair by pair."""
    from lodeloom import registry

    plan = registry.queries()["jn2_places_in_radius"](spark, crowded[0])._jdf.queryExecution().executedPlan().toString().split("\n")
    after = plan[: next(i for i, line in enumerate(plan) if "Join" in line)]
    assert sum("Generate" in line for line in after) == 2 and any("Coalesce" in line for line in after)
    assert not any("Exchange" in line for line in after)


def test_lists_and_cells_are_cut(spark, crowded, monkeypatch):
    """Lists of three at most, and a cell cut where they stand for many rows: all pairs are there, each once."""
    met, plain = [], joins.near_pairs

    def counted(points, places, *args):
        met.append((points.count(), places.count(), max(r[0] for r in points.selectExpr("size(users)").collect())))
        return plain(points, places, *args)

    monkeypatch.setattr(joins, "LISTED", 3)
    monkeypatch.setattr(geo, "LISTED_PAIRS", 50)
    monkeypatch.setattr(joins, "near_pairs", counted)
    folder, con = crowded
    compare("jn2_places_in_radius", spark, folder, con)
    assert met[0][0] >= USERS / 3 and met[0][1] >= PLACES / 3 and met[0][2] == 3


def test_parts_of_cells_have_a_limit(spark, crowded, monkeypatch):
    """What goes to each part of a cell goes to as many as tasks can use, however many pairs there are."""
    from lodeloom import registry

    seen, plain = [], geo.F.broadcast
    monkeypatch.setattr(geo, "LISTED_PAIRS", 1)
    monkeypatch.setattr(geo.F, "broadcast", lambda rows: seen.append(rows) or plain(rows))
    registry.queries()["jn2_places_in_radius"](spark, crowded[0])
    parts = [r["_parts"] for r in seen[-1].collect()]
    assert 8 <= sum(parts) <= 4 * geo.pair_tasks(spark) < USERS * PLACES


def joins_sql(name: str) -> str:
    from lodeloom import registry

    return f"select count(*) from ({registry.oracle_sql()[name]})"
