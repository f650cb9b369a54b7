from __future__ import annotations

import json
from types import SimpleNamespace

import pytest

from lodeloom.sources import places as s


@pytest.fixture()
def tags(spark):
    return spark.createDataFrame([("atm", "amenity", "atm", 0), ("bank", "amenity", "bank", 1), ("cash", "amenity", "atm", 2)], "poi_type string, key string, value string, pos int")


def test_first_requested_type_wins_and_only_nodes_count(spark, tags, tmp_path):
    elements = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"amenity": "atm", "name": "A"}}, {"type": "way", "id": 2, "tags": {"amenity": "atm"}}, {"type": "node", "id": 3, "lat": 0.0, "lon": 0.0, "tags": {"amenity": "park"}}]
    (tmp_path / "a.json").write_text(json.dumps({"elements": elements}, indent=1))
    assert [tuple(r) for r in s.read_elements(spark, str(tmp_path / "a.json"), tags).collect()] == [("atm", 1, "A", 1.0, 2.0)]


def test_strict_fails_and_lenient_gives_no_rows(spark, tags, tmp_path):
    (tmp_path / "bad.json").write_text('{"elements": [')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        s.read_elements(spark, str(tmp_path / "bad.json"), tags).collect()
    assert s.read_elements(spark, str(tmp_path / "bad.json"), tags, strict=False).count() == 0


@pytest.mark.parametrize(("types", "radius"), [([], 10), (["a"] * 11, 10), (["a"], 0), (["a"], 5001)])
def test_search_arguments(types, radius):
    with pytest.raises(ValueError):
        s.checked_search(types, radius)


def test_items_of_several_sources_without_blank_titles(spark, tmp_path):
    for name, titles in (("a", ["x", " "]), ("b", ["y"])):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps({"id": i, "title": t}) for i, t in enumerate(titles)))
    items = s.read_items(spark, {n: str(tmp_path / f"{n}.json") for n in "ab"})
    assert sorted((r.source, r.title) for r in items.collect()) == [("a", "x"), ("b", "y")]


def test_labelled_text_round_trip(spark, tmp_path):
    rows = [('say "hi", now', "a"), ("naïve", "b")]
    s.write_labelled(spark.createDataFrame(rows, "text string, label string"), str(tmp_path / "c"))
    assert sorted(map(tuple, s.read_labelled(spark, str(tmp_path / "c")).collect())) == sorted(rows)


def test_id_column_wins(spark):
    assert s.with_id(spark.createDataFrame([("k", "inner")], "key string, id string"), "key").first().id == "k"


def test_responses_of_a_hot_type_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 100)
    places = spark.range(2000).selectExpr("id as place_id", "if(id < 1900, 1, 2) as poi", "concat('place ', id) as name", "1.0D as lat", "2.0D as lng")
    domain = SimpleNamespace(places=places, spark=spark)
    assert sorted(map(tuple, s.src12(domain).collect())) == [(1, i) for i in range(20)] + [(2, i) for i in range(1900, 1920)]
    assert sorted(map(tuple, s.src10(domain).collect())) == sorted((1 if i < 1900 else 2, i) for i in range(2000) if i % 5)
    sizes = [r["count"] for r in s.sliced(places).groupBy("poi", "slice").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 200
