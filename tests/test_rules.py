"""Rules with the values they have in use: validity, bursts, suggestions, time zones, data sets, numbering."""

from __future__ import annotations

from collections import Counter
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lodeloom.binding import Domain
from lodeloom.functions import zones
from lodeloom.operators.aggregates import friend_triggers
from lodeloom.operators.filters import broken_rules
from lodeloom.plans.calendar import JOBS
from lodeloom.plans.dataset import NEXT_TO, class_texts, keywords_of, plain_texts, synthesize, with_typo
from lodeloom.plans.jobs import trip_suggestions
from lodeloom.plans.numbering import hash_bucket, numbered

NOW = 19737 * 86400 + 43200


def test_task_rules(spark):
    rows = [("a" * 500, "c" * 120, "23:59", "birthday", ""), ("a" * 501, "c", None, None, "title"), ("", "c" * 121, "24:00", "party", "title,category,time,kind"), (None, None, "9:00", None, "title,category,time"), ("a", "c", "10:100", None, "time")]
    df = spark.createDataFrame(rows, "title string, category string, hhmm string, kind string, want string")
    assert [r for r in df.select("want", broken_rules().alias("got")).collect() if r.want != r.got] == []


def test_friend_triggers(spark):
    day, minute = "2024-01-15", 60
    rows = [(1, True, NOW - 9000), (1, True, NOW), (2, True, NOW - 30 * minute), (2, True, NOW - 1), (2, True, NOW), (2, False, None), (3, True, NOW - 30 * minute - 1), (3, True, NOW), (3, True, NOW), (3, False, None), (4, False, None)]
    df = spark.createDataFrame([(u, d, s) for u, d, s in rows], "uid long, done boolean, completed_s long").withColumn("day", F.lit(day).cast("date"))
    other = df.where("uid = 4").withColumn("day", F.lit("2024-01-16").cast("date")).withColumn("uid", F.lit(5).cast("long"))
    got = {r.uid: (r.full_list, r.burst) for r in friend_triggers(df.union(other.select(df.columns)), day, NOW).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (False, False), 4: (False, False)}


def test_trip_suggestions(spark):
    day = 86400
    events = [(1, 1, "Faro Airport", NOW + 9), (1, 2, " Porto ", NOW + 20), (1, 3, "Porto", NOW + 10), (1, 4, "Rome", NOW - 1), (2, 5, "Rome", NOW + 7 * day + 1), (2, 6, "", NOW + 1), (2, 7, None, NOW + 1), (3, 8, "de St", NOW + 7 * day), (4, 9, "Faro", NOW), (5, 10, "NY", NOW + 1)]
    known = spark.createDataFrame([(1, "Faro, Portugal"), (5, "NY"), (4, None)], "uid long, name string")
    frame = spark.createDataFrame([(u, e, p, a) for u, e, p, a in events], "uid long, event_id long, place string, at_s long")
    got = trip_suggestions(frame, known, spark.createDataFrame([(3,)], "event_id long"), NOW).collect()
    assert sorted(map(tuple, got)) == [(1, 2, "Porto"), (3, 8, "de St"), (4, 9, "Faro"), (5, 10, "NY")]


ZONES = ["UTC", "America/New_York", "Africa/Cairo", "America/Havana", "Atlantic/Azores", "Pacific/Auckland", "Australia/Lord_Howe", "Asia/Kolkata"]


@pytest.mark.parametrize("session", ["UTC", "America/Havana"])
def test_zones_through_gaps_and_overlaps(spark, session):
    """Against the standard library, around every change of clocks of a year, whatever the session's zone."""
    rows = []
    for zone in ZONES:
        tz, before = ZoneInfo(zone), None
        for hour in range(366 * 24):
            t = datetime(2024, 1, 1, tzinfo=UTC) + timedelta(hours=hour)
            offset = t.astimezone(tz).utcoffset()
            if before is not None and offset != before or hour % 700 == 0:
                rows += [(int(t.timestamp()) + s, zone) for s in (-90_000, -7200, -3601, -1800, -1, 0, 1, 1800, 3600, 5400, 80_000)]
            before = offset

    def at(day, hour, minute, tz):
        local = datetime(day.year, day.month, day.day, hour, minute)
        first = local.replace(tzinfo=tz, fold=0)
        return int(first.timestamp())

    def following(t, zone, hour, minute, weekday=None):
        tz = ZoneInfo(zone)
        day = datetime.fromtimestamp(t, tz).date()
        while True:
            if (weekday is None or day.weekday() == weekday) and at(day, hour, minute, tz) >= t:
                return at(day, hour, minute, tz)
            day += timedelta(1)

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        t, z = F.col("t"), F.col("z")
        day = zones.local_day(t, z)
        got = spark.createDataFrame(rows, "t long, z string").select(
            "t", "z", day.cast("string").alias("day"), zones.day_start(day, z).alias("start"), zones.quiet(t, z).alias("quiet"), zones.next_run(t, 2, 30, z).alias("early"), zones.next_run(t, 0, 0, z, 6).alias("sunday"),
            *(zones.next_run(t, h, m, "UTC", w).alias(n) for n, (h, m, w) in JOBS.items()),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    for r in got:
        tz = ZoneInfo(r.z)
        local = datetime.fromtimestamp(r.t, tz)
        assert (r.day, r.start, r.quiet) == (str(local.date()), at(local.date(), 0, 0, tz), local.hour >= 22 or local.hour < 8), r
        assert (r.early, r.sunday) == (following(r.t, r.z, 2, 30), following(r.t, r.z, 0, 0, 6)), r
        assert [r[n] for n in JOBS] == [following(r.t, "UTC", *JOBS[n]) for n in JOBS], r


def edits(word):
    """All that one edit can make of a word."""
    out = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} | {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i] + word[i:] for i in range(len(word))}
    return out | {word[:i] + o + word[i + 1 :] for i, c in enumerate(word) for o in NEXT_TO.get(c, "")} | {word}


def test_typos(spark):
    words = ["bread", "café", "ATM!", "abc", "", "pão", "zzzz"]
    df = spark.createDataFrame([(w, i) for w in words for i in range(200)], "w string, i int")
    got = {w: set() for w in words}
    for r in df.select("w", with_typo(F.col("w"), 1, F.col("i")).alias("t")).collect():
        got[r.w].add(r.t)
    assert all(ts <= edits(w) for w, ts in got.items())
    assert got["abc"] == {"abc"} and got["pão"] == {"pão"} and got[""] == {""}
    assert len(got["bread"]) > 0.7 * len(edits("bread"))


def test_data_set(spark, sf):
    d = Domain(spark, sf)
    texts = class_texts(keywords_of(d), plain_texts(d))
    rows = [tuple(r) for r in synthesize(texts.repartition(7), per_class=60, seed=3).collect()]
    again = [tuple(r) for r in synthesize(texts.coalesce(1), per_class=60, seed=3).collect()]
    assert sorted(rows) == sorted(again) and sorted(rows) != sorted(map(tuple, synthesize(texts, per_class=60, seed=4).collect()))
    per_class = Counter(r[0] for r in rows)
    assert set(per_class.values()) == {60} and {"none", "atm", "school"} <= set(per_class)
    assert sum(r[3] == "validation" for r in rows) == int(len(rows) * 0.15)
    pool = {}
    for r in texts.collect():
        pool.setdefault(r.label, set()).add(r.text.lower())
    share = sum(r[2] not in pool[r[0]] for r in rows) / len(rows)
    assert 0.05 < share < 0.16  # some edits leave a word as it is
    assert synthesize(texts.where("false"), per_class=5).count() == 0


def test_numbering(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 1_000_003).alias("v"))
    for within in ([], ["k"]):
        rows = numbered(df, hash_bucket("v", buckets=16), [F.col("v")], within).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r.k if within else 0, []).append(r.nth)
        assert all(sorted(g) == list(range(len(g))) for g in groups.values()) and len(rows) == 5000
    ordered = numbered(df, F.floor(F.col("v") / 1e8), [F.col("v")]).orderBy("nth").collect()
    assert [r.v for r in ordered] == sorted(r.v for r in ordered)


def test_a_strict_reader_fails_where_a_lenient_one_goes_on(spark, tmp_path):
    from lodeloom.sources.places import read_elements

    good = '{"elements":[{"type":"node","id":1,"lat":1.0,"lon":2.0,"tags":{"amenity":"cafe","name":"x"}}]}'
    spark.createDataFrame([(good,), ("error: busy",)], "value string").coalesce(1).write.text(str(tmp_path / "r"))
    tags = spark.createDataFrame([("cafe", "amenity", "cafe", 0)], "poi_type string, key string, value string, pos int")
    assert [tuple(r)[:2] for r in read_elements(spark, str(tmp_path / "r"), tags, strict=False, lines=True).collect()] == [("cafe", 1)]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_elements(spark, str(tmp_path / "r"), tags, strict=True, lines=True).collect()
