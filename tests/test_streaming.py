"""A replayed stream gives the rows of the batch fold, and each step keeps its rules."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodeloom.binding import Domain
from lodeloom.streaming import machines as m
from lodeloom.streaming.ordered import fold, stream


def at(s: int, accuracy: float = 10.0, lat: float = 0.0, lng: float = 0.0, fix_id: int = 0) -> dict:
    return {"at_s": s, "accuracy": accuracy, "lat": lat, "lng": lng, "fix_id": fix_id, "uid": 1, "place": fix_id % 3, "cell": fix_id % 4, "empty": fix_id % 2 == 1}


def run(step, events) -> list:
    state, out = {}, []
    for e in events:
        state, said = step(state, e)
        out.append(said)
    return out


def test_gate_counts_from_the_last_searched_fix():
    degree = 1 / 111195
    assert run(m.movement_gate, [at(0), at(1, lng=150 * degree), at(2, lng=250 * degree), at(3, lng=300 * degree)]) == ["search", None, "search", None]


def test_dwell_prompts_once_and_starts_anew():
    assert run(m.dwell, [at(0), at(200), at(300), at(400), at(800)]) == [None, None, "prompt 0", None, "prompt 0"]


def indoor_run(readings) -> tuple[str, list]:
    """The context after (second, accuracy) readings, and what was said at which second."""
    state, said = {}, []
    for s, accuracy in readings:
        state, out = m.indoor(state, at(s, accuracy))
        if out:
            said.append((s, out))
    return state.get("now", "outdoor"), said


BAD, GOOD = 120.0, 10.0


def test_indoor_needs_three_readings_and_the_hold():
    assert indoor_run([(0, BAD), (1, BAD)]) == ("outdoor", [])
    assert indoor_run([(s, BAD) for s in range(14)] + [(16, BAD)]) == ("outdoor", [])
    assert indoor_run([(s, BAD) for s in range(20)]) == ("indoor_unmapped", [(17, "indoor_unmapped")])


def test_indoor_leaves_only_after_a_held_recovery():
    inside = [(s, BAD) for s in range(20)]
    assert indoor_run(inside + [(50 + s, GOOD) for s in range(20)])[1] == [(17, "indoor_unmapped"), (67, "outdoor")]
    # between the two thresholds nothing changes, and what was pending is forgotten
    mixed = [(50 + s, GOOD if s % 2 else BAD) for s in range(40)]
    assert indoor_run(inside + mixed) == ("indoor_unmapped", [(17, "indoor_unmapped")])
    neutral = [(s, BAD) for s in range(5)] + [(50 + s, GOOD) for s in range(20)]
    assert indoor_run(neutral + [(90, BAD), (91, BAD), (92, BAD), (93, BAD)]) == ("outdoor", [])
    # under three readings after a silence, the context stays
    assert indoor_run(inside + [(300, GOOD), (320, GOOD), (340, GOOD)])[0] == "indoor_unmapped"


def test_indoor_ratios_at_their_bounds():
    seven = [(s, BAD if s < 7 else GOOD) for s in range(10)]
    assert indoor_run([*seven, *[(s, BAD) for s in range(10, 30)]])[0] == "indoor_unmapped"
    state = {"now": "indoor_unmapped", "readings": [(s, BAD if s < 3 else GOOD) for s in range(9)]}
    assert m.indoor(state, at(9, GOOD))[0]["pending"] == "outdoor"  # three of ten


def test_mall_in_reach_maps_the_context(spark):
    ticks = spark.createDataFrame([(u, u * 100 + k, 3 * k, 90.0, 38.7, -9.1 + u * 0.01) for u in (1, 2) for k in range(20)], "uid long, fix_id long, at_s long, accuracy double, lat double, lng double")
    malls = spark.createDataFrame([(1, 38.7, -9.0905), (2, 38.7, -9.0902)], "place_id long, lat double, lng double")
    assert sorted(map(tuple, m.indoor_contexts(ticks, malls).collect())) == [(1, 107, "indoor_mapped"), (1, 107, "indoor_unmapped"), (2, 207, "indoor_unmapped")]


def test_rate_limit_windows_begin_at_a_call():
    assert run(m.rate_limit, [at(s) for s in (0, 1, 2, 3, 4, 5, 299, 300, 301)]) == ["allow"] * 5 + ["refuse"] * 2 + ["allow"] * 2


def test_tuning_asks_once():
    assert run(m.tuning, [at(0, 60), at(1, 10), at(2, 300), at(3, 60)]) == ["prompted", "active", "off", None]


def test_alert_is_given_once_a_day_until_cleared():
    assert run(m.alert_dedup, [at(0), at(1), at(2, 300), at(3), at(90000)]) == ["alert 0:0", None, None, "alert 0:0", "alert 0:1"]


def test_cooldown():
    assert run(m.cooldown, [at(0, fix_id=1), at(10, fix_id=5), at(3600, fix_id=1)]) == ["ask", "skip", "ask"]


def test_offline_queue_replays_what_is_fresh():
    events = [("search", 0), ("offline", 10), ("search", 20), ("search", 100), ("search", 200), ("online", 320), ("search", 330), ("online", 340), ("offline", 350), ("online", 360)]
    said = run(m.offline_queue, [at(s, fix_id=i) | {"kind": k} for i, (k, s) in enumerate(events)])
    assert said == ["run", None, None, None, None, [(3, "replay 1"), (4, "replay 2")], "run", [], None, []]


def test_a_silent_key_begins_anew(spark):
    rows = [(1, i, s, 38.7, -9.1) for i, s in enumerate((0, 10, 86_409, 86_410 + 86_400))]
    got = fold(m.MACHINES["win9_movement_gate"], spark.createDataFrame(rows, "uid long, fix_id long, at_s long, lat double, lng double")).collect()
    assert sorted(r.fix_id for r in got) == [0, 3]


def replay(spark, tmp_path, machine, batches, name):
    """Outputs of a stream that reads each batch of rows in a micro-batch of its own."""
    folder, checkpoint = tmp_path / "in", str(tmp_path / "cp")
    for n, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        folder.mkdir(exist_ok=True)
        source = next((tmp_path / f"part{n}").glob("*.parquet"))
        target = folder / f"{n:03}.parquet"
        shutil.copy(source, target)
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    events = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = stream(machine, events, "10 minutes").writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return sorted(map(tuple, spark.sql(f"select * from {name}").collect())), checkpoint


@pytest.mark.parametrize("name", sorted(m.MACHINES))
def test_stream_with_late_and_disordered_rows_equals_the_fold(name, spark, tmp_path):
    """Rows come in a shuffled order within the delay; one comes too late; in the end a row of a far day lets all pass and all state end."""
    machine = m.MACHINES[name]
    d = Domain(spark, "/root/testdata/sf0.01")
    events = m.events_of(d, name).where("uid < 3 and fix_id < 2500" if name in ("stm2_indoor", "win11_rate_limit", "stm6_offline_queue") else "uid < 4 and fix_id < 2500")
    if name == "stm3_tuning" or name == "stm7_alert_dedup":
        events = events.withColumn("accuracy", F.col("accuracy") * F.when(F.col("fix_id") % 3 == 0, 20).otherwise(1))
    events = events.select(*machine.columns).cache()
    first = events.agg(F.min("at_s")).first()[0]
    span = events.agg(F.max("at_s")).first()[0] - first + 1
    batch = sorted(map(tuple, fold(machine, events).collect()))
    # each row is moved back by less than the delay: arrival = time + up to 9 minutes, in five batches
    arrival = F.col("at_s") + F.pmod(F.xxhash64("fix_id"), F.lit(540))
    placed = events.withColumn("n", F.least(F.lit(4), F.floor((arrival - first) * 5 / span)))
    parts = [placed.where(F.col("n") == n).drop("n") for n in range(5)]
    late = events.orderBy("at_s").limit(1).withColumn("fix_id", F.col("fix_id") - 1_000_000)  # by now far behind the watermark
    key_types = dict(events.dtypes)
    far = events.limit(1).select(*(F.lit(-1).cast(key_types[c]).alias(c) if c in machine.keys else (F.lit(first + 10 * 86_400).alias(c) if c == "at_s" else F.col(c)) for c in events.columns))
    if span > 1200:
        parts[4] = parts[4].unionByName(late)
    got, checkpoint = replay(spark, tmp_path, machine, [*parts, far], "seen_" + name)
    assert [r for r in got if r[0] != -1] == batch and batch
    for what in ("clock", *(["kept"] if machine.kept else []), "waiting", *machine.lists, *machine.maps):
        left = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", what).load()
        assert {tuple(r.key)[0] for r in left.select("key").collect()} <= {-1}, what


def test_watermarked_counts_run_on_a_stream(spark, sf, tmp_path):
    d = Domain(spark, sf)
    d.inbox.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(d.inbox.schema).parquet(str(tmp_path / "in"))
    q = m.daily_counts(source).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from live").collect())) == sorted(map(tuple, m.daily_counts(d.inbox).collect()))
