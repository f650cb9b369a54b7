"""State machines over position and task streams.

Each is a step for lodeloom.streaming.ordered, which folds it over a table and runs it on a stream by event time.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.binding import Domain, query
from lodeloom.functions.geo import duck_haversine, near_pairs
from lodeloom.streaming.ordered import Machine, Said, State, fold

#: Type number of shopping places, and how far one is looked for.
MALL, MALL_REACH = 11, 300.0


def metres(a: State, b: State) -> float:
    h = math.sin(math.radians(b["lat"] - a["lat"]) / 2) ** 2 + math.cos(math.radians(a["lat"])) * math.cos(math.radians(b["lat"])) * math.sin(math.radians(b["lng"] - a["lng"]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def movement_gate(state: State, fix: State, least: float = 200.0) -> tuple[State, Said]:
    """A search at the first fix, and at each that is least metres or more from the last searched one."""
    if not state or metres(state, fix) >= least:
        return {"lat": fix["lat"], "lng": fix["lng"]}, "search"
    return state, None


def dwell(state: State, fix: State, wait: int = 300) -> tuple[State, Said]:
    """A prompt when a place is the hero again wait seconds after it first was; the clock then starts anew. One state a place."""
    if "first" not in state:
        return {"first": fix["at_s"]}, None
    return (state, None) if fix["at_s"] - state["first"] < wait else ({}, f"prompt {fix['place']}")


def indoor(state: State, fix: State, span: int = 30, bad: float = 50.0, share: float = 0.7, hold: int = 15, least: int = 3) -> tuple[State, Said]:
    """outdoor or indoor_unmapped by the share of poor readings in the last span seconds.

    It takes a share of at least `share` to go in, and of at most 1 - share to go out; in between nothing changes and what was pending
    is forgotten. A change is made when it has been due for hold seconds. With fewer than least readings nothing is decided.
    """
    readings = [r for r in state.get("readings", []) if fix["at_s"] - r[0] <= span] + [(fix["at_s"], fix["accuracy"])]
    state = state | {"readings": readings}
    if len(readings) < least:
        return state, None
    now, poor = state.get("now", "outdoor"), sum(r[1] is not None and r[1] > bad for r in readings) / len(readings)
    target = "indoor_unmapped" if poor >= share and now == "outdoor" else "outdoor" if poor <= 1 - share and now != "outdoor" else None
    kept = {"readings": readings, "now": now}
    if target is None:
        return kept, None
    if state.get("pending") != target:
        return kept | {"pending": target, "since": fix["at_s"]}, None
    if fix["at_s"] - state["since"] < hold:
        return state, None
    return {"readings": readings, "now": target}, target


def rate_limit(state: State, call: State, window: int = 300, most: int = 5) -> tuple[State, Said]:
    """Windows begin at the first call after the last one's end; calls beyond most in one are refused."""
    if not state or call["at_s"] - state["start"] >= window:
        return {"start": call["at_s"], "n": 1}, "allow"
    if state["n"] >= most:
        return state, "refuse"
    return state | {"n": state["n"] + 1}, "allow"


def tuning(state: State, fix: State) -> tuple[State, Said]:
    """off, prompted, active: poor readings prompt once a session, a good one after the prompt activates."""
    now, accuracy = state.get("now", "off"), fix["accuracy"]
    if accuracy is None:
        return state, None
    if now == "off" and not state.get("asked") and accuracy > 50:
        return {"now": "prompted", "asked": True}, "prompted"
    if now == "prompted" and accuracy <= 20:
        return {"now": "active", "asked": True}, "active"
    if now == "active" and accuracy > 200:
        return {"now": "off", "asked": True}, "off"
    return state, None


def alert_dedup(state: State, fix: State) -> tuple[State, Said]:
    """One alert a place and day; when nothing is near, the day's memory goes, and that of earlier days goes anyway."""
    if fix["accuracy"] is not None and fix["accuracy"] > 200:
        return {}, None
    day, place = fix["at_s"] // 86400, str(fix["place"])
    seen = {k: v for k, v in state.get("seen", {}).items() if v == day}
    return ({"seen": seen}, None) if place in seen else ({"seen": seen | {place: day}}, f"alert {place}:{day}")


def cooldown(state: State, fix: State, keep: int = 3600) -> tuple[State, Said]:
    """An empty result keeps its cell from being asked for again for keep seconds. One state a cell."""
    if "last" in state and fix["at_s"] - state["last"] < keep:
        return state, "skip"
    return ({"last": fix["at_s"]} if fix["empty"] else {}), "ask"


def offline_queue(state: State, event: State, stale: int = 300) -> tuple[State, Said]:
    """Searches run at once, or wait while the connection is lost; when it is back those that waited less than stale seconds run in order."""
    queue = [q for q in state.get("queue", []) if event["at_s"] - q[0] < stale]
    if event["kind"] == "offline":
        return {"offline": True, "queue": queue}, None
    if event["kind"] == "online":
        return {}, [(entry, f"replay {n}") for n, (_, entry) in enumerate(queue, 1)]
    if state.get("offline"):
        return {"offline": True, "queue": [*queue, (event["at_s"], event["fix_id"])]}, None
    return state, "run"


MACHINES: dict[str, Machine] = {
    "win9_movement_gate": Machine(movement_gate, "lat lng", "lat double, lng double"),
    "win15_dwell": Machine(dwell, "place", "first long", keys=("uid", "place")),
    "stm2_indoor": Machine(indoor, "accuracy", "now string, pending string, since long", lists={"readings": "at_s long, accuracy double"}),
    "win11_rate_limit": Machine(rate_limit, "", "start long, n int", keep=300),
    "stm3_tuning": Machine(tuning, "accuracy", "now string, asked boolean"),
    "stm7_alert_dedup": Machine(alert_dedup, "accuracy place", maps={"seen": ("place string", "day long")}),
    "stm17_cooldown": Machine(cooldown, "cell empty", "last long", keys=("uid", "cell"), keep=3600),
    "stm6_offline_queue": Machine(offline_queue, "kind", "offline boolean", lists={"queue": "at_s long, entry long"}),
}


def sightings(d: Domain) -> DataFrame:
    """Fixes with what was found at each: the nearest place, the map cell, and whether a search there came back empty."""
    return d.fixes.selectExpr("*", "fix_id % 3 as place", "fix_id % 4 as cell", "fix_id % 2 = 1 as empty")


def events_of(d: Domain, name: str) -> DataFrame:
    return {"stm2_indoor": lambda: d.ticks, "win11_rate_limit": lambda: d.net, "stm6_offline_queue": lambda: d.net}.get(name, lambda: sightings(d))()


_IN_ORDER = "SELECT *, {p} AS part, row_number() OVER (PARTITION BY uid, {p} ORDER BY at_s, fix_id) AS k FROM {t}"
_NEXT = "FROM r JOIN f ON f.uid = r.uid AND f.part = r.part AND f.k = r.k + 1"
_FAR = f"{duck_haversine('r.lat', 'r.lng', 'f.lat', 'f.lng')} >= 200"
#: A key that was silent for a day begins anew.
_ANEW = "f.at_s - r.at_s >= 86400"


def _recursion(part: str, table: str, columns: str, first: str, then: str, said: str, where: str = "true") -> str:
    """Rows of a key one after another: what each is at the start, what it makes of the row before, and what is said."""
    return f"""
WITH RECURSIVE f AS ({_IN_ORDER.format(p=part, t=table)}), r AS (
  SELECT uid, part, k, fix_id, at_s, {columns} FROM (SELECT *, {first} FROM f WHERE k = 1)
  UNION ALL
  SELECT f.uid, f.part, f.k, f.fix_id, f.at_s, {then} {_NEXT}
) SELECT uid, fix_id, {said} AS said FROM r WHERE {where}"""


_WAS = f"CASE WHEN {_ANEW} THEN 'new' ELSE r.now END"
_TUNED = "CASE WHEN {w} = 'new' AND f.accuracy > 50 THEN 'prompted' WHEN {w} = 'prompted' AND f.accuracy <= 20 THEN 'active' WHEN {w} = 'active' AND f.accuracy > 200 THEN 'off' ELSE {w} END".format(w=f"({_WAS})")
_POOR = "count(*) FILTER (accuracy > 50) OVER w / CAST(count(*) OVER w AS DOUBLE) AS poor, count(*) OVER w AS n"
_TARGET = f"CASE WHEN f.n < 3 THEN 'keep' WHEN f.poor >= 0.7e0 AND ({_ANEW} OR r.now = 'outdoor') THEN 'indoor_unmapped' WHEN f.poor <= 1 - 0.7e0 AND NOT {_ANEW} AND r.now <> 'outdoor' THEN 'outdoor' ELSE 'none' END"
_DUE = f"({_TARGET}) NOT IN ('keep', 'none') AND NOT {_ANEW} AND r.pending = ({_TARGET}) AND f.at_s - r.since >= 15"
#: The machines in SQL: a recursion over a user's events, or over those of a user's place or cell.
STEP_SQL = {
    "win9_movement_gate": _recursion("0", "fixes", "lat, lng, true AS hit", "0", f"CASE WHEN {_ANEW} OR {_FAR} THEN f.lat ELSE r.lat END, CASE WHEN {_ANEW} OR {_FAR} THEN f.lng ELSE r.lng END, {_ANEW} OR {_FAR}", "'search'", "hit"),
    "win11_rate_limit": _recursion(
        "0", "net", "at_s AS start, 1 AS n, 'allow' AS what", "0",
        "CASE WHEN f.at_s - r.start >= 300 THEN f.at_s ELSE r.start END, CASE WHEN f.at_s - r.start >= 300 THEN 1 WHEN r.n >= 5 THEN r.n ELSE r.n + 1 END, CASE WHEN f.at_s - r.start >= 300 OR r.n < 5 THEN 'allow' ELSE 'refuse' END", "what",
    ),
    "win15_dwell": _recursion(
        "fix_id % 3", "fixes", "at_s AS first, false AS hit", "0",
        f"CASE WHEN {_ANEW} OR r.first IS NULL THEN f.at_s WHEN f.at_s - r.first < 300 THEN r.first END, coalesce(NOT {_ANEW} AND f.at_s - r.first >= 300, false)", "concat('prompt ', part)", "hit",
    ),
    "stm2_indoor": _recursion(
        "0", f"(SELECT *, {_POOR} FROM ticks WINDOW w AS (PARTITION BY uid ORDER BY at_s RANGE BETWEEN 30 PRECEDING AND CURRENT ROW))",
        "'outdoor' AS now, CAST(NULL AS VARCHAR) AS pending, CAST(NULL AS BIGINT) AS since, false AS hit", "0",
        f"CASE WHEN {_DUE} THEN ({_TARGET}) WHEN {_ANEW} THEN 'outdoor' ELSE r.now END, "
        f"CASE WHEN {_DUE} THEN NULL WHEN ({_TARGET}) = 'keep' THEN CASE WHEN NOT {_ANEW} THEN r.pending END WHEN ({_TARGET}) <> 'none' THEN ({_TARGET}) END, "
        f"CASE WHEN ({_TARGET}) = 'keep' OR r.pending = ({_TARGET}) AND NOT {_ANEW} THEN r.since ELSE f.at_s END, coalesce({_DUE}, false)", "now", "hit",
    ),
    "stm3_tuning": _recursion("0", "fixes", "CASE WHEN accuracy > 50 THEN 'prompted' ELSE 'new' END AS now, coalesce(accuracy > 50, false) AS hit", "0", f"{_TUNED}, ({_TUNED}) <> ({_WAS})", "now", "hit"),
    "stm7_alert_dedup": "SELECT uid, fix_id, concat('alert ', place, ':', day) AS said FROM (SELECT *, row_number() OVER (PARTITION BY uid, cleared, place, day ORDER BY at_s, fix_id) AS nth FROM (SELECT *, fix_id % 3 AS place, at_s // 86400 AS day, count(*) FILTER (accuracy > 200) OVER (PARTITION BY uid ORDER BY at_s, fix_id ROWS UNBOUNDED PRECEDING) AS cleared FROM fixes) WHERE NOT coalesce(accuracy > 200, false)) WHERE nth = 1",
    "stm17_cooldown": _recursion("fix_id % 4", "fixes", "CASE WHEN fix_id % 2 = 1 THEN at_s END AS last, 'ask' AS what", "0", "CASE WHEN f.at_s - r.last < 3600 THEN r.last WHEN f.fix_id % 2 = 1 THEN f.at_s END, CASE WHEN f.at_s - r.last < 3600 THEN 'skip' ELSE 'ask' END", "what"),
    "stm6_offline_queue": """
WITH seen AS (
  SELECT *, last_value(CASE WHEN kind <> 'search' THEN kind END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY at_s, fix_id ROWS UNBOUNDED PRECEDING) AS state,
    min(CASE WHEN kind = 'online' THEN at_s END) OVER (PARTITION BY uid ORDER BY at_s, fix_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back
  FROM net
)
SELECT uid, fix_id, CASE WHEN state = 'offline' THEN concat('replay ', row_number() OVER (PARTITION BY uid, state, back ORDER BY at_s, fix_id)) ELSE 'run' END AS said
FROM seen WHERE kind = 'search' AND (state IS DISTINCT FROM 'offline' OR back - at_s < 300)""",
}


def indoor_contexts(ticks: DataFrame, malls: DataFrame) -> DataFrame:
    """uid, fix_id, said: the changes of the indoor machine, and indoor_mapped where a mall is in reach of a place of going in.

    The lookup is a join on cells of the map, not a call for each change.
    """
    said = fold(MACHINES["stm2_indoor"], ticks)
    entered = said.where("said = 'indoor_unmapped'").join(ticks.select("uid", "fix_id", "lat", "lng"), ["uid", "fix_id"])
    mapped = near_pairs(entered, malls.select("place_id", "lat", "lng"), MALL_REACH).where(F.col("metres") <= MALL_REACH)
    return said.unionByName(mapped.select("uid", "fix_id", F.lit("indoor_mapped").alias("said")).distinct())


_MALLS = f"EXISTS (SELECT 1 FROM ticks t JOIN places p ON p.poi = {MALL} AND round({duck_haversine('t.lat', 't.lng', 'p.lat', 'p.lng')}, 3) <= {MALL_REACH} WHERE t.uid = s.uid AND t.fix_id = s.fix_id)"
STEP_SQL["stm2_indoor"] = STEP_SQL["stm2_indoor"].replace(") SELECT uid, fix_id, now AS said FROM r WHERE hit", f"), s AS (SELECT uid, fix_id, now AS said FROM r WHERE hit) SELECT * FROM s UNION ALL SELECT uid, fix_id, 'indoor_mapped' FROM s WHERE said = 'indoor_unmapped' AND {_MALLS}")

for _name, _machine in MACHINES.items():
    if _name != "stm2_indoor":
        query(_name, STEP_SQL[_name])(lambda d, n=_name, m=_machine: fold(m, events_of(d, n)))


@query("stm2_indoor", STEP_SQL["stm2_indoor"])
def stm2(d: Domain) -> DataFrame:
    return indoor_contexts(d.ticks, d.places.where(F.col("poi") == MALL))


@query("stm8_completions", "SELECT entry FROM (SELECT entry, completed, lag(completed) OVER (PARTITION BY challenge_id, uid ORDER BY at_s, entry) AS was FROM players) WHERE completed > 8 AND coalesce(was <= 8, true)")
def stm8(d: Domain) -> DataFrame:
    """Changes from below to above a mark, by the image before."""
    before = F.lag("completed").over(Window.partitionBy("challenge_id", "uid").orderBy("at_s", "entry"))
    return d.players.withColumn("was", before).where((F.col("completed") > 8) & F.coalesce(F.col("was") <= 8, F.lit(True))).select("entry")


@query("stm9_new_winners", "SELECT entry FROM (SELECT entry, won, lag(won) OVER (PARTITION BY challenge_id ORDER BY at_s, entry) AS was FROM players) WHERE won AND NOT coalesce(was, false)")
def stm9(d: Domain) -> DataFrame:
    before = F.lag("won").over(Window.partitionBy("challenge_id").orderBy("at_s", "entry"))
    return d.players.withColumn("was", before).where(F.col("won") & ~F.coalesce("was", F.lit(False))).select("entry")



@query("stm14_latest_toggle", "SELECT uid, arg_max(task_id, seq * 10000000 + task_id) AS task_id FROM tasks GROUP BY uid")
def stm14(d: Domain) -> DataFrame:
    return d.tasks.groupBy("uid").agg(F.max_by("task_id", F.struct("seq", "task_id")).alias("task_id"))


@query("stm16_latest_response", "SELECT uid, kind, max(id) AS id FROM inbox GROUP BY ALL")
def stm16(d: Domain) -> DataFrame:
    return d.inbox.groupBy("uid", "kind").agg(F.max_by("id", "id").alias("id"))


@query("stm18_stamp_debounce", "SELECT fix_id FROM (SELECT fix_id, at_s - lag(at_s) OVER (PARTITION BY uid ORDER BY at_s, fix_id) AS gap FROM fixes) WHERE coalesce(gap >= 600, true)")
def stm18(d: Domain) -> DataFrame:
    gap = F.col("at_s") - F.lag("at_s").over(Window.partitionBy("uid").orderBy("at_s", "fix_id"))
    return d.fixes.withColumn("gap", gap).where(F.coalesce(F.col("gap") >= 600, F.lit(True))).select("fix_id")


def daily_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Streaming or batch counts by day and kind, late events dropped beyond delay."""
    timed = events.withColumn("ts", F.timestamp_seconds("at_s"))
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "kind", "n")


@query("stm11_live_counts", "SELECT CAST(make_timestamp(at_s * 1000000) AS DATE) AS day, kind, count(*) AS n FROM inbox GROUP BY ALL")
def stm11(d: Domain) -> DataFrame:
    return daily_counts(d.inbox)
