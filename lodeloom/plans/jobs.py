"""Batch jobs: rollover, rewards, ledgers, caches, imports, nudges, trips, shares, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.binding import NOW, TODAY, Domain, query
from lodeloom.functions.geo import haversine
from lodeloom.functions.text import tokens
from lodeloom.operators.aggregates import _TRIGGERS, friend_triggers

DAY = 86400


def rolled_over(tasks: DataFrame, today: str) -> DataFrame:
    """Undone tasks of past days move to today and remember the first day; past undone birthdays go. Running it twice changes nothing more."""
    late = ~F.col("done") & (F.col("day") < F.lit(today).cast("date"))
    kept = tasks.where(~(late & F.col("kind").eqNullSafe("birthday")))
    return kept.withColumns({"origin_day": F.when(late, F.coalesce("origin_day", "day")).otherwise(F.col("origin_day")), "day": F.when(late, F.lit(today).cast("date")).otherwise(F.col("day"))})


@query("biz3_rollover", f"SELECT task_id, CASE WHEN late THEN DATE '{TODAY}' ELSE day END AS day, CASE WHEN late THEN coalesce(origin_day, day) ELSE origin_day END AS origin_day FROM (SELECT *, NOT done AND day < DATE '{TODAY}' AS late FROM tasks) WHERE NOT (late AND kind IS NOT NULL)")
def biz3(d: Domain) -> DataFrame:
    return rolled_over(rolled_over(d.tasks, TODAY), TODAY).select("task_id", "day", "origin_day")


_COMPLETIONS = "SELECT uid, task_id, poi, completed_s, created_s, row_number() OVER (PARTITION BY uid ORDER BY completed_s, task_id) AS nth, row_number() OVER (PARTITION BY uid, poi ORDER BY completed_s, task_id) AS nth_of_type, count(poi) OVER (PARTITION BY uid ORDER BY completed_s, task_id ROWS UNBOUNDED PRECEDING) AS poi_so_far FROM tasks WHERE done AND kind IS NULL"
_REWARDS = f"SELECT *, sum(CASE WHEN poi IS NOT NULL AND nth_of_type = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY completed_s, task_id ROWS UNBOUNDED PRECEDING) AS kinds FROM ({_COMPLETIONS})"


def completions(d: Domain) -> DataFrame:
    """Completed tasks with running counts, in the order of completion; birthdays don't count."""
    order = Window.partitionBy("uid").orderBy("completed_s", "task_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    of_type = Window.partitionBy("uid", "poi").orderBy("completed_s", "task_id")
    done = d.tasks.where(F.col("done") & ~F.col("kind").eqNullSafe("birthday"))
    rows = done.select("uid", "task_id", "poi", "completed_s", "created_s", F.row_number().over(order).alias("nth"), F.row_number().over(of_type).alias("nth_of_type"), F.count("poi").over(so_far).alias("poi_so_far"))
    return rows.withColumn("kinds", F.sum((F.col("poi").isNotNull() & (F.col("nth_of_type") == 1)).cast("int")).over(so_far))


@query("biz4_rewards", f"SELECT task_id, nth = 1 AS first_done, completed_s - created_s >= 3 * 86400 AS worth_wait, poi IS NOT NULL AND nth_of_type = 1 AND kinds = 3 AS out_about, poi IS NOT NULL AND poi_so_far = 10 AS explorer, completed_s % 86400 < 9 * 3600 AS early_bird FROM ({_REWARDS})")
def biz4(d: Domain) -> DataFrame:
    """The closed-form rules, one flag each for the completion that earns it."""
    went, c = F.col("poi").isNotNull(), F.col
    return completions(d).select("task_id", (c("nth") == 1).alias("first_done"), (c("completed_s") - c("created_s") >= 3 * DAY).alias("worth_wait"), (went & (c("nth_of_type") == 1) & (c("kinds") == 3)).alias("out_about"), (went & (c("poi_so_far") == 10)).alias("explorer"), (c("completed_s") % DAY < 9 * 3600).alias("early_bird"))


@query("biz5_award_or_progress", "SELECT uid, kind, n, CASE WHEN n >= 5 AND (kind % 2 = 0 OR n = 5) THEN 'award' ELSE 'progress' END AS outcome FROM (SELECT uid, id % 11 AS kind, count(*) AS n FROM ledger GROUP BY ALL)")
def biz5(d: Domain) -> DataFrame:
    rows = d.ledger.groupBy("uid", (F.col("id") % 11).alias("kind")).agg(F.count("*").alias("n"))
    return rows.withColumn("outcome", F.when((F.col("n") >= 5) & ((F.col("kind") % 2 == 0) | (F.col("n") == 5)), "award").otherwise("progress"))


@query("biz6_on_a_roll", "SELECT uid, d AS day FROM (SELECT *, row_number() OVER (PARTITION BY uid, isle ORDER BY d) AS streak FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY uid ORDER BY d) AS INTEGER) AS isle FROM (SELECT uid, day AS d FROM tasks GROUP BY ALL HAVING bool_and(done)))) WHERE streak = 3")
def biz6(d: Domain) -> DataFrame:
    days = d.tasks.groupBy("uid", "day").agg(F.every("done").alias("ok")).where("ok")
    isles = days.withColumn("isle", F.date_sub("day", F.row_number().over(Window.partitionBy("uid").orderBy("day"))))
    streak = isles.withColumn("streak", F.row_number().over(Window.partitionBy("uid", "isle").orderBy("day")))
    before = F.coalesce(F.lag("streak").over(Window.partitionBy("uid").orderBy("day")), F.lit(0))
    return streak.withColumn("was", before).where("streak >= 3 and was < 3").select("uid", "day")


@query("biz7_centurion", "SELECT uid, arg_min(id, at_s * 1000000 + id) AS id FROM (SELECT *, sum(points) OVER (PARTITION BY uid ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS total FROM ledger) WHERE total >= 100 GROUP BY uid")
def biz7(d: Domain) -> DataFrame:
    so_far = Window.partitionBy("uid").orderBy("at_s", "id").rowsBetween(Window.unboundedPreceding, 0)
    return d.ledger.withColumn("total", F.sum("points").over(so_far)).where("total >= 100").groupBy("uid").agg(F.min_by("id", F.struct("at_s", "id")).alias("id"))


@query("biz8_first_task", "SELECT uid, min(created_s) AS at_s, min(CASE WHEN category LIKE 'c%' THEN created_s END) AS custom_s FROM tasks GROUP BY uid")
def biz8(d: Domain) -> DataFrame:
    return d.tasks.groupBy("uid").agg(F.min("created_s").alias("at_s"), F.min(F.when(F.col("category").like("c%"), F.col("created_s"))).alias("custom_s"))


@query("biz9_onboarding_bonus", "SELECT DISTINCT concat('onboarding_', uid) AS key, 10 AS points FROM ledger WHERE reason = 'onboarding'")
def biz9(d: Domain) -> DataFrame:
    return d.ledger.where("reason = 'onboarding'").select(F.concat(F.lit("onboarding_"), F.col("uid").cast("string")).alias("key"), F.lit(10).alias("points")).dropDuplicates(["key"])


@query("biz10_winner_reward", "SELECT DISTINCT uid, challenge_id, concat('challenge_', challenge_id) AS key FROM players WHERE won")
def biz10(d: Domain) -> DataFrame:
    return d.players.where("won").select("uid", "challenge_id", F.concat(F.lit("challenge_"), F.col("challenge_id").cast("string")).alias("key")).dropDuplicates(["uid", "key"])


@query("biz11_award_revoke", "SELECT DISTINCT concat(task_id, '_', at_s // 86400) AS key FROM ledger WHERE reason = 'task_completed' AND task_id NOT IN (SELECT DISTINCT task_id FROM ledger WHERE reason = 'onboarding' AND points > 95)")
def biz11(d: Domain) -> DataFrame:
    revoked = d.ledger.where("reason = 'onboarding' and points > 95").select("task_id")
    kept = d.ledger.where("reason = 'task_completed'").join(revoked, "task_id", "left_anti")
    return kept.select(F.concat_ws("_", "task_id", F.expr("at_s div 86400")).alias("key")).distinct()


@query("biz12_identity_upsert", "SELECT place_id, lat + CASE WHEN place_id % 3 = 0 AND place_id % 2 = 0 THEN 0.001 ELSE 0 END AS lat, greatest(expires_s, CASE WHEN place_id % 3 = 0 THEN 1706000000 END) AS expires_s, coalesce(area, CASE WHEN place_id % 3 = 0 THEN 'ta_new' END) AS area FROM places")
def biz12(d: Domain) -> DataFrame:
    """Candidates (every third place, every sixth from the map source) merge into known places: the first area wins, the later expiry, map coordinates."""
    new = d.places.where("place_id % 3 = 0").selectExpr("place_id", "case when place_id % 2 = 0 then lat + 0.001 end as new_lat", "cast(1706000000 as bigint) as new_expires", "'ta_new' as new_area")
    return d.places.join(new, "place_id", "left").select("place_id", F.coalesce("new_lat", "lat").alias("lat"), F.greatest("expires_s", "new_expires").alias("expires_s"), F.coalesce("area", "new_area").alias("area"))


@query("biz13_staleness_plan", f"SELECT poi FROM (SELECT unnest(range(16)) AS poi) WHERE poi NOT IN (SELECT poi FROM places WHERE fetched_s >= {NOW} - 86400 AND osm) AND poi % 5 <> 0")
def biz13(d: Domain) -> DataFrame:
    fresh = d.places.where((F.col("fetched_s") >= NOW - DAY) & F.col("osm")).select("poi")
    cooling = d.spark.range(0, 16, 5).select(F.col("id").alias("poi"))
    return d.spark.range(16).select(F.col("id").alias("poi")).join(fresh, "poi", "left_anti").join(cooling, "poi", "left_anti")


@query("biz15_pre_refresh", f"SELECT trip_id FROM trips WHERE start_day BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 2 AND (refreshed_s IS NULL OR refreshed_s < {NOW} - 86400)")
def biz15(d: Domain) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return d.trips.where(F.col("start_day").between(today, F.date_add(today, 2)) & (F.col("refreshed_s").isNull() | (F.col("refreshed_s") < NOW - DAY))).select("trip_id")


@query("biz16_expiry_sweep", f"SELECT place_id FROM places WHERE (expires_s IS NULL OR expires_s > {NOW}) AND area IS DISTINCT FROM 'ta_20'")
def biz16(d: Domain) -> DataFrame:
    return d.places.where((F.col("expires_s").isNull() | (F.col("expires_s") > NOW)) & ~F.col("area").eqNullSafe("ta_20")).select("place_id")


@query("biz17_import", "SELECT min(id) AS id, title FROM (SELECT id, concat('buy bread ', id % 120) AS title FROM inbox) WHERE title NOT IN (SELECT lower(trim(title)) FROM tasks) GROUP BY title")
def biz17(d: Domain) -> DataFrame:
    incoming = d.inbox.select("id", F.concat(F.lit("buy bread "), (F.col("id") % 120).cast("string")).alias("title"))
    return incoming.groupBy("title").agg(F.min("id").alias("id")).join(d.tasks.select(F.lower(F.trim("title")).alias("title")), "title", "left_anti").select("id", "title")


@query("biz18_context_chip", f"SELECT u.uid, coalesce(CASE WHEN t.mall THEN 'mall' END, CASE WHEN t.trip THEN 'trip' END, CASE WHEN t.offgrid THEN 'offgrid' END, CASE WHEN u.uid % 9 = 0 THEN 'offline' END, 'none') AS chip FROM users u LEFT JOIN (SELECT uid, bool_or(kind = 'mall') AS mall, bool_or(kind IS NULL) AS trip, bool_or(kind = 'offgrid') AS offgrid FROM trips WHERE expires_s > {NOW - 864000} GROUP BY uid) t USING (uid)")
def biz18(d: Domain) -> DataFrame:
    k = F.col("kind")
    live = d.trips.where(F.col("expires_s") > NOW - 864000).groupBy("uid").agg(F.some(k == "mall").alias("mall"), F.some(k.isNull()).alias("trip"), F.some(k == "offgrid").alias("offgrid"))
    chip = F.coalesce(*(F.when(F.col(c), c) for c in ("mall", "trip", "offgrid")), F.when(F.col("uid") % 9 == 0, "offline"), F.lit("none"))
    return d.users.select("uid").join(live, "uid", "left").select("uid", chip.alias("chip"))


@query(
    "biz19_friend_nudges",
    f"SELECT DISTINCT f.follower, t.uid AS actor, t.full_list FROM ({_TRIGGERS}) t JOIN follows f ON f.followed = t.uid JOIN users u ON u.uid = f.follower "
    f"LEFT JOIN (SELECT follower, actor, max(at_s) AS at_s FROM nudges GROUP BY ALL) n ON n.follower = f.follower AND n.actor = t.uid WHERE (t.full_list OR t.burst) AND coalesce(u.friend_nudges, true) AND coalesce({NOW} - n.at_s >= 86400, true)",
)
def biz19(d: Domain) -> DataFrame:
    """Followers to be told that a friend's list is done, or that three tasks were done in half an hour; once a day for each pair."""
    active = friend_triggers(d.completions).where("full_list or burst").select(F.col("uid").alias("actor"), "full_list")
    willing = d.users.where(F.coalesce("friend_nudges", F.lit(True))).select(F.col("uid").alias("follower"))
    told = d.nudges.groupBy("follower", "actor").agg(F.max("at_s").alias("told_s")).where(NOW - F.col("told_s") < DAY)
    pairs = d.follows.select("follower", F.col("followed").alias("actor")).distinct().join(active, "actor").join(willing, "follower")
    return pairs.join(told, ["follower", "actor"], "left_anti").select("follower", "actor", "full_list")


@query("biz20_re_engage", f"SELECT uid FROM users WHERE opened_s > {NOW} - 4 * 86400 AND opened_s <= {NOW} - 3 * 86400 AND NOT coalesce(nudged_s > {NOW} - 86400, false)")
def biz20(d: Domain) -> DataFrame:
    o = F.col("opened_s")
    return d.users.where((o > NOW - 4 * DAY) & (o <= NOW - 3 * DAY) & ~F.coalesce(F.col("nudged_s") > NOW - DAY, F.lit(False))).select("uid")


@query("biz21_lapsed", f"SELECT uid FROM users WHERE opened_s <= {NOW} - 7 * 86400 AND nudged_s IS NOT NULL AND NOT churned")
def biz21(d: Domain) -> DataFrame:
    return d.users.where((F.col("opened_s") <= NOW - 7 * DAY) & F.col("nudged_s").isNotNull() & ~F.col("churned")).select("uid")


@query("biz22_evening_nudge", f"SELECT uid, count(*) FILTER (NOT done) > 0 AS end_of_day, bool_and(done) AS streak_safe, count(*) >= 2 AS weekly FROM tasks WHERE day = DATE '{TODAY}' GROUP BY uid")
def biz22(d: Domain) -> DataFrame:
    return d.tasks.where(F.col("day") == F.lit(TODAY).cast("date")).groupBy("uid").agg((F.count_if(~F.col("done")) > 0).alias("end_of_day"), F.every("done").alias("streak_safe"), (F.count("*") >= 2).alias("weekly"))


#: Days ahead that the calendar is looked at.
AHEAD_DAYS = 7
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: length(t) >= 3)"


def trip_suggestions(events: DataFrame, known: DataFrame, dismissed: DataFrame, now: int = NOW) -> DataFrame:
    """uid, event_id, place: the first event of each user, within AHEAD_DAYS, at a place that isn't known nor was dismissed.

    A place is known if it shares a word of three letters or more with a known name (uid, name) of the user. Users' words meet by
    equality. Events without a place don't count; a place without such a word isn't known.
    """
    soon = events.where(F.col("at_s").between(now, now + AHEAD_DAYS * DAY) & (F.trim("place") != ""))
    words = soon.select("uid", "event_id", F.explode(tokens(F.col("place"))).alias("word"))
    names = known.select("uid", F.explode(tokens(F.col("name"))).alias("word")).distinct()
    met = words.join(names, ["uid", "word"], "left_semi").select("event_id").distinct()
    left = soon.join(met, "event_id", "left_anti").join(dismissed, "event_id", "left_anti")
    first = left.groupBy("uid").agg(F.min(F.struct("at_s", "event_id", F.trim("place").alias("place"))).alias("e"))
    return first.select("uid", "e.event_id", "e.place")


@query(
    "biz23_trip_suggestion",
    f"SELECT uid, arg_min(event_id, at_s * 1000000000 + event_id) AS event_id, arg_min(trim(place), at_s * 1000000000 + event_id) AS place FROM plans p WHERE trim(place) <> '' AND at_s BETWEEN {NOW} AND {NOW} + {AHEAD_DAYS} * 86400 "
    f"AND NOT EXISTS (SELECT 1 FROM trips t WHERE t.uid = p.uid AND list_has_any({_TOKENS.format('t.destination')}, {_TOKENS.format('p.place')})) AND event_id NOT IN (SELECT entry FROM players WHERE won) GROUP BY uid",
)
def biz23(d: Domain) -> DataFrame:
    return trip_suggestions(d.plans, d.trips.select("uid", F.col("destination").alias("name")), d.players.where("won").select(F.col("entry").alias("event_id")))


@query("biz25_follow_edges", "SELECT follower, followed FROM follows WHERE follower <> followed EXCEPT SELECT followed, follower FROM follows WHERE follower % 10 = 0")
def biz25(d: Domain) -> DataFrame:
    dropped = d.follows.where("follower % 10 = 0").select(F.col("followed").alias("follower"), F.col("follower").alias("followed"))
    return d.follows.where("follower <> followed").select("follower", "followed").distinct().join(dropped, ["follower", "followed"], "left_anti")


@query("biz26_share_moves", "SELECT uid, entry AS id, 'task' AS place FROM players WHERE joined = 'accepted' UNION ALL SELECT uid, entry, 'inbox' FROM players WHERE joined = 'pending'")
def biz26(d: Domain) -> DataFrame:
    waiting = d.players.where("joined = 'pending'").select("uid", F.col("entry").alias("id"), F.lit("inbox").alias("place"))
    return waiting.union(d.players.where("joined = 'accepted'").select("uid", "entry", F.lit("task")))


@query("biz27_attach_place", "SELECT task_id, CASE WHEN poi = uid % 16 THEN visited END AS place_id FROM tasks WHERE done")
def biz27(d: Domain) -> DataFrame:
    hero = d.users.select("uid", (F.col("uid") % 16).alias("hero"))
    return d.tasks.where("done").join(hero, "uid").select("task_id", F.when(F.col("poi") == F.col("hero"), F.col("visited")).alias("place_id"))


@query(
    "biz28_challenge_create",
    "SELECT challenge_id, uid, CASE WHEN uid = arg_min(uid, first) OVER (PARTITION BY challenge_id) THEN 'accepted' ELSE 'pending' END AS state, count(*) OVER (PARTITION BY challenge_id) AS n "
    "FROM (SELECT challenge_id, uid, min(at_s * 1000000000 + entry) AS first FROM players GROUP BY challenge_id, uid)",
)
def biz28(d: Domain) -> DataFrame:
    """Players of a new challenge, a row each: who made it has accepted, all others are asked. Nothing holds a challenge's players at once."""
    one = d.players.groupBy("challenge_id", "uid").agg(F.min(F.struct("at_s", "entry")).alias("first"))
    made = one.groupBy("challenge_id").agg(F.min(F.struct("first", "uid"))["uid"].alias("creator"), F.count("*").alias("n"))
    return one.join(made, "challenge_id").select("challenge_id", "uid", F.when(F.col("uid") == F.col("creator"), "accepted").otherwise("pending").alias("state"), "n")


@query("biz29_learned_keywords", "SELECT concat('en:', lower(trim(title))) AS id, arg_max(poi, task_id) AS poi FROM tasks WHERE poi IS NOT NULL AND length(trim(title)) >= 12 GROUP BY 1")
def biz29(d: Domain) -> DataFrame:
    usable = d.tasks.where("poi is not null and length(trim(title)) >= 12")
    return usable.groupBy(F.concat(F.lit("en:"), F.lower(F.trim("title"))).alias("id")).agg(F.max_by("poi", "task_id").alias("poi"))


@query("biz30_category_keywords", "SELECT DISTINCT category AS keyword, 'custom' AS layer FROM tasks WHERE category LIKE 'c%'")
def biz30(d: Domain) -> DataFrame:
    return d.tasks.where(F.col("category").like("c%")).select(F.col("category").alias("keyword"), F.lit("custom").alias("layer")).distinct()


@query("biz33_first_session", "SELECT uid, renamed_s IS NULL AS first_session FROM users")
def biz33(d: Domain) -> DataFrame:
    return d.users.select("uid", F.col("renamed_s").isNull().alias("first_session"))


@query("biz34_welcome_back", f"SELECT uid, min(trip_id) AS trip_id FROM (SELECT t.uid, t.trip_id FROM trips t JOIN tasks c ON c.uid = t.uid AND c.done AND c.completed_s BETWEEN t.created_s AND t.expires_s WHERE t.kind = 'offgrid' AND t.expires_s <= {NOW} GROUP BY 1, 2) GROUP BY uid")
def biz34(d: Domain) -> DataFrame:
    over = d.trips.where((F.col("kind") == "offgrid") & (F.col("expires_s") <= NOW)).select("uid", "trip_id", F.col("created_s").alias("a"), F.col("expires_s").alias("b"))
    met = over.join(d.tasks.where("done").select("uid", "completed_s"), "uid").where("completed_s between a and b")
    return met.groupBy("uid").agg(F.min("trip_id").alias("trip_id"))


@query("biz35_learn_back", "SELECT task_id, CASE WHEN poi IS NULL THEN NULL WHEN poi = seq % 16 THEN 'llm' ELSE 'user' END AS source FROM tasks WHERE length(trim(title)) > 11")
def biz35(d: Domain) -> DataFrame:
    return d.tasks.where("length(trim(title)) > 11").select("task_id", F.when(F.col("poi").isNull(), None).when(F.col("poi") == F.col("seq") % 16, "llm").otherwise("user").alias("source"))


@query("biz37_mall_snapshot", "SELECT uid, arg_min(trip_id, metres * 1000 + trip_id / 1e6) AS trip_id FROM (SELECT u.uid, t.trip_id, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (SELECT u.uid, t.trip_id, sin(radians(t.lat - u.lat) / 2) * sin(radians(t.lat - u.lat) / 2) + cos(radians(u.lat)) * cos(radians(t.lat)) * sin(radians(t.lng - u.lng) / 2) * sin(radians(t.lng - u.lng) / 2) AS h FROM users u JOIN trips t ON t.uid = u.uid AND t.kind = 'mall') u JOIN trips t USING (trip_id)) WHERE metres <= 900 GROUP BY uid")
def biz37(d: Domain) -> DataFrame:
    malls = d.trips.where("kind = 'mall'").select("uid", "trip_id", F.col("lat").alias("t_lat"), F.col("lng").alias("t_lng"))
    met = d.users.join(malls, "uid").withColumn("metres", F.round(haversine(F.col("lat"), F.col("lng"), F.col("t_lat"), F.col("t_lng")), 3)).where("metres <= 900")
    return met.groupBy("uid").agg(F.min(F.struct("metres", "trip_id"))["trip_id"].alias("trip_id"))


@query("biz38_share_to_many", "SELECT id, count(*) FILTER (target % 3 <> 0) AS sent, count(*) FILTER (target % 3 = 0) AS failed FROM (SELECT id, unnest([uid + 1, uid + 2, uid + 5]) AS target FROM inbox WHERE kind = 'share') GROUP BY id")
def biz38(d: Domain) -> DataFrame:
    u = F.col("uid")
    targets = d.inbox.where("kind = 'share'").select("id", F.explode(F.array(u + 1, u + 2, u + 5)).alias("target"))
    return targets.groupBy("id").agg(F.count_if(F.col("target") % 3 != 0).alias("sent"), F.count_if(F.col("target") % 3 == 0).alias("failed"))


@query("biz39_share_route", "SELECT task_id, CASE WHEN poi IS NULL THEN 'manual' WHEN hhmm IS NULL THEN 'confirm' ELSE 'ready' END AS route FROM tasks")
def biz39(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.when(F.col("poi").isNull(), "manual").when(F.col("hhmm").isNull(), "confirm").otherwise("ready").alias("route"))


@query("biz24_far_pin", "SELECT fix_id FROM fixes f WHERE NOT EXISTS (SELECT 1 FROM trips t WHERE t.uid = f.uid) AND fix_id NOT IN (SELECT DISTINCT task_id FROM ledger WHERE reason = 'onboarding')")
def biz24(d: Domain) -> DataFrame:
    return d.fixes.join(d.trips.select("uid"), "uid", "left_anti").join(d.ledger.where("reason = 'onboarding'").select(F.col("task_id").alias("fix_id")), "fix_id", "left_anti").select("fix_id")
