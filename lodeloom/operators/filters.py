"""Scans, filters, predicates and projections, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.binding import NOW, TODAY, Domain, query

DAY = 86400


@query("src1_point_lookup", "SELECT uid, username, display_name FROM users WHERE uid = 42")
def src1(d: Domain) -> DataFrame:
    return d.users.where("uid = 42").select("uid", "username", "display_name")


@query("src2_tasks_for_date", f"SELECT uid, task_id, row_number() OVER (PARTITION BY uid ORDER BY created_s, task_id) AS place FROM tasks WHERE day = DATE '{TODAY}'")
def src2(d: Domain) -> DataFrame:
    return d.tasks.where(F.col("day") == F.lit(TODAY).cast("date")).selectExpr("uid", "task_id", "cast(row_number() over (partition by uid order by created_s, task_id) as bigint) as place")


@query("src3_month_scan", "SELECT uid, task_id FROM tasks WHERE (day >= DATE '2024-01-01' AND day < DATE '2024-02-01') OR (origin_day >= DATE '2024-01-01' AND origin_day < DATE '2024-02-01')")
def src3(d: Domain) -> DataFrame:
    within = lambda c: (F.col(c) >= F.lit("2024-01-01").cast("date")) & (F.col(c) < F.lit("2024-02-01").cast("date"))
    return d.tasks.where(within("day") | within("origin_day")).select("uid", "task_id")


@query("src4_all_users_open_tasks", "SELECT uid, task_id FROM tasks WHERE NOT done")
def src4(d: Domain) -> DataFrame:
    return d.tasks.where("not done").select("uid", "task_id")


@query("src5_full_scan", "SELECT trip_id, uid, destination FROM trips")
def src5(d: Domain) -> DataFrame:
    return d.trips.select("trip_id", "uid", "destination")


@query("src6_visited", "SELECT task_id, visited FROM tasks WHERE visited IS NOT NULL")
def src6(d: Domain) -> DataFrame:
    return d.tasks.where(F.col("visited").isNotNull()).select("task_id", "visited")


@query("src7_cursor_page", "SELECT uid, id, at_s, rn = 11 AS more FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY at_s DESC, id DESC) AS rn FROM ledger WHERE at_s < 19723 * 86400 + 200000) WHERE rn <= 11")
def src7(d: Domain) -> DataFrame:
    page = d.ledger.where(F.col("at_s") < 19723 * DAY + 200000).selectExpr("*", "row_number() over (partition by uid order by at_s desc, id desc) as rn")
    return page.where("rn <= 11").selectExpr("uid", "id", "at_s", "rn = 11 as more")


@query("src9_box_scan", "SELECT place_id, poi FROM places WHERE poi IN (1, 2, 3) AND lat BETWEEN 38.715 AND 38.725 AND lng BETWEEN -9.145 AND -9.135")
def src9(d: Domain) -> DataFrame:
    return d.places.where(F.col("poi").isin(1, 2, 3) & F.col("lat").between(38.715, 38.725) & F.col("lng").between(-9.145, -9.135)).select("place_id", "poi")


@query("src14_first_five", "SELECT place_id, poi, coalesce(nullif(CASE WHEN place_id % 7 = 0 THEN '' ELSE name END, ''), concat('place ', place_id)) AS label FROM (SELECT *, row_number() OVER (PARTITION BY poi ORDER BY place_id) AS rn FROM places WHERE place_id % 4 <> 0) WHERE rn <= 5")
def src14(d: Domain) -> DataFrame:
    named = F.when(F.col("place_id") % 7 == 0, "").otherwise(F.col("name"))
    first = d.places.where("place_id % 4 <> 0").selectExpr("*", "row_number() over (partition by poi order by place_id) as rn").where("rn <= 5")
    return first.select("place_id", "poi", F.coalesce(F.nullif(named, F.lit("")), F.concat(F.lit("place "), F.col("place_id").cast("string"))).alias("label"))


@query("src15_located_details", "SELECT uid, home_lat, home_lng FROM users WHERE home_lat IS NOT NULL AND home_lng IS NOT NULL")
def src15(d: Domain) -> DataFrame:
    return d.users.where("home_lat is not null and home_lng is not null").select("uid", "home_lat", "home_lng")


@query("flt1_open_types", "SELECT DISTINCT uid, poi FROM tasks WHERE NOT done AND poi IS NOT NULL")
def flt1(d: Domain) -> DataFrame:
    return d.tasks.where("not done and poi is not null").select("uid", "poi").distinct()


@query("flt2_scorable", "SELECT task_id FROM tasks WHERE kind IS DISTINCT FROM 'birthday'")
def flt2(d: Domain) -> DataFrame:
    return d.tasks.where(~F.col("kind").eqNullSafe("birthday")).select("task_id")


@query("flt3_active_trips", f"SELECT trip_id, expires_s > {NOW} AS listed, expires_s >= {NOW} AS used FROM trips WHERE expires_s >= {NOW}")
def flt3(d: Domain) -> DataFrame:
    return d.trips.where(F.col("expires_s") >= NOW).select("trip_id", (F.col("expires_s") > NOW).alias("listed"), (F.col("expires_s") >= NOW).alias("used"))


@query("flt4_memorable_trips", f"SELECT trip_id FROM trips WHERE end_day < DATE '{TODAY}' AND kind IS DISTINCT FROM 'offgrid'")
def flt4(d: Domain) -> DataFrame:
    return d.trips.where((F.col("end_day") < F.lit(TODAY).cast("date")) & ~F.col("kind").eqNullSafe("offgrid")).select("trip_id")


@query("flt5_within_dates", f"SELECT trip_id, coalesce(start_day <= DATE '{TODAY}', true) AND coalesce(DATE '{TODAY}' <= end_day, true) AS inside FROM trips")
def flt5(d: Domain) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return d.trips.select("trip_id", (F.coalesce(F.col("start_day") <= today, F.lit(True)) & F.coalesce(today <= F.col("end_day"), F.lit(True))).alias("inside"))


@query("flt7_quiet_utc", "SELECT fix_id, at_s // 3600 % 24 >= 22 OR at_s // 3600 % 24 < 8 AS quiet FROM fixes")
def flt7(d: Domain) -> DataFrame:
    h = F.hour(F.timestamp_seconds("at_s"))
    return d.fixes.select("fix_id", ((h >= 22) | (h < 8)).alias("quiet"))


@query("flt8_far_all_day", "SELECT task_id, hhmm IS NULL AND day > DATE '2024-01-20' AS skipped FROM tasks")
def flt8(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", (F.col("hhmm").isNull() & (F.col("day") > F.lit("2024-01-20").cast("date"))).alias("skipped"))


#: Most letters of a task's title and category.
MOST_TITLE, MOST_CATEGORY = 500, 120
_STORED = "SELECT task_id, repeat(title, CAST(task_id % 60 AS INTEGER)) AS title, repeat(category, CAST(task_id % 40 AS INTEGER)) AS category, CASE WHEN task_id % 17 = 0 THEN hhmm || '0' ELSE hhmm END AS hhmm, CASE WHEN task_id % 22 = 0 THEN 'party' ELSE kind END AS kind FROM tasks"


def broken_rules() -> Column:
    """Names of the rules that a task (title, category, hhmm, kind) breaks, comma-joined. What may be missing is null."""
    size = lambda c, most: ~F.coalesce(F.length(c).between(1, most), F.lit(False))
    rules = {
        "title": size("title", MOST_TITLE),
        "category": size("category", MOST_CATEGORY),
        "time": ~F.col("hhmm").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"),
        "kind": F.col("kind") != "birthday",
    }
    return F.concat_ws(",", *(F.when(c, n) for n, c in rules.items()))


@query(
    "flt9_task_rules",
    f"SELECT task_id, concat_ws(',', CASE WHEN length(title) NOT BETWEEN 1 AND 500 THEN 'title' END, CASE WHEN length(category) NOT BETWEEN 1 AND 120 THEN 'category' END, CASE WHEN NOT regexp_full_match(hhmm, '([01][0-9]|2[0-3]):[0-5][0-9]') THEN 'time' END, CASE WHEN kind <> 'birthday' THEN 'kind' END) AS broken FROM ({_STORED})",
)
def flt9(d: Domain) -> DataFrame:
    times = lambda c, n: F.repeat(c, (F.col("task_id") % n).cast("int"))
    stored = d.tasks.select(
        "task_id", times(F.col("title"), 60).alias("title"), times(F.col("category"), 40).alias("category"),
        F.when(F.col("task_id") % 17 == 0, F.concat("hhmm", F.lit("0"))).otherwise(F.col("hhmm")).alias("hhmm"), F.when(F.col("task_id") % 22 == 0, "party").otherwise(F.col("kind")).alias("kind"),
    )
    return stored.select("task_id", broken_rules().alias("broken"))


@query(
    "flt10_entity_rules",
    "SELECT 'trip' AS entity, trip_id AS id, length(destination) BETWEEN 1 AND 120 AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND radius - 300 > 0 AND coalesce(kind = 'offgrid', true) AS valid FROM trips "
    "UNION ALL SELECT 'radius', trip_id, radius * 2 BETWEEN 1 AND 1000 FROM trips UNION ALL SELECT 'ledger', id, points + id % 29 BETWEEN 1 AND 100 AND reason IN ('task_completed', 'achievement', 'onboarding') FROM ledger "
    "UNION ALL SELECT 'category', task_id, length(category) BETWEEN 1 AND 80 AND coalesce(poi < 12, true) FROM tasks",
)
def flt10(d: Domain) -> DataFrame:
    """Whether trips, preferences of a radius, points and categories keep their rules: 1 to 1000 metres, 1 to 100 points, known reasons and kinds."""
    place = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    trip = F.length("destination").between(1, 120) & place & (F.col("radius") - 300 > 0) & F.coalesce(F.col("kind") == "offgrid", F.lit(True))
    trips = d.trips.select(F.lit("trip").alias("entity"), F.col("trip_id").alias("id"), trip.alias("valid"))
    radii = d.trips.select(F.lit("radius"), "trip_id", (F.col("radius") * 2).between(1, 1000))
    points = (F.col("points") + F.col("id") % 29).between(1, 100) & F.col("reason").isin("task_completed", "achievement", "onboarding")
    categories = d.tasks.select(F.lit("category"), "task_id", F.length("category").between(1, 80) & F.coalesce(F.col("poi") < 12, F.lit(True)))
    return trips.union(radii).union(d.ledger.select(F.lit("ledger"), "id", points)).union(categories)


@query("flt11_player_update", "SELECT challenge_id, entry, entry % 3 <> 0 AND completed % 5 >= 1 AND NOT (won AND completed % 2 = 1) AS allowed FROM players")
def flt11(d: Domain) -> DataFrame:
    before = F.struct((F.col("completed") - F.col("completed") % 5 + 1).alias("n"), F.col("won").alias("w"))
    after = F.struct(F.col("completed").alias("n"), (F.col("won") & (F.col("completed") % 2 == 0)).alias("w"))
    rows = d.players.select("challenge_id", "entry", before.alias("b"), after.alias("a"), (F.col("entry") % 3 != 0).alias("own"))
    return rows.select("challenge_id", "entry", (F.col("own") & (F.col("a.n") >= F.col("b.n")) & (F.col("a.w") | ~F.col("b.w"))).alias("allowed"))


@query("flt12_username_valid", "SELECT uid, coalesce(regexp_full_match(name, '[a-z0-9_]{3,20}'), false) AS valid FROM (SELECT uid, CASE uid % 9 WHEN 1 THEN 'ab' WHEN 2 THEN repeat(username, 3) WHEN 3 THEN upper(username) ELSE username END AS name FROM users)")
def flt12(d: Domain) -> DataFrame:
    k = F.col("uid") % 9
    name = F.when(k == 1, "ab").when(k == 2, F.repeat("username", 3)).when(k == 3, F.upper("username")).otherwise(F.col("username"))
    return d.users.select("uid", F.coalesce(name.rlike("^[a-z0-9_]{3,20}$"), F.lit(False)).alias("valid"))


@query("flt13_rename_cooldown", f"SELECT uid, CASE WHEN renamed_s IS NULL OR {NOW} - created_s < 86400 THEN 0 ELSE CAST(greatest(0, ceil((renamed_s + 30 * 86400 - {NOW}) / 86400.0)) AS BIGINT) END AS days_left FROM users")
def flt13(d: Domain) -> DataFrame:
    left = F.greatest(F.lit(0), F.ceil((F.col("renamed_s") + 30 * DAY - NOW) / DAY)).cast("long")
    return d.users.select("uid", F.when(F.col("renamed_s").isNull() | (NOW - F.col("created_s") < DAY), F.lit(0).cast("long")).otherwise(left).alias("days_left"))


@query("flt14_share_allowed", "SELECT p.challenge_id, p.uid, EXISTS (SELECT 1 FROM follows f WHERE (f.follower = p.uid AND f.followed = p.challenge_id) OR (f.followed = p.uid AND f.follower = p.challenge_id)) AS allowed FROM (SELECT DISTINCT challenge_id, uid FROM players) p")
def flt14(d: Domain) -> DataFrame:
    edges = d.follows.select(F.col("follower").alias("uid"), F.col("followed").alias("challenge_id")).union(d.follows.select("followed", "follower")).distinct().withColumn("hit", F.lit(True))
    return d.players.select("challenge_id", "uid").distinct().join(edges, ["uid", "challenge_id"], "left").select("challenge_id", "uid", F.coalesce("hit", F.lit(False)).alias("allowed"))


@query("flt15_friend_filter", "SELECT uid FROM users WHERE contains(lower(display_name), '00001') OR contains(lower(coalesce(username, '')), '_12')")
def flt15(d: Domain) -> DataFrame:
    return d.users.where(F.contains(F.lower("display_name"), F.lit("00001")) | F.contains(F.lower(F.coalesce("username", F.lit(""))), F.lit("_12"))).select("uid")


@query("flt16_low_battery", "SELECT uid, uid % 2 = 0 AND battery < 0.2 AS paused FROM users")
def flt16(d: Domain) -> DataFrame:
    return d.users.select("uid", ((F.col("uid") % 2 == 0) & (F.col("battery") < 0.2)).alias("paused"))


@query("flt17_reviewable", "SELECT uid, sentence, length(trim(sentence)) >= 4 AND regexp_matches(sentence, '[a-zA-ZÀ-ÿ]') AS reviewable FROM misses")
def flt17(d: Domain) -> DataFrame:
    return d.misses.select("uid", "sentence", ((F.length(F.trim("sentence")) >= 4) & F.col("sentence").rlike("[a-zA-ZÀ-ÿ]")).alias("reviewable"))


@query("flt18_invitation_cap", "SELECT uid, id FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY at_s, id) AS rn FROM inbox WHERE kind = 'system') WHERE rn <= 3")
def flt18(d: Domain) -> DataFrame:
    return d.inbox.where("kind = 'system'").selectExpr("uid", "id", "row_number() over (partition by uid order by at_s, id) as rn").where("rn <= 3").select("uid", "id")


@query("flt19_offline_coverage", "SELECT uid, CASE WHEN uid % 3 = 0 OR coalesce(uid % 5 = 0, false) THEN uid % 4 = 0 END AS covered FROM users")
def flt19(d: Domain) -> DataFrame:
    offline = (F.col("uid") % 3 == 0) | F.coalesce(F.col("uid") % 5 == 0, F.lit(False))
    return d.users.select("uid", F.when(offline, F.col("uid") % 4 == 0).alias("covered"))


@query("flt20_any_cached", "SELECT poi, count(*) > 0 AS cached FROM places WHERE area IS NOT NULL GROUP BY poi")
def flt20(d: Domain) -> DataFrame:
    return d.places.where("area is not null").groupBy("poi").agg((F.count("*") > 0).alias("cached"))


@query("flt21_form_valid", "SELECT task_id, length(trim(title)) > 0 AND (kind IS NOT DISTINCT FROM 'birthday' OR poi IS NOT NULL) AS valid, coalesce(visited, poi, seq) AS effective FROM tasks")
def flt21(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", ((F.length(F.trim("title")) > 0) & (F.col("kind").eqNullSafe("birthday") | F.col("poi").isNotNull())).alias("valid"), F.coalesce("visited", "poi", "seq").alias("effective"))


@query("prj1_defaults", "SELECT uid, coalesce(friend_nudges, true) AS friend_nudges, coalesce(nudged_s, 0) AS nudged_s FROM users")
def prj1(d: Domain) -> DataFrame:
    return d.users.select("uid", F.coalesce("friend_nudges", F.lit(True)).alias("friend_nudges"), F.coalesce("nudged_s", F.lit(0)).alias("nudged_s"))


@query("prj2_fence_radius", "SELECT place_id, CASE WHEN place_id % 6 = 0 THEN 200 WHEN poi < 8 THEN 50 + poi * 10 ELSE 75 END AS radius FROM places")
def prj2(d: Domain) -> DataFrame:
    saved = d.places.where("place_id % 6 = 0").select("place_id", F.lit(200).cast("long").alias("saved"))
    usual = d.spark.range(8).select(F.col("id").alias("poi"), (50 + F.col("id") * 10).alias("usual"))
    return d.places.join(saved, "place_id", "left").join(F.broadcast(usual), "poi", "left").select("place_id", F.coalesce("saved", "usual", F.lit(75).cast("long")).alias("radius"))


@query("prj3_handle", "SELECT uid, CASE WHEN username IS NOT NULL THEN concat('@', username) WHEN display_name <> '' THEN display_name ELSE 'Someone' END AS handle FROM users")
def prj3(d: Domain) -> DataFrame:
    return d.users.select("uid", F.coalesce(F.concat(F.lit("@"), F.col("username")), F.nullif("display_name", F.lit("")), F.lit("Someone")).alias("handle"))


@query("prj4_import_kind", "SELECT id, CASE kind WHEN 'follow' THEN 'personal' WHEN 'share' THEN 'errands' ELSE 'work' END AS category FROM inbox")
def prj4(d: Domain) -> DataFrame:
    k = F.col("kind")
    return d.inbox.select("id", F.when(k == "follow", "personal").when(k == "share", "errands").otherwise("work").alias("category"))


@query("prj5_category_label", "SELECT task_id, CASE category WHEN 'errands' THEN 'Errands' WHEN 'work' THEN 'Work' WHEN 'health' THEN 'Health' WHEN 'personal' THEN 'Personal' WHEN 'c1' THEN 'Mine 1' WHEN 'c2' THEN 'Mine 2' ELSE 'Other' END AS label FROM tasks")
def prj5(d: Domain) -> DataFrame:
    built_in = d.spark.createDataFrame([(c, c.title()) for c in ("errands", "work", "health", "personal")], "category string, built_in string")
    custom = d.spark.createDataFrame([("c1", "Mine 1"), ("c2", "Mine 2")], "category string, custom string")
    rows = d.tasks.join(F.broadcast(built_in), "category", "left").join(F.broadcast(custom), "category", "left")
    return rows.select("task_id", F.coalesce("built_in", "custom", F.lit("Other")).alias("label"))


@query("prj6_place_type", "SELECT task_id, CASE WHEN category NOT LIKE 'c%' THEN category END AS place_type FROM tasks")
def prj6(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.when(~F.col("category").like("c%"), F.col("category")).alias("place_type"))


@query("prj7_day_state", f"SELECT uid, day, CAST(floor(100.0 * n_done / n + 0.5) AS BIGINT) AS pct, CASE WHEN day = DATE '{TODAY}' THEN 'today' WHEN day > DATE '{TODAY}' THEN 'future' WHEN n_done = n THEN 'complete' WHEN n_done = 0 THEN 'zero' ELSE 'past' END AS state FROM (SELECT uid, day, count(*) AS n, count(*) FILTER (done) AS n_done FROM tasks GROUP BY uid, day)")
def prj7(d: Domain) -> DataFrame:
    days = d.tasks.groupBy("uid", "day").agg(F.count("*").alias("n"), F.count_if("done").alias("n_done"))
    today = F.lit(TODAY).cast("date")
    state = F.when(F.col("day") == today, "today").when(F.col("day") > today, "future").when(F.col("n") == F.col("n_done"), "complete").when(F.col("n_done") == 0, "zero").otherwise("past")
    return days.select("uid", "day", F.floor(100.0 * F.col("n_done") / F.col("n") + 0.5).alias("pct"), state.alias("state"))


@query("prj8_points_shown", "SELECT id, CASE WHEN reason = 'achievement' THEN points * (1 + id % 3) ELSE points END AS shown, CASE reason WHEN 'task_completed' THEN 'Task done' WHEN 'achievement' THEN 'Achievement' WHEN 'onboarding' THEN 'Welcome' ELSE 'Challenge' END AS label FROM ledger")
def prj8(d: Domain) -> DataFrame:
    r = F.col("reason")
    label = F.when(r == "task_completed", "Task done").when(r == "achievement", "Achievement").when(r == "onboarding", "Welcome").otherwise("Challenge")
    return d.ledger.select("id", F.when(r == "achievement", F.col("points") * (1 + F.col("id") % 3)).otherwise(F.col("points")).alias("shown"), label.alias("label"))


@query("prj9_icon_family", "SELECT p_partkey AS place_id, CASE WHEN p_type = 'PROMO' THEN 'tag' WHEN p_type LIKE '%STEEL' THEN 'bolt' WHEN p_type LIKE '%A%' THEN 'leaf' ELSE 'pin' END AS icon FROM part")
def prj9(d: Domain) -> DataFrame:
    t = F.col("p_type")
    return d.raw("part").select(F.col("p_partkey").alias("place_id"), F.when(t == "PROMO", "tag").when(t.endswith("STEEL"), "bolt").when(t.contains("A"), "leaf").otherwise("pin").alias("icon"))


@query("snk5_watch_payload", "SELECT uid, CAST(count(*) AS BIGINT) AS n FROM tasks WHERE NOT done GROUP BY uid")
def snk5(d: Domain) -> DataFrame:
    sent = d.tasks.where("not done").groupBy("uid").agg(F.to_json(F.sort_array(F.collect_list(F.struct("task_id", "title", "poi", "hhmm")))).alias("payload"))
    return sent.select("uid", F.json_array_length("payload").cast("long").alias("n"))


@query("snk6_watch_reader", "SELECT task_id, coalesce(hhmm, '--:--') AS hhmm, false AS pending FROM tasks WHERE NOT done")
def snk6(d: Domain) -> DataFrame:
    sent = d.tasks.where("not done").groupBy("uid").agg(F.to_json(F.collect_list(F.struct("task_id", "hhmm"))).alias("payload"))
    read = sent.select(F.explode(F.from_json("payload", "array<struct<task_id:bigint,hhmm:string,pending:boolean>>")).alias("t"))
    return read.select("t.task_id", F.coalesce("t.hhmm", F.lit("--:--")).alias("hhmm"), F.coalesce("t.pending", F.lit(False)).alias("pending"))


@query("snk8_backfill", "SELECT uid, coalesce(username, nullif(display_name, '')) AS username FROM users")
def snk8(d: Domain) -> DataFrame:
    return d.users.select("uid", F.coalesce("username", F.nullif("display_name", F.lit(""))).alias("username"))


@query("snk9_stamp_seen", f"SELECT task_id, CASE WHEN task_id % 9 = 0 THEN DATE '{TODAY}' END AS seen FROM tasks")
def snk9(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.when(F.col("task_id") % 9 == 0, F.lit(TODAY).cast("date")).alias("seen"))
