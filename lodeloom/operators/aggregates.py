"""Aggregations and set operations over tasks, ledgers, places, challenges and follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.binding import NOW, TODAY, Domain, query
from lodeloom.plans.numbering import numbered

DAY = 86400
# Points of each achievement kind, by number.
POINTS = (10, 15, 20, 25, 30, 5, 40, 50, 10, 20, 60)


@query("agg1_day_stats", "SELECT uid, coalesce(origin_day, day) AS day, count(*) AS total, count(*) FILTER (done) AS done FROM tasks GROUP BY ALL")
def agg1(d: Domain) -> DataFrame:
    return d.tasks.groupBy("uid", F.coalesce("origin_day", "day").alias("day")).agg(F.count("*").alias("total"), F.count_if("done").alias("done"))


@query("agg2_today_progress", "SELECT uid, count(*) AS total, count(*) FILTER (done) AS n_done, round(count(*) FILTER (done) / count(*), 6) AS ratio, CAST(floor(100.0 * count(*) FILTER (done) / count(*) + 0.5) AS BIGINT) AS pct, count(poi) AS nearby FROM tasks WHERE kind IS NULL GROUP BY uid")
def agg2(d: Domain) -> DataFrame:
    n, k = F.count("*"), F.count_if("done")
    return d.tasks.where(~F.col("kind").eqNullSafe("birthday")).groupBy("uid").agg(n.alias("total"), k.alias("n_done"), F.round(k / n, 6).alias("ratio"), F.floor(100.0 * k / n + 0.5).alias("pct"), F.count("poi").alias("nearby"))


@query("agg3_week_count", "SELECT uid, count(*) AS n FROM tasks WHERE completed_s // 86400 BETWEEN 19737 AND 19743 GROUP BY uid")
def agg3(d: Domain) -> DataFrame:
    week = F.date_trunc("week", F.timestamp_seconds("completed_s")) == F.date_trunc("week", F.timestamp_seconds(F.lit(NOW)))
    return d.tasks.where(week).groupBy("uid").agg(F.count("*").alias("n"))


@query("agg4_visit_tally", "SELECT uid, visited AS place_id, count(*) AS visits, arg_min(title, task_id) AS first_title FROM tasks WHERE visited IS NOT NULL GROUP BY ALL")
def agg4(d: Domain) -> DataFrame:
    return d.tasks.where("visited is not null").groupBy("uid", F.col("visited").alias("place_id")).agg(F.count("*").alias("visits"), F.min_by("title", "task_id").alias("first_title"))


@query("agg5_counter_merge", "SELECT uid, place_id, greatest(coalesce(t.n, 0), coalesce(e.n, 0)) AS visits FROM (SELECT uid, visited AS place_id, count(*) AS n FROM tasks WHERE visited IS NOT NULL GROUP BY ALL) t FULL JOIN (SELECT uid, poi AS place_id, count(*) AS n FROM tasks WHERE poi < 6 GROUP BY ALL) e USING (uid, place_id)")
def agg5(d: Domain) -> DataFrame:
    tally = d.tasks.where("visited is not null").groupBy("uid", F.col("visited").alias("place_id")).agg(F.count("*").alias("t"))
    existing = d.tasks.where("poi < 6").groupBy("uid", F.col("poi").alias("place_id")).agg(F.count("*").alias("e"))
    zero = F.lit(0)
    return tally.join(existing, ["uid", "place_id"], "full_outer").select("uid", "place_id", F.greatest(F.coalesce("t", zero), F.coalesce("e", zero)).alias("visits"))


@query("agg6_net_visits", "SELECT uid, place_id, CAST(sum(delta) AS BIGINT) AS visits FROM (SELECT uid, visited AS place_id, 1 AS delta FROM tasks WHERE visited IS NOT NULL UNION ALL SELECT uid, poi, -1 FROM tasks WHERE done AND poi IS NOT NULL AND task_id % 4 = 0) GROUP BY ALL HAVING sum(delta) > 0")
def agg6(d: Domain) -> DataFrame:
    up = d.tasks.where("visited is not null").select("uid", F.col("visited").alias("place_id"), F.lit(1).alias("delta"))
    down = d.tasks.where("done and poi is not null and task_id % 4 = 0").select("uid", "poi", F.lit(-1))
    return up.union(down).groupBy("uid", "place_id").agg(F.sum("delta").alias("visits")).where("visits > 0")


@query("agg7_points_recompute", f"SELECT uid, CAST(sum(p.points * n) AS BIGINT) AS total FROM (SELECT uid, id % 11 AS kind, count(*) AS n FROM ledger WHERE reason = 'achievement' GROUP BY ALL) JOIN (SELECT unnest(range(11)) AS kind, unnest({list(POINTS)}) AS points) p USING (kind) GROUP BY uid")
def agg7(d: Domain) -> DataFrame:
    worth = d.spark.createDataFrame(list(enumerate(POINTS)), "kind long, worth long")
    earned = d.ledger.where("reason = 'achievement'").groupBy("uid", (F.col("id") % 11).alias("kind")).agg(F.count("*").alias("n"))
    return earned.join(F.broadcast(worth), "kind").groupBy("uid").agg(F.sum(F.col("worth") * F.col("n")).alias("total"))


@query("agg8_all_done", "SELECT uid, day, bool_and(done) AS all_done, count(*) FILTER (NOT done) AS remaining FROM tasks WHERE kind IS NULL GROUP BY ALL")
def agg8(d: Domain) -> DataFrame:
    return d.tasks.where(~F.col("kind").eqNullSafe("birthday")).groupBy("uid", "day").agg(F.every("done").alias("all_done"), F.count_if(~F.col("done")).alias("remaining"))


@query("agg9_completed_types", "SELECT uid, count(DISTINCT poi) AS n, array_to_string(list_sort(list_distinct(list(poi))), ',') AS types FROM tasks WHERE done AND poi IS NOT NULL GROUP BY uid")
def agg9(d: Domain) -> DataFrame:
    kinds = F.collect_set("poi")
    return d.tasks.where("done and poi is not null").groupBy("uid").agg(F.size(kinds).cast("long").alias("n"), F.array_join(F.sort_array(kinds), ",").alias("types"))


#: Tasks done within so many seconds up to now that make a burst.
BURST, BURST_SECONDS = 3, 1800
_TRIGGERS = f"SELECT uid, bool_and(done) AS full_list, NOT bool_and(done) AND count(*) FILTER (done AND completed_s >= {NOW} - {BURST_SECONDS}) >= {BURST} AS burst FROM completions WHERE day = DATE '{TODAY}' GROUP BY uid"


def friend_triggers(tasks: DataFrame, today: str = TODAY, now: int = NOW) -> DataFrame:
    """uid, full_list, burst of users with tasks today: whether all are done, or else three or more of them in the last half hour."""
    recent = F.col("done") & (F.col("completed_s") >= now - BURST_SECONDS)
    by_user = tasks.where(F.col("day") == F.lit(today).cast("date")).groupBy("uid").agg(F.every("done").alias("full_list"), F.count_if(recent).alias("n"))
    return by_user.select("uid", "full_list", (~F.col("full_list") & (F.col("n") >= BURST)).alias("burst"))


@query("agg10_friend_trigger", _TRIGGERS)
def agg10(d: Domain) -> DataFrame:
    return friend_triggers(d.completions)


_NORM = "regexp_replace(lower(trim(sentence)), '\\s+', ' ', 'g')"


@query("agg11_miss_sweep", f"SELECT norm, n, place FROM (SELECT norm, n, row_number() OVER (ORDER BY n DESC, norm) AS place FROM (SELECT {_NORM} AS norm, count(*) AS n FROM misses WHERE length({_NORM}) >= 4 AND regexp_matches({_NORM}, '[a-zA-ZÀ-ÿ]') GROUP BY ALL)) WHERE place <= 50")
def agg11(d: Domain) -> DataFrame:
    norm = d.misses.select(F.regexp_replace(F.lower(F.trim("sentence")), r"\s+", " ").alias("norm")).where((F.length("norm") >= 4) & F.col("norm").rlike("[a-zA-ZÀ-ÿ]"))
    top = norm.groupBy("norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "norm").limit(50)
    return top.selectExpr("norm", "n", "cast(row_number() over (order by n desc, norm) as bigint) as place")


@query("agg12_unread_badge", "SELECT uid, CAST(unread + coalesce(pending, 0) AS BIGINT) AS badge FROM (SELECT uid, count(*) FILTER (unread) AS unread FROM inbox GROUP BY uid) LEFT JOIN (SELECT uid, count(*) AS pending FROM players WHERE joined = 'pending' GROUP BY uid) USING (uid)")
def agg12(d: Domain) -> DataFrame:
    unread = d.inbox.groupBy("uid").agg(F.count_if("unread").alias("unread"))
    pending = d.players.where("joined = 'pending'").groupBy("uid").agg(F.count("*").alias("pending"))
    return unread.join(pending, "uid", "left").select("uid", (F.col("unread") + F.coalesce("pending", F.lit(0))).alias("badge"))


@query("agg13_offgrid_done", "SELECT trip_id, count(completed_s) AS n FROM (SELECT * FROM trips WHERE kind = 'offgrid') t LEFT JOIN (SELECT uid, completed_s FROM tasks WHERE done) c ON c.uid = t.uid AND completed_s BETWEEN t.created_s AND t.expires_s GROUP BY trip_id")
def agg13(d: Domain) -> DataFrame:
    trips, done = d.trips.where("kind = 'offgrid'").select("trip_id", "uid", "created_s", "expires_s"), d.tasks.where("done").select("uid", "completed_s")
    met = trips.join(done, (trips.uid == done.uid) & done.completed_s.between(trips.created_s, trips.expires_s), "left")
    return met.groupBy("trip_id").agg(F.count("completed_s").alias("n"))


@query("agg14_cache_bytes", "SELECT poi, count(*) * 200 AS bytes FROM places WHERE area IS NULL GROUP BY poi")
def agg14(d: Domain) -> DataFrame:
    return d.places.where("area is null").groupBy("poi").agg((F.count("*") * 200).alias("bytes"))


@query("agg15_last_sighting", "SELECT poi, max(matched_s) AS latest FROM places WHERE area IS NULL GROUP BY poi")
def agg15(d: Domain) -> DataFrame:
    return d.places.where("area is null").groupBy("poi").agg(F.max("matched_s").alias("latest"))


@query("agg16_degrees", "SELECT uid, coalesce(i.n, 0) AS followers, coalesce(o.n, 0) AS following FROM users LEFT JOIN (SELECT followed AS uid, count(*) AS n FROM follows GROUP BY ALL) i USING (uid) LEFT JOIN (SELECT follower AS uid, count(*) AS n FROM follows GROUP BY ALL) o USING (uid)")
def agg16(d: Domain) -> DataFrame:
    into, out = (d.follows.groupBy(F.col(c).alias("uid")).agg(F.count("*").alias(n)) for c, n in (("followed", "followers"), ("follower", "following")))
    return d.users.select("uid").join(into, "uid", "left").join(out, "uid", "left").na.fill(0)


@query(
    "agg19_trips_by_year",
    "SELECT year(ended) AS year, trip_id, row_number() OVER (PARTITION BY year(ended) ORDER BY ended DESC, trip_id DESC) AS place, count(*) OVER (PARTITION BY year(ended)) AS n "
    "FROM (SELECT trip_id, end_day + CAST(trip_id % 3 * 366 AS INTEGER) AS ended FROM trips WHERE end_day IS NOT NULL)",
)
def agg19(d: Domain) -> DataFrame:
    """Trips of each year with their place, the last to end first, and how many there are. They are numbered by the days they end on."""
    ended = d.trips.where("end_day is not null").selectExpr("trip_id", "end_day + cast(trip_id % 3 * 366 as int) as ended").withColumn("year", F.year("ended").cast("long"))
    placed = numbered(ended, -F.unix_date("ended"), [F.desc("trip_id")], ["year"], "place")
    return placed.join(ended.groupBy("year").agg(F.count("*").alias("n")), "year").select("year", "trip_id", (F.col("place") + 1).alias("place"), "n")


@query("agg20_earned_locked", "SELECT uid, count(*) FILTER (n IS NOT NULL) AS earned, count(*) FILTER (n IS NULL) AS locked FROM (SELECT DISTINCT uid FROM ledger) u CROSS JOIN (SELECT unnest(range(7)) AS kind) k LEFT JOIN (SELECT uid, id % 11 AS kind, count(*) AS n FROM ledger WHERE reason = 'achievement' GROUP BY ALL) e USING (uid, kind) GROUP BY uid")
def agg20(d: Domain) -> DataFrame:
    shown = d.ledger.select("uid").distinct().withColumn("kind", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    earned = d.ledger.where("reason = 'achievement'").groupBy("uid", (F.col("id") % 11).alias("kind")).agg(F.count("*").alias("n"))
    both = shown.join(earned, ["uid", "kind"], "left")
    return both.groupBy("uid").agg(F.count("n").alias("earned"), F.count_if(F.col("n").isNull()).alias("locked"))


@query("agg21_import_outcome", "SELECT uid, count(*) FILTER (id % 4 = 0) AS imported, count(*) FILTER (id % 4 = 1) AS skipped, count(*) FILTER (id % 4 = 2) AS failed FROM inbox GROUP BY uid")
def agg21(d: Domain) -> DataFrame:
    outcome = F.when(F.col("id") % 4 == 0, "imported").when(F.col("id") % 4 == 1, "skipped").when(F.col("id") % 4 == 2, "failed").otherwise("cancelled")
    names = ["imported", "skipped", "failed"]
    return d.inbox.withColumn("outcome", outcome).groupBy("uid").pivot("outcome", names).count().na.fill(0, names)


@query("agg22_job_summary", "SELECT CASE WHEN nudged_s IS NULL THEN 'skipped' WHEN churned THEN 'failed' ELSE 'sent' END AS outcome, count(*) AS n FROM users GROUP BY ALL")
def agg22(d: Domain) -> DataFrame:
    return d.users.groupBy(F.when(F.col("nudged_s").isNull(), "skipped").when(F.col("churned"), "failed").otherwise("sent").alias("outcome")).agg(F.count("*").alias("n"))


@query("agg23_vocabulary", "SELECT token, n, place + 1 AS id FROM (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS place FROM (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(trim(title)), ' ')) AS token FROM tasks) WHERE token <> '' GROUP BY token)) WHERE place <= 4998")
def agg23(d: Domain) -> DataFrame:
    words = d.tasks.select(F.explode(F.split(F.lower(F.trim("title")), " ")).alias("token")).where("token <> ''")
    top = words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(4998)
    return top.selectExpr("token", "n", "cast(row_number() over (order by n desc, token) + 1 as bigint) as id")


@query("agg24_challenge_state", "SELECT challenge_id, CASE WHEN bool_and(joined = 'declined' OR uid % 10 = 0) THEN 'completed' WHEN bool_and(joined <> 'pending') THEN 'active' ELSE 'pending' END AS state FROM players GROUP BY challenge_id")
def agg24(d: Domain) -> DataFrame:
    gone = F.every((F.col("joined") == "declined") | (F.col("uid") % 10 == 0))
    return d.players.groupBy("challenge_id").agg(F.when(gone, "completed").when(F.every(F.col("joined") != "pending"), "active").otherwise("pending").alias("state"))


@query("agg25_day_counts", "SELECT uid, day, count(*) FILTER (NOT done AND poi IS NOT NULL) AS open_poi, count(*) FILTER (done) AS n_done FROM tasks GROUP BY ALL")
def agg25(d: Domain) -> DataFrame:
    return d.tasks.groupBy("uid", "day").agg(F.count_if(~F.col("done") & F.col("poi").isNotNull()).alias("open_poi"), F.count_if("done").alias("n_done"))


@query("agg26_times_earned", "SELECT uid, id % 11 AS kind, count(*) AS times FROM ledger WHERE reason = 'achievement' GROUP BY ALL")
def agg26(d: Domain) -> DataFrame:
    times = d.ledger.where("reason = 'achievement'").groupBy("uid", (F.col("id") % 11).alias("kind")).agg(F.count("*").alias("times"))
    maps = times.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("kind", "times"))).alias("m"))
    return maps.select("uid", F.explode("m").alias("kind", "times"))


@query("set1_type_union", "SELECT poi FROM tasks WHERE poi IS NOT NULL UNION SELECT poi + 4 FROM places WHERE area IS NOT NULL")
def set1(d: Domain) -> DataFrame:
    return d.tasks.where("poi is not null").select("poi").union(d.places.where("area is not null").selectExpr("poi + 4")).distinct()


@query("set2_last_wins", "SELECT task_id, CASE WHEN origin_day IS NOT NULL THEN 'origin' ELSE 'day' END AS source FROM tasks WHERE day < DATE '2024-01-10' OR origin_day IS NOT NULL")
def set2(d: Domain) -> DataFrame:
    a = d.tasks.where("day < date '2024-01-10'").select("task_id", F.lit(1).alias("turn"), F.lit("day").alias("source"))
    b = d.tasks.where("origin_day is not null").select("task_id", F.lit(2).alias("turn"), F.lit("origin").alias("source"))
    return a.union(b).groupBy("task_id").agg(F.max_by("source", "turn").alias("source"))


@query("set3_layers", "SELECT phrase, min(layer) AS layer FROM (SELECT DISTINCT category AS phrase, 2 AS layer FROM tasks UNION ALL SELECT DISTINCT reason, 1 FROM ledger UNION ALL SELECT 'work', 0) GROUP BY phrase")
def set3(d: Domain) -> DataFrame:
    layers = (d.spark.createDataFrame([("work",)], "phrase string"), d.ledger.select(F.col("reason").alias("phrase")).distinct(), d.tasks.select(F.col("category").alias("phrase")).distinct())
    first, *rest = (x.withColumn("layer", F.lit(i)) for i, x in enumerate(layers))
    for x in rest:
        first = first.unionByName(x)
    return first.groupBy("phrase").agg(F.min("layer").alias("layer"))


@query("set4_stale_types", f"SELECT DISTINCT poi FROM places EXCEPT SELECT poi FROM places WHERE fetched_s >= {NOW} - 3 * 86400 AND osm")
def set4(d: Domain) -> DataFrame:
    return d.places.select("poi").distinct().exceptAll(d.places.where((F.col("fetched_s") >= NOW - 3 * DAY) & F.col("osm")).select("poi").distinct())


@query("set5_completed_union", "SELECT uid, count(DISTINCT poi) AS n FROM (SELECT uid, poi FROM tasks WHERE done AND poi IS NOT NULL UNION ALL SELECT uid, visited FROM tasks WHERE visited IS NOT NULL) GROUP BY uid")
def set5(d: Domain) -> DataFrame:
    sets = d.tasks.groupBy("uid").agg(F.collect_set(F.when(F.col("done"), F.col("poi"))).alias("a"), F.collect_set("visited").alias("b"))
    return sets.select("uid", F.size(F.array_union("a", "b")).cast("long").alias("n")).where("n > 0")


@query("set6_contact_values", "SELECT DISTINCT lower(trim(email)) AS contact FROM users UNION SELECT DISTINCT username FROM users WHERE username IS NOT NULL")
def set6(d: Domain) -> DataFrame:
    return d.users.select(F.explode(F.array(F.lower(F.trim("email")), "username")).alias("contact")).where("contact is not null").distinct()
