"""Windows, rankings and top-k: runs of days, ledgers, rate limits, winners, heroes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.binding import TODAY, Domain, query
from lodeloom.functions.geo import duck_haversine, haversine

_COMPLETE = "SELECT uid, coalesce(origin_day, day) AS d FROM tasks GROUP BY ALL HAVING bool_and(done)"


def complete_days(d: Domain) -> DataFrame:
    return d.tasks.groupBy("uid", F.coalesce("origin_day", "day").alias("d")).agg(F.every("done").alias("ok")).where("ok").select("uid", "d")


@query("win1_day_runs", f"SELECT uid, d AS day, count(*) OVER (PARTITION BY uid, date_trunc('month', d), isle) AS run FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY uid, date_trunc('month', d) ORDER BY d) AS INTEGER) AS isle FROM ({_COMPLETE}))")
def win1(d: Domain) -> DataFrame:
    days = complete_days(d).withColumn("month", F.trunc("d", "month"))
    isles = days.withColumn("isle", F.date_sub("d", F.row_number().over(Window.partitionBy("uid", "month").orderBy("d"))))
    return isles.select("uid", F.col("d").alias("day"), F.count("*").over(Window.partitionBy("uid", "month", "isle")).alias("run"))


_TO_HOME = duck_haversine("lat", "lng", "38.72", "-9.14")


@query("win2_top5_per_type", f"SELECT poi, place_id, rn FROM (SELECT poi, place_id, row_number() OVER (PARTITION BY poi ORDER BY round({_TO_HOME}, 3), place_id) AS rn FROM places) WHERE rn <= 5")
def win2(d: Domain) -> DataFrame:
    m = F.round(haversine(F.col("lat"), F.col("lng"), F.lit(38.72), F.lit(-9.14)), 3)
    return d.places.withColumn("rn", F.row_number().over(Window.partitionBy("poi").orderBy(m, "place_id")).cast("long")).where("rn <= 5").select("poi", "place_id", "rn")


@query("win4_best_learned", "SELECT uid, poi, place_id, visits FROM (SELECT *, row_number() OVER (PARTITION BY uid, poi ORDER BY visits DESC, place_id) AS rn FROM (SELECT uid, visited % 4 AS poi, visited AS place_id, count(*) AS visits FROM tasks WHERE visited IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)) WHERE rn = 1")
def win4(d: Domain) -> DataFrame:
    visits = d.tasks.where("visited is not null").groupBy("uid", (F.col("visited") % 4).alias("poi"), F.col("visited").alias("place_id")).agg(F.count("*").alias("visits")).where("visits >= 2")
    best = visits.groupBy("uid", "poi").agg(F.max_by(F.struct("place_id", "visits"), F.struct("visits", -F.col("place_id"))).alias("b"))
    return best.select("uid", "poi", "b.*")


@query("win5_ledger_dedup", "SELECT uid, id FROM (SELECT *, row_number() OVER (PARTITION BY uid, task_id, reason ORDER BY at_s DESC, id DESC) AS rn FROM ledger) WHERE reason <> 'task_completed' OR rn = 1")
def win5(d: Domain) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("uid", "task_id", "reason").orderBy(F.desc("at_s"), F.desc("id")))
    return d.ledger.withColumn("rn", newest).where("reason <> 'task_completed' or rn = 1").select("uid", "id")


@query("win6_tier_crossing", "SELECT uid, id, total, CAST(len(list_filter([0, 50, 200, 500, 1200, 3000], lambda t: t <= total)) - 1 AS INTEGER) AS tier FROM (SELECT uid, id, CAST(sum(points) OVER (PARTITION BY uid ORDER BY at_s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM ledger)")
def win6(d: Domain) -> DataFrame:
    so_far = Window.partitionBy("uid").orderBy("at_s", "id").rowsBetween(Window.unboundedPreceding, 0)
    steps = F.array(*(F.lit(t) for t in (0, 50, 200, 500, 1200, 3000)))
    return d.ledger.select("uid", "id", F.sum("points").over(so_far).alias("total")).withColumn("tier", F.size(F.filter(steps, lambda t: t <= F.col("total"))) - 1)


@query("win7_accuracy_window", "SELECT fix_id, n, round(bad / n, 6) AS ratio, n >= 3 AND bad / n >= 0.7 AS degraded FROM (SELECT fix_id, count(*) OVER w AS n, count(*) FILTER (accuracy > 50) OVER w AS bad FROM ticks WINDOW w AS (PARTITION BY uid ORDER BY at_s RANGE BETWEEN 30 PRECEDING AND CURRENT ROW))")
def win7(d: Domain) -> DataFrame:
    """The share of poor readings in the last 30 seconds; with three readings or more it may be degraded."""
    w = Window.partitionBy("uid").orderBy("at_s").rangeBetween(-30, 0)
    rows = d.ticks.select("fix_id", F.count("*").over(w).alias("n"), F.count_if(F.col("accuracy") > 50).over(w).alias("bad"))
    share = F.col("bad") / F.col("n")
    return rows.select("fix_id", "n", F.round(share, 6).alias("ratio"), ((F.col("n") >= 3) & (share >= 0.7)).alias("degraded"))


@query("win8_debounce", "SELECT uid, fix_id, at_s - min(at_s) OVER (PARTITION BY uid, isle) >= 15 AS held FROM (SELECT *, sum(CASE WHEN bad = was THEN 0 ELSE 1 END) OVER (PARTITION BY uid ORDER BY at_s, fix_id ROWS UNBOUNDED PRECEDING) AS isle FROM (SELECT uid, fix_id, at_s, accuracy > 50 AS bad, coalesce(lag(accuracy > 50) OVER (PARTITION BY uid ORDER BY at_s, fix_id), accuracy <= 50) AS was FROM ticks))")
def win8(d: Domain) -> DataFrame:
    order = Window.partitionBy("uid").orderBy("at_s", "fix_id")
    bad = F.col("accuracy") > 50
    turns = d.ticks.withColumn("turn", (~F.lag(bad).over(order).eqNullSafe(bad)).cast("int"))
    isles = turns.withColumn("isle", F.sum("turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.select("uid", "fix_id", (F.col("at_s") - F.min("at_s").over(Window.partitionBy("uid", "isle")) >= 15).alias("held"))


@query("win10_session_count", "SELECT task_id, count(*) OVER (PARTITION BY uid ORDER BY completed_s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS n FROM completions WHERE done")
def win10(d: Domain) -> DataFrame:
    """How many tasks a user did in the half hour up to each completion."""
    return d.completions.where("done").select("task_id", F.count("*").over(Window.partitionBy("uid").orderBy("completed_s").rangeBetween(-1800, 0)).alias("n"))


@query("win12_pair_cooldown", "SELECT uid, id, coalesce(at_s - lag(at_s) OVER (PARTITION BY uid, kind ORDER BY at_s, id) >= 86400, true) AS allowed FROM inbox")
def win12(d: Domain) -> DataFrame:
    before = F.lag("at_s").over(Window.partitionBy("uid", "kind").orderBy("at_s", "id"))
    return d.inbox.select("uid", "id", F.coalesce(F.col("at_s") - before >= 86400, F.lit(True)).alias("allowed"))


@query("win13_daily_alert", "SELECT uid, kind, at_s // 86400 AS day_no, min(id) AS id FROM inbox GROUP BY ALL")
def win13(d: Domain) -> DataFrame:
    return d.inbox.groupBy("uid", "kind", F.expr("at_s div 86400").alias("day_no")).agg(F.min("id").alias("id"))


@query("win14_lru_eviction", "SELECT place_id FROM places WHERE area IS NOT NULL UNION ALL (SELECT place_id FROM places WHERE area IS NULL ORDER BY matched_s DESC, place_id DESC LIMIT 2000)")
def win14(d: Domain, most: int = 2000) -> DataFrame:
    """Places of areas stay; of all others the most that were met last."""
    ambient = d.places.where("area is null").orderBy(F.desc("matched_s"), F.desc("place_id")).limit(most)
    return d.places.where("area is not null").select("place_id").union(ambient.select("place_id"))


@query("win16_day_marker", "SELECT uid, at_s // 86400 AS day_no, max(id % 11) AS marker FROM ledger WHERE reason = 'achievement' GROUP BY ALL")
def win16(d: Domain) -> DataFrame:
    kind = F.col("id") % 11
    return d.ledger.where("reason = 'achievement'").groupBy("uid", F.expr("at_s div 86400").alias("day_no")).agg(F.max_by(kind, kind).alias("marker"))


@query("win17_streak", f"SELECT uid, max(run) AS longest, max(CASE WHEN last >= DATE '{TODAY}' - 10 THEN run END) AS recent FROM (SELECT uid, isle, count(*) AS run, max(d) AS last FROM (SELECT *, d - CAST(row_number() OVER (PARTITION BY uid ORDER BY d) AS INTEGER) AS isle FROM ({_COMPLETE})) GROUP BY uid, isle) GROUP BY uid")
def win17(d: Domain) -> DataFrame:
    isles = complete_days(d).withColumn("isle", F.date_sub("d", F.row_number().over(Window.partitionBy("uid").orderBy("d"))))
    runs = isles.groupBy("uid", "isle").agg(F.count("*").alias("run"), F.max("d").alias("last"))
    return runs.groupBy("uid").agg(F.max("run").alias("longest"), F.max(F.when(F.col("last") >= F.date_sub(F.lit(TODAY).cast("date"), 10), F.col("run"))).alias("recent"))


def ranked(df: DataFrame, by: list, *order, keep: list[str]) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).select(*keep, "place")


@query("top1_open_first", "SELECT uid, task_id, row_number() OVER (PARTITION BY uid ORDER BY done, created_s, task_id) AS place FROM tasks")
def top1(d: Domain) -> DataFrame:
    return ranked(d.tasks, ["uid"], "done", "created_s", "task_id", keep=["uid", "task_id"])


@query("top3_leaderboard", "SELECT challenge_id, entry, row_number() OVER (PARTITION BY challenge_id ORDER BY completed DESC, display_name, entry) AS place FROM players JOIN users USING (uid)")
def top3(d: Domain) -> DataFrame:
    named = d.players.join(d.users.select("uid", "display_name"), "uid")
    return ranked(named, ["challenge_id"], F.desc("completed"), "display_name", "entry", keep=["challenge_id", "entry"])


@query("top4_time_winner", "SELECT challenge_id, arg_max(uid, completed * 10000000 - entry) AS winner FROM players WHERE joined = 'accepted' GROUP BY challenge_id")
def top4(d: Domain) -> DataFrame:
    return d.players.where("joined = 'accepted'").groupBy("challenge_id").agg(F.max_by("uid", F.struct("completed", -F.col("entry"))).alias("winner"))


@query("top5_goal_winner", "SELECT challenge_id, uid FROM (SELECT *, row_number() OVER (PARTITION BY challenge_id ORDER BY at_s, entry) AS rn FROM (SELECT challenge_id, uid, entry, at_s, sum(completed) OVER (PARTITION BY challenge_id, uid ORDER BY at_s, entry ROWS UNBOUNDED PRECEDING) AS total FROM players) WHERE total >= 12) WHERE rn = 1")
def top5(d: Domain) -> DataFrame:
    so_far = Window.partitionBy("challenge_id", "uid").orderBy("at_s", "entry").rowsBetween(Window.unboundedPreceding, 0)
    reached = d.players.withColumn("total", F.sum("completed").over(so_far)).where("total >= 12")
    return reached.groupBy("challenge_id").agg(F.min_by("uid", F.struct("at_s", "entry")).alias("uid"))


@query("top6_next_event", f"SELECT uid, arg_min(task_id, CAST(day - DATE '2024-01-01' AS BIGINT) * 10000000 + task_id) AS task_id FROM tasks WHERE day BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 7 GROUP BY uid")
def top6(d: Domain) -> DataFrame:
    today = F.lit(TODAY).cast("date")
    return d.tasks.where(F.col("day").between(today, F.date_add(today, 7))).groupBy("uid").agg(F.min(F.struct("day", "task_id"))["task_id"].alias("task_id"))


@query("top9_carousel", "SELECT uid, poi, min(task_id) AS shown, count(*) - 1 AS grey FROM tasks WHERE NOT done AND poi IS NOT NULL GROUP BY ALL")
def top9(d: Domain) -> DataFrame:
    return d.tasks.where("not done and poi is not null").groupBy("uid", "poi").agg(F.min("task_id").alias("shown"), (F.count("*") - 1).alias("grey"))


@query("top10_social_feed", "SELECT uid, source, id, row_number() OVER (PARTITION BY uid ORDER BY at_s DESC, source, id) AS place FROM (SELECT uid, 'inbox' AS source, id, at_s FROM inbox UNION ALL SELECT uid, 'share', entry, at_s FROM players WHERE joined = 'pending')")
def top10(d: Domain) -> DataFrame:
    feed = d.inbox.select("uid", F.lit("inbox").alias("source"), "id", "at_s").unionByName(d.players.where("joined = 'pending'").select("uid", F.lit("share").alias("source"), F.col("entry").alias("id"), "at_s"))
    return ranked(feed, ["uid"], F.desc("at_s"), "source", "id", keep=["uid", "source", "id"])


@query("top11_newest_followers", "SELECT followed, follower, row_number() OVER (PARTITION BY followed ORDER BY at_s DESC, follower) AS place FROM follows")
def top11(d: Domain) -> DataFrame:
    return ranked(d.follows, ["followed"], F.desc("at_s"), "follower", keep=["followed", "follower"])


@query("top12_categories", "SELECT category, row_number() OVER (ORDER BY category) AS place FROM (SELECT DISTINCT category FROM tasks)")
def top12(d: Domain) -> DataFrame:
    return d.tasks.select("category").distinct().selectExpr("category", "cast(row_number() over (order by category) as bigint) as place")


@query("top13_day_order", "SELECT uid, day, task_id, row_number() OVER (PARTITION BY uid, day ORDER BY coalesce(hhmm, ''), task_id) AS place FROM tasks")
def top13(d: Domain) -> DataFrame:
    return ranked(d.tasks, ["uid", "day"], F.coalesce("hhmm", F.lit("")), "task_id", keep=["uid", "day", "task_id"])


@query("top14_nearest_goal", "SELECT uid, kind, remaining FROM (SELECT uid, id % 11 AS kind, 20 - count(*) AS remaining, row_number() OVER (PARTITION BY uid ORDER BY 20 - count(*), id % 11) AS rn FROM ledger GROUP BY uid, id % 11 HAVING count(*) < 20) WHERE rn = 1")
def top14(d: Domain) -> DataFrame:
    goals = d.ledger.groupBy("uid", (F.col("id") % 11).alias("kind")).agg((20 - F.count("*")).alias("remaining")).where("remaining > 0")
    return goals.groupBy("uid").agg(F.min(F.struct("remaining", "kind")).alias("g")).select("uid", "g.kind", "g.remaining")


@query("top16_argmax_class", "SELECT vec_id, CASE WHEN list_max(embedding) >= 0.1 THEN CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) END AS label FROM embeddings")
def top16(d: Domain) -> DataFrame:
    best = F.array_max("embedding")
    return d.raw("embeddings").select("vec_id", F.when(best >= 0.1, F.array_position("embedding", best) - 1).alias("label"))
