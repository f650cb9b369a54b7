"""Smaller operators: area downloads, dataset synthesis, map updates, inserts and deletes, off-grid windows, label fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeloom.binding import NOW, Domain, query
from lodeloom.plans.numbering import hash_bucket, numbered


class EmptyArea(ValueError):
    """A download without a single place."""


def download_area(known: DataFrame, found: DataFrame, area: str) -> DataFrame:
    """known(place_id, poi, area) with the rows of an area replaced by found(place_id, poi). An empty find is an error and replaces nothing."""
    if found.isEmpty():
        raise EmptyArea(area)
    return known.where(~F.col("area").eqNullSafe(area)).unionByName(found.withColumn("area", F.lit(area)).select(*known.columns))


@query("biz14_area_download", "SELECT place_id, poi, area FROM places WHERE area IS DISTINCT FROM 'ta_20' UNION ALL SELECT place_id + 500000, poi, 'ta_20' FROM places WHERE poi < 4")
def biz14(d: Domain) -> DataFrame:
    found = d.places.where("poi < 4").selectExpr("place_id + 500000 as place_id", "poi")
    return download_area(d.places.select("place_id", "poi", "area"), found, "ta_20")



@query("map1_path_update", "SELECT uid, kind, CAST(n + CASE WHEN kind = 3 THEN 1 ELSE 0 END AS BIGINT) AS n FROM (SELECT uid, id % 11 AS kind, count(*) AS n FROM ledger GROUP BY ALL)")
def map1(d: Domain) -> DataFrame:
    counts = d.ledger.groupBy("uid", (F.col("id") % 11).alias("kind")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"))
    return maps.select("uid", F.explode(F.transform_values("m", lambda k, v: v + F.when(k == 3, 1).otherwise(0))).alias("kind", "n"))



@query("snk3_batches", "SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY task_id) - 1) // 500 AS batch FROM tasks) GROUP BY batch")
def snk3(d: Domain) -> DataFrame:
    """Batches of at most 500 as the store would take them; a table writer needs none. Rows are numbered by counts of hash buckets."""
    rows = numbered(d.tasks.select("task_id"), hash_bucket("task_id"), [F.col("task_id")])
    return rows.groupBy(F.expr("nth div 500").alias("batch")).agg(F.count("*").alias("n"))


@query("snk7_field_delete", "SELECT task_id, CASE WHEN done THEN completed_s END AS completed_s, CASE WHEN NOT done THEN NULL ELSE visited END AS visited FROM tasks")
def snk7(d: Domain) -> DataFrame:
    """A deleted field is null; absent and null are not told apart."""
    return d.tasks.select("task_id", F.when(F.col("done"), F.col("completed_s")).alias("completed_s"), F.when(F.col("done"), F.col("visited")).alias("visited"))


@query("src8_snapshot_ids", "SELECT task_id AS id, title FROM tasks")
def src8(d: Domain) -> DataFrame:
    return d.tasks.withColumn("id", F.col("seq")).withColumn("id", F.col("task_id")).select("id", "title")


@query("biz36_offgrid_window", f"SELECT trip_id, 15000 AS radius, CASE WHEN trip_id % 3 = 0 THEN {NOW + 18000} WHEN trip_id % 3 = 1 THEN {NOW // 86400 * 86400 + 79200} ELSE greatest({NOW + 60}, expires_s) END AS until_s FROM trips WHERE kind = 'offgrid'")
def biz36(d: Domain) -> DataFrame:
    k = F.col("trip_id") % 3
    until = F.when(k == 0, F.lit(NOW + 18000).cast("long")).when(k == 1, F.lit(NOW // 86400 * 86400 + 79200).cast("long")).otherwise(F.greatest(F.lit(NOW + 60), "expires_s"))
    return d.trips.where("kind = 'offgrid'").select("trip_id", F.lit(15000).alias("radius"), until.alias("until_s"))



@query("stm19_latest_input", "SELECT uid, CAST(session AS BIGINT) AS session, max(fix_id) AS fix_id FROM (SELECT uid, fix_id, sum(CASE WHEN gap >= 600 THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY at_s, fix_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, at_s - lag(at_s) OVER (PARTITION BY uid ORDER BY at_s, fix_id) AS gap FROM fixes)) GROUP BY ALL")
def stm19(d: Domain) -> DataFrame:
    """Of inputs that follow one another within ten minutes, the last counts."""
    order = Window.partitionBy("uid").orderBy("at_s", "fix_id")
    gaps = d.fixes.withColumn("gap", F.col("at_s") - F.lag("at_s").over(order))
    sessions = gaps.withColumn("session", F.sum(F.when(F.col("gap") >= 600, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return sessions.groupBy("uid", "session").agg(F.max_by("fix_id", F.struct("at_s", "fix_id")).alias("fix_id"))
