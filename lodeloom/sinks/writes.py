"""The writes of the domain: inserts, merges, an area's replacement, claims of names, and deliveries by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lodeloom.binding import NOW, Domain, query
from lodeloom.sinks.versions import Table, scratch_folder

DAY = 86_400
#: Days between two names of a user, hours after joining in which a name may be changed at once, and the form of a name.
NAME_COOLDOWN_DAYS, NAME_GRACE_HOURS, NAME = 30, 24, "^[a-z0-9_]{3,20}$"


def insert(table: Table, rows: DataFrame) -> int:
    """Add rows, each with an id made for it. The ids are written once, so that a lost executor doesn't change them."""
    return table.commit(rows.withColumn("id", F.uuid()), append=table.version() > 0)


def merge(table: Table, rows: DataFrame, key: str) -> int:
    """Fields of rows that aren't null replace those of the row of the same key; a new key is a new row; others stay.

    Of rows that share a key the greatest, field by field in order, counts.
    """
    fields = [c for c in rows.columns if c != key]
    one = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*fields)).alias("new"))

    def merged(old: DataFrame) -> DataFrame:
        both = old.join(one, key, "full_outer")
        return both.select(*(F.coalesce(F.col("new")[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns))

    return table.update(merged)


def replace_area(table: Table, area: str, places: DataFrame) -> int:
    """The places of an area give way to new ones (same columns), in one step; if that fails, the old ones stay."""
    fresh = places.withColumn("area", F.lit(area))
    return table.update(lambda old: old.where(~F.col("area").eqNullSafe(area)).unionByName(fresh.select(*old.columns)))


def settled_claims(users: DataFrame, claims: DataFrame, now: int) -> DataFrame:
    """uid, username, old: the claims (uid, wanted, at_s) that hold, one a user.

    A name is taken in small letters; its form must fit and nobody may have it. Of several who want it the earliest wins, then the
    least uid. A user who has had a name for under 30 days may not change it, except in the day after joining. A user who wins
    several names gets the one claimed first. A name that is given up in a step is free from the next one.
    """
    wanted = claims.select("uid", F.lower("wanted").alias("username"), "at_s").where(F.col("username").rlike(NAME))
    changed_long_ago = F.col("renamed_s").isNull() | (F.lit(now) - F.col("renamed_s") >= NAME_COOLDOWN_DAYS * DAY)
    may = users.where(changed_long_ago | (F.lit(now) - F.col("created_s") < NAME_GRACE_HOURS * 3600)).select("uid", F.col("username").alias("old"))
    free = wanted.join(users.select(F.lower("username").alias("username")), "username", "left_anti").join(may, "uid")
    won = free.groupBy("username").agg(F.min(F.struct("at_s", "uid", "old")).alias("w")).select("username", "w.*")
    return won.groupBy("uid").agg(F.min(F.struct("at_s", "username", "old")).alias("w")).select("uid", "w.username", "w.old")


def claim_names(users: Table, claims: DataFrame, now: int) -> int:
    """Users with the names they have won. The table is the index of names too, so that both change in one step."""

    def renamed(old: DataFrame) -> DataFrame:
        won = settled_claims(old, claims, now).select("uid", F.col("username").alias("won"))
        got = F.col("won").isNotNull()
        changes = {"username": F.coalesce("won", "username"), "renamed_s": F.when(got, F.lit(now).cast("long")).otherwise(F.col("renamed_s"))}
        return old.join(won, "uid", "left").select(*(changes.get(c, F.col(c)).alias(c) for c in old.columns))

    return users.update(renamed)


def notices(events: DataFrame) -> DataFrame:
    """key, uid, kind: what is told to a user when another follows or shares; the key is the event's, so a repeat is known."""
    return events.where(F.col("kind").isin("follow", "share")).select(F.concat_ws("_", "kind", "id").alias("key"), "uid", "kind")


def deliver(table: Table, events: DataFrame, batch: int, stream: str = "notices") -> int:
    """Add the notices of a batch of events whose keys the table doesn't have; a batch it has had changes nothing."""
    fresh = notices(events).dropDuplicates(["key"])
    if not table.version():
        return table.commit(fresh, batch=(stream, batch))
    since = table.version()
    return table.commit(fresh.join(table.read(since).select("key"), "key", "left_anti"), append=True, since=since, batch=(stream, batch))


def deliver_stream(table: Table, events: DataFrame, stream: str = "notices") -> DataStreamWriter:
    """A writer that delivers each micro-batch; after a failure Spark repeats the batch by its number, and the table knows it."""
    return events.writeStream.foreachBatch(lambda rows, batch: deliver(table, rows, batch, stream) and None)


# Queries write to a new table and return what is read from it.


@query("snk1_insert", "SELECT uid, count(*) AS n, count(*) AS ids FROM tasks GROUP BY uid")
def snk1(d: Domain) -> DataFrame:
    """Two inserts; every row has an id of its own."""
    table = Table(d.spark, scratch_folder(d.spark, "inserted"))
    insert(table, d.tasks.select("task_id", "uid", "title").where("done"))
    insert(table, d.tasks.select("task_id", "uid", "title").where("not done"))
    return table.read().groupBy("uid").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(
    "snk2_merge_write",
    "SELECT coalesce(u.uid, n.uid) AS uid, coalesce(n.display_name, u.display_name) AS display_name, coalesce(n.username, u.username) AS username FROM users u FULL JOIN "
    "(SELECT CASE WHEN uid % 10 = 0 THEN uid + 100000000 ELSE uid END AS uid, CASE WHEN uid % 4 = 0 THEN 'renamed' END AS display_name, CASE WHEN uid % 6 = 0 THEN 'u6' END AS username FROM users WHERE uid % 2 = 0) n ON n.uid = u.uid",
)
def snk2(d: Domain) -> DataFrame:
    table = Table(d.spark, scratch_folder(d.spark, "merged"))
    table.commit(d.users.select("uid", "display_name", "username"))
    new = d.users.where("uid % 2 = 0").selectExpr("case when uid % 10 = 0 then uid + 100000000 else uid end as uid", "case when uid % 4 = 0 then 'renamed' end as display_name", "case when uid % 6 = 0 then 'u6' end as username")
    merge(table, new, "uid")
    return table.read()


@query("snk4_area_replace", "SELECT place_id, area, poi FROM places WHERE area IS DISTINCT FROM 'ta_10' UNION ALL SELECT place_id + 1000000000, 'ta_10', poi FROM places WHERE poi = 3 AND place_id % 5 = 0")
def snk4(d: Domain) -> DataFrame:
    table = Table(d.spark, scratch_folder(d.spark, "areas"))
    table.commit(d.places.select("place_id", "area", "poi"))
    replace_area(table, "ta_10", d.places.where("poi = 3 and place_id % 5 = 0").selectExpr("place_id + 1000000000 as place_id", "poi"))
    return table.read()


_CLAIMS = "SELECT uid, CASE uid % 4 WHEN 0 THEN concat('USER_', uid * 2) WHEN 1 THEN concat('Shared_', uid // 40) WHEN 2 THEN 'no' ELSE concat('shared_', uid // 60) END AS wanted, (uid * 7919) % 1000 AS at_s FROM users"
_MAY = f"renamed_s IS NULL OR {NOW} - renamed_s >= 30 * 86400 OR {NOW} - created_s < 86400"


@query(
    "snk10_username_claim",
    f"WITH wanted AS (SELECT uid, lower(wanted) AS name, at_s FROM ({_CLAIMS})), won AS (SELECT uid, name FROM wanted SEMI JOIN (SELECT uid FROM users WHERE {_MAY}) USING (uid) "
    "WHERE regexp_full_match(name, '[a-z0-9_]{3,20}') AND name NOT IN (SELECT lower(username) FROM users WHERE username IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY name ORDER BY at_s, uid) = 1) "
    "SELECT u.uid, coalesce(won.name, u.username) AS username, won.name IS NOT NULL AS renamed FROM users u LEFT JOIN won USING (uid)",
)
def snk10(d: Domain) -> DataFrame:
    table = Table(d.spark, scratch_folder(d.spark, "names"))
    table.commit(d.users.select("uid", "username", "created_s", "renamed_s"))
    u = F.col("uid")
    shared = lambda prefix, n: F.concat(F.lit(prefix), F.floor(u / n).cast("string"))
    wanted = F.when(u % 4 == 0, F.concat(F.lit("USER_"), (u * 2).cast("string"))).when(u % 4 == 1, shared("Shared_", 40)).when(u % 4 == 2, "no").otherwise(shared("shared_", 60))
    claim_names(table, d.users.select("uid", wanted.alias("wanted"), ((u * 7919) % 1000).alias("at_s")), NOW)
    return table.read().join(table.read(1).select("uid", F.col("username").alias("before")), "uid").select("uid", "username", (~F.col("username").eqNullSafe(F.col("before"))).alias("renamed"))


@query("stm10_create_triggers", "SELECT concat(kind, '_', id) AS key, uid, kind FROM inbox WHERE kind IN ('follow', 'share')")
def stm10(d: Domain) -> DataFrame:
    """Four deliveries of three batches, some of whose events come twice."""
    table = Table(d.spark, scratch_folder(d.spark, "notices"))
    for batch in (0, 1, 1, 2):
        deliver(table, d.inbox.where((F.col("id") % 3 == batch) | (F.col("id") % 7 == 0)), batch)
    return table.read()
