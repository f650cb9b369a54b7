"""Domain tables derived from the star-schema tables by integer arithmetic that Spark and DuckDB share.

Each derivation is a source table and expressions valid in both engines. Instants are epoch seconds, days are dates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

#: Today and now of every query; operators take them as parameters.
TODAY, NOW = "2024-01-15", 19737 * 86400 + 12 * 3600
FIRST_DAY = 19723

# The words that messages are made of.
VERBS = "buy |Get some |pick up ||go to the |purchase a |comprar |ir ao |levantar |book a |place to |Mail the |get a loaf of |buy a new |grab a |remember: "
NOUNS = "bread|milk|coffee|medicine|flowers|shoes|book|gym|run|letter|cash|café|pão|pastel de nata|um livro|multibanco|haircut|parcel|library|jog|dentist checkup|sushi|stamps|flight|novel|work out|Ginásio|correios|Wi-Fi router|aula de inglês|send package|relaxing place|petrol|buscar os miúdos|mall|reunião de pais|prescription|kite|bus stop|sushi_restaurant"
TAILS = "| at 9am| 5pm|!!| on the way home| at 14:30| amanhã| near the park| x2"

DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "users": ("customer", {
        "uid": "c_custkey",
        "username": "case when c_custkey % 50 = 0 then cast(null as string) else concat('user_', cast(c_custkey as string)) end",
        "display_name": "case when c_custkey % 75 = 0 then '' else c_name end",
        "email": "concat('User', cast(c_custkey as string), '@Example.com')",
        "lat": "38.72e0 + ((c_custkey * 6151) % 2001 - 1000) / 1e5",
        "lng": "-9.14e0 + ((c_custkey * 3571) % 2001 - 1000) / 1e5",
        "home_lat": "case when c_custkey % 7 = 0 then cast(null as double) else 38.72e0 + ((c_custkey * 131) % 2001 - 1000) / 1e5 end",
        "home_lng": "case when c_custkey % 7 = 0 then cast(null as double) else -9.14e0 + ((c_custkey * 97) % 2001 - 1000) / 1e5 end",
        "created_s": "(19723 - c_custkey % 60) * 86400",
        "renamed_s": "case when c_custkey % 4 = 0 then cast(null as bigint) else (19737 - c_custkey % 45) * 86400 + 3600 end",
        "opened_s": "19737 * 86400 + 43200 - (c_custkey % 240) * 3600",
        "nudged_s": "case when c_custkey % 3 = 0 then cast(null as bigint) else 19737 * 86400 - (c_custkey % 100) * 3600 end",
        "churned": "c_custkey % 11 = 0",
        "tz": "split_part('UTC|Europe/Lisbon|America/New_York|Asia/Kolkata|Africa/Cairo|America/Havana|Atlantic/Azores|Pacific/Auckland|Australia/Lord_Howe', '|', cast(c_custkey % 9 + 1 as int))",
        "battery": "cast(c_custkey % 100 as double) / 100",
        "friend_nudges": "case when c_custkey % 5 = 0 then cast(null as boolean) else c_custkey % 5 <> 1 end",
    }),
    "tasks": ("orders", {
        "task_id": "o_orderkey",
        "uid": "o_custkey",
        "day": "date '2024-01-01' + cast(o_orderkey % 28 as int)",
        "origin_day": "case when o_orderkey % 13 = 0 then date '2024-01-01' + cast(o_orderkey % 28 - o_orderkey % 9 as int) end",
        "done": "o_orderstatus <> 'O'",
        "poi": "case when o_orderkey % 5 = 0 then cast(null as bigint) else o_orderkey % 16 end",
        "kind": "case when o_orderkey % 11 = 0 then 'birthday' end",
        "title": "concat(case o_orderkey % 6 when 0 then 'Buy bread ' when 1 then '  Pick up medicine at 9am ' when 2 then 'Withdraw cash ' when 3 then 'Aniversário da Ana ' when 4 then 'call at 14:30 ' else 'Post the letter ' end, cast(o_orderkey % 97 as string))",
        "category": "case o_orderkey % 5 when 0 then 'errands' when 1 then 'work' when 2 then 'health' when 3 then 'personal' else concat('c', cast(o_orderkey % 9 as string)) end",
        "hhmm": "case when o_orderkey % 3 = 0 then cast(null as string) else concat(lpad(cast(o_orderkey % 24 as string), 2, '0'), ':', lpad(cast(o_orderkey % 60 as string), 2, '0')) end",
        "created_s": "(19723 + o_orderkey % 28 - o_orderkey % 6) * 86400 + o_orderkey % 86400",
        "completed_s": "case when o_orderstatus <> 'O' then (19723 + o_orderkey % 28) * 86400 + (o_orderkey * 37) % 86400 end",
        "visited": "case when o_orderstatus <> 'O' and o_orderkey % 3 = 0 then o_orderkey % 12 end",
        "seq": "o_orderkey % 100000",
    }),
    "places": ("part", {
        "place_id": "p_partkey",
        "poi": "p_partkey % 16",
        "name": "p_name",
        "lat": "38.72e0 + ((p_partkey * 7919) % 2001 - 1000) / 1e5",
        "lng": "-9.14e0 + ((p_partkey * 104729) % 2001 - 1000) / 1e5",
        "osm": "p_partkey % 3 <> 0",
        "fetched_s": "(19737 - p_partkey % 30) * 86400",
        "matched_s": "(19737 - p_partkey % 17) * 86400 + p_partkey",
        "area": "case when p_partkey % 10 = 0 then concat('ta_', cast(p_partkey % 40 as string)) end",
        "expires_s": "case when p_partkey % 10 = 0 then (19737 + p_partkey % 21 - 10) * 86400 end",
    }),
    "ledger": ("events", {
        "uid": "user_id",
        "id": "event_id",
        "task_id": "event_id % 40",
        "points": "event_id % 100 + 1",
        "reason": "case event_id % 5 when 0 then 'task_completed' when 1 then 'task_completed' when 2 then 'achievement' when 3 then 'onboarding' else 'challenge_won' end",
        "at_s": "19723 * 86400 + event_id * 257",
    }),
    "trips": ("supplier", {
        "trip_id": "s_suppkey",
        "uid": "s_suppkey % 60 + 1",
        "destination": "s_name",
        "lat": "38.72e0 + ((s_suppkey * 911) % 2001 - 1000) / 1e5",
        "lng": "-9.14e0 + ((s_suppkey * 613) % 2001 - 1000) / 1e5",
        "start_day": "case when s_suppkey % 8 = 0 then cast(null as date) else date '2024-01-01' + cast(s_suppkey % 20 as int) end",
        "end_day": "case when s_suppkey % 6 = 0 then cast(null as date) else date '2024-01-01' + cast(s_suppkey % 20 + s_suppkey % 7 as int) end",
        "radius": "case s_suppkey % 3 when 0 then 300 when 1 then 500 else 900 end",
        "expires_s": "(19737 + s_suppkey % 21 - 10) * 86400 + 43200",
        "refreshed_s": "case when s_suppkey % 4 = 0 then (19737 - s_suppkey % 9) * 86400 end",
        "kind": "case when s_suppkey % 5 = 0 then 'offgrid' when s_suppkey % 5 = 1 then 'mall' end",
        "created_s": "(19723 + s_suppkey % 10) * 86400",
    }),
    "follows": ("customer", {
        "follower": "c_custkey",
        "followed": "(c_custkey * 7 + 3) % 150 + 1",
        "at_s": "19723 * 86400 + c_custkey * 61",
    }),
    "players": ("orders", {
        "challenge_id": "o_orderkey % 300",
        "entry": "o_orderkey",
        "uid": "o_custkey",
        "joined": "case o_orderkey % 4 when 0 then 'pending' when 1 then 'declined' else 'accepted' end",
        "completed": "o_orderkey % 17",
        "won": "o_orderkey % 17 = 16",
        "at_s": "19723 * 86400 + (o_orderkey * 7919) % 2419200",
    }),
    "fixes": ("events", {
        "uid": "user_id",
        "fix_id": "event_id",
        "at_s": "19723 * 86400 + event_id * 7",
        "accuracy": "value",
        "lat": "38.72e0 + ((event_id * 37) % 2001 - 1000) / 1e5",
        "lng": "-9.14e0 + ((event_id * 53) % 2001 - 1000) / 1e5",
    }),
    "misses": ("orders", {
        "uid": "o_custkey",
        "sentence": "concat(case when o_orderkey % 3 = 0 then '  Fix   The ' when o_orderkey % 3 = 1 then 'fix the ' else '' end, case o_orderkey % 7 when 0 then '12' else concat('Thing ', cast(o_orderkey % 23 as string)) end)",
    }),
    "messages": ("orders", {
        "task_id": "o_orderkey",
        "uid": "o_custkey",
        "lang": "case when o_orderkey % 3 = 2 then 'pt-PT' else 'en' end",
        "text": f"concat(split_part('{VERBS}', '|', cast(o_orderkey % 16 + 1 as int)), split_part('{NOUNS}', '|', cast((o_orderkey * 7 + o_custkey) % 40 + 1 as int)), split_part('{TAILS}', '|', cast(o_orderkey % 9 + 1 as int)))",
        "poi": "case when o_orderkey % 5 = 0 then cast(null as bigint) else o_orderkey % 16 end",
        "done": "o_orderstatus <> 'O'",
    }),
    "learnings": ("orders", {
        "id": "o_orderkey",
        "uid": "o_custkey",
        "lang": "case o_orderkey % 7 when 0 then 'fr' when 1 then cast(null as string) when 2 then 'pt-PT' else 'en' end",
        "keyword": f"case when o_orderkey % 13 = 0 then cast(null as string) when o_orderkey % 17 = 0 then ' !? ' else concat(case when o_orderkey % 4 = 0 then split_part('{VERBS}', '|', cast(o_orderkey % 16 + 1 as int)) else '' end, split_part('{NOUNS}', '|', cast(o_custkey % 40 + o_orderkey % 5 + 1 as int))) end",
        "type": "case when o_orderkey % 19 = 0 then '' else split_part('atm|cafe|gym|sushi_restaurant|post|bakery|coffee_shop|salon', '|', cast(o_orderkey % 8 + 1 as int)) end",
        "source": "case when o_orderkey % 2 = 0 then 'llm' else 'user' end",
        "at_s": "19723 * 86400 + (o_orderkey * 7919) % 2419200",
    }),
    "own_categories": ("customer", {
        "id": "c_custkey",
        "uid": "c_custkey % 500",
        "name": f"case when c_custkey % 23 = 0 then '' else split_part('{NOUNS}', '|', cast(c_custkey % 40 + 1 as int)) end",
        "type": "case when c_custkey % 6 = 0 then cast(null as string) else split_part('bakery|florist|shoe_store|library|clinic', '|', cast(c_custkey % 5 + 1 as int)) end",
        "synonym": f"case when c_custkey % 3 = 0 then cast(null as string) else split_part('{NOUNS}', '|', cast(c_custkey * 3 % 40 + 1 as int)) end",
    }),
    "ticks": ("events", {  # 64 fixes a user, three seconds apart, indoors for half of them
        "uid": "cast(floor(event_id / 64) as bigint)",
        "fix_id": "event_id",
        "at_s": "19723 * 86400 + event_id * 3",
        "accuracy": "case when cast(floor(event_id / 64) as bigint) % 5 <> 4 and (event_id % 64 between 8 and 40) <> (event_id % 11 = 5) then 50.5e0 + value else 8e0 end",
        "lat": "38.72e0 + ((cast(floor(event_id / 64) as bigint) * 7919) % 2001 - 1000) / 1e5 + (cast(floor(event_id / 64) as bigint) % 7) * 7e-4",
        "lng": "-9.14e0 + ((cast(floor(event_id / 64) as bigint) * 104729) % 2001 - 1000) / 1e5",
    }),
    "net": ("events", {  # a user's searches, 40 seconds apart, between losses and returns of the connection
        "uid": "cast(floor(event_id / 64) as bigint)",
        "fix_id": "event_id",
        "at_s": "19723 * 86400 + event_id * 40",
        "kind": "case event_id % 16 when 3 then 'offline' when 12 then 'online' else 'search' end",
    }),
    "instants": ("events", {  # over all of 2024, and around changes of clocks
        "id": "event_id",
        "uid": "user_id",
        "at_s": "case when event_id % 3 = 0 then 1704067200 + (event_id * 52361) % 31622400 when event_id % 3 = 1 then 1710046800 + (event_id * 997) % 90000 else 1730592000 + (event_id * 1009) % 90000 end",
    }),
    "completions": ("orders", {  # tasks done in the last fifty minutes
        "task_id": "o_orderkey",
        "uid": "o_custkey",
        "day": "date '2024-01-15' + cast(o_orderkey % 2 as int)",
        "done": "o_orderstatus <> 'O' or o_custkey % 7 = 0",
        "completed_s": "case when o_orderstatus <> 'O' or o_custkey % 7 = 0 then 19737 * 86400 + 43200 - (o_orderkey * 7919) % 3000 end",
    }),
    "nudges": ("customer", {
        "follower": "c_custkey",
        "actor": "(c_custkey * 7 + 3) % 150 + 1",
        "at_s": "19737 * 86400 + 43200 - (c_custkey % 60) * 3600",
    }),
    "contacts": ("orders", {
        "uid": "o_custkey",
        "contact": "(o_custkey * 7 + 3 + o_orderkey % 4) % 150 + 1",
    }),
    "plans": ("orders", {  # entries of a calendar with a place
        "event_id": "o_orderkey",
        "uid": "o_custkey",
        "place": "case o_orderkey % 5 when 0 then '  ' when 1 then concat('Hotel ', cast(o_orderkey % 30 as string)) when 2 then concat('Supplier#', lpad(cast(o_orderkey % 100 as string), 9, '0'), ' hall') when 3 then 'St de' else cast(null as string) end",
        "at_s": "19737 * 86400 + 43200 + (o_orderkey % 12 - 2) * 43200",
    }),
    "inbox": ("events", {
        "uid": "user_id",
        "id": "event_id",
        "kind": "case event_id % 4 when 0 then 'follow' when 1 then 'share' when 2 then 'challenge' else 'system' end",
        "unread": "event_id % 3 = 0",
        "at_s": "19723 * 86400 + event_id * 91",
    }),
}

#: Queries by name: how Spark computes them, and the same in DuckDB's SQL.
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Domain:
    """The domain tables over one folder of star-schema tables, each read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        source, columns = DERIVED[name]
        return self.raw(source).selectExpr(*(f"{e} as {c}" for c, e in columns.items()))

    users, tasks, places, ledger, trips, follows, players, fixes, misses, messages, learnings, own_categories, ticks, net, instants, completions, nudges, contacts, plans, inbox = (cached_property(lambda self, n=n: self.derived(n)) for n in DERIVED)


for _name in DERIVED:
    vars(Domain)[_name].__set_name__(Domain, _name)


def duckdb_sql(body: str) -> str:
    """A body over domain tables as a whole statement: the derivations it names come first."""
    needed = [n for n in DERIVED if n in body.replace("(", " ").replace(",", " ").replace(")", " ").split()]
    derivations = [f"{n} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in DERIVED[n][1].items())} FROM {DERIVED[n][0]})" for n in needed]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*derivations, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*derivations, body[5:]])
    return ("WITH " + ", ".join(derivations) + " " if derivations else "") + body


def query(name: str, sql: str | None):
    """Register a function of Domain under a name, with its DuckDB body."""

    def register(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Domain(spark, sf_dir))
        if sql:
            SQL[name] = duckdb_sql(sql)
        return f

    return register
