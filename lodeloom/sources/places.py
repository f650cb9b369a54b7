"""JSON and CSV sources: map elements, place search results, imported items, labelled text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeloom.binding import Domain, query
from lodeloom.sinks.versions import scratch_folder

OVERPASS = "elements array<struct<type:string,id:bigint,lat:double,lon:double,tags:map<string,string>>>"
#: Places of one JSON response, about.
SLICE = 10_000
ITEM = "id bigint, title string, notes string, due string, status string"


def read_elements(spark: SparkSession, path: str, tags: DataFrame, strict: bool = True, lines: bool = False) -> DataFrame:
    """poi_type, osm_id, name, lat, lng of the nodes in map-query results; the first requested type (tags(poi_type, key, value, pos)) whose tag matches.

    A file is one result, or has one on each line. strict fails on a malformed one; otherwise what can't be parsed gives no rows.
    """
    raw = spark.read.option("multiLine", not lines).option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(OVERPASS).json(path)
    return match_elements(raw, tags)


def match_elements(raw: DataFrame, tags: DataFrame) -> DataFrame:
    nodes = raw.select(F.explode("elements").alias("e")).where("e.type = 'node'").select("e.*")
    own = nodes.select("id", "lat", "lon", F.col("tags")["name"].alias("name"), F.explode("tags").alias("key", "value"))
    met = own.join(F.broadcast(tags), ["key", "value"])
    return met.groupBy("id").agg(F.min(F.struct("pos", "poi_type", "name", "lat", "lon")).alias("m")).select("m.poi_type", F.col("id").alias("osm_id"), "m.name", "m.lat", F.col("m.lon").alias("lng"))


def checked_search(types: list[str], radius: int) -> None:
    """Arguments of a nearby search: 1 to 10 types, radius of 1 to 5000 metres."""
    if not 1 <= len(types) <= 10:
        raise ValueError("1 to 10 types")
    if not 1 <= radius <= 5000:
        raise ValueError("a radius of 1 to 5000")


def read_items(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Items of several exported files as one table, with the source's name; items without a title are left out."""
    tables = [spark.read.schema(ITEM).json(path).withColumn("source", F.lit(name)) for name, path in sources.items()]
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first.where(F.trim("title") != "")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("text string, label string").csv(path)


def write_labelled(rows: DataFrame, path: str) -> None:
    rows.select("text", "label").write.mode("overwrite").option("header", True).csv(path)


def with_id(rows: DataFrame, key: str) -> DataFrame:
    """Rows as documents: the key is the id, also where the payload has an id of its own."""
    return rows.withColumn("id", F.col(key))


def sliced(places: DataFrame) -> DataFrame:
    """places with slice: each type's places dealt by a hash of their id to as many slices as keep one at about SLICE places."""
    parts = places.groupBy("poi").agg(F.ceil(F.count("*") / SLICE).alias("parts"))
    return places.join(parts, "poi").withColumn("slice", F.pmod(F.xxhash64("place_id"), "parts")).drop("parts")


@query("src10_map_elements", "SELECT poi % 4 AS poi_type, place_id AS osm_id FROM places WHERE place_id % 5 <> 0")
def src10(d: Domain) -> DataFrame:
    """Places written as one map-query result for each slice of a type, and read back through the element matcher."""
    tag = F.map_from_arrays(F.array(F.lit("name"), F.lit("amenity")), F.array("name", (F.col("poi") % 4).cast("string")))
    element = F.struct(F.when(F.col("place_id") % 5 == 0, "way").otherwise("node").alias("type"), F.col("place_id").alias("id"), "lat", F.col("lng").alias("lon"), tag.alias("tags"))
    text = sliced(d.places).groupBy("poi", "slice").agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("json"))
    tags = d.spark.range(4).select(F.col("id").alias("poi_type"), F.lit("amenity").alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("pos"))
    raw = text.select(F.from_json("json", OVERPASS).alias("r")).select("r.elements")
    return match_elements(raw, tags).select("poi_type", "osm_id")


@query("src12_nearby_response", "SELECT poi, place_id FROM (SELECT poi, place_id, row_number() OVER (PARTITION BY poi ORDER BY place_id) AS rn FROM places) WHERE rn <= 20")
def src12(d: Domain) -> DataFrame:
    checked_search(["atm"], 400)
    text = sliced(d.places).groupBy("poi", "slice").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("place_id", "name"))).alias("places"))).alias("json"))
    read = text.select("poi", F.posexplode(F.from_json("json", "places array<struct<place_id:bigint,name:string>>")["places"]).alias("pos", "p"))
    # The first 20 of a type are among the first 20 of its slices.
    first = read.where("pos < 20").select("poi", "p.place_id", F.row_number().over(Window.partitionBy("poi").orderBy("p.place_id")).alias("rn"))
    return first.where("rn <= 20").select("poi", "place_id")


@query("src13_import_items", "SELECT 'tasks' AS source, task_id AS id FROM tasks WHERE NOT done UNION ALL SELECT 'inbox', id FROM inbox WHERE kind = 'share'")
def src13(d: Domain) -> DataFrame:
    a = d.tasks.where("not done").select(F.lit("tasks").alias("source"), F.to_json(F.struct(F.col("task_id").alias("id"), "title")).alias("json"))
    b = d.inbox.where("kind = 'share'").select(F.lit("inbox").alias("source"), F.to_json(F.struct("id", F.lit("shared").alias("title"))).alias("json"))
    return a.unionByName(b).select("source", F.from_json("json", ITEM).alias("i")).where("trim(i.title) <> ''").select("source", "i.id")


@query("src16_dictionary", "SELECT count(*) AS n, count(DISTINCT poi) AS types FROM places")
def src16(d: Domain) -> DataFrame:
    types = d.spark.range(16).select(F.col("id").alias("poi"))
    return d.places.join(F.broadcast(types), "poi").agg(F.count("*").alias("n"), F.countDistinct("poi").alias("types"))


@query("src11_lenient_types", "SELECT t AS poi_type, count(place_id) FILTER (t <> 3 AND place_id % 5 <> 0) AS n FROM (SELECT unnest(range(4)) AS t) LEFT JOIN places ON poi % 4 = t GROUP BY t")
def src11(d: Domain) -> DataFrame:
    """Responses written to files, a line each, and read leniently: every requested type has a row, and one whose response can't be parsed has an empty bucket."""
    tag = F.map_from_arrays(F.array(F.lit("name"), F.lit("amenity")), F.array("name", (F.col("poi") % 4).cast("string")))
    element = F.struct(F.when(F.col("place_id") % 5 == 0, "way").otherwise("node").alias("type"), F.col("place_id").alias("id"), "lat", F.col("lng").alias("lon"), tag.alias("tags"))
    json = F.to_json(F.struct(F.collect_list(element).alias("elements")))
    path = scratch_folder(d.spark, "responses")
    text = sliced(d.places).groupBy("poi", "slice").agg(json.alias("json")).select(F.when(F.col("poi") % 4 == 3, F.concat(F.lit("error: "), "json")).otherwise(F.col("json")).alias("json"))
    text.write.text(path)
    tags = d.spark.range(4).select(F.col("id").alias("poi_type"), F.lit("amenity").alias("key"), F.col("id").cast("string").alias("value"), F.col("id").alias("pos"))
    found = read_elements(d.spark, path, tags, strict=False, lines=True)
    counts = found.groupBy("poi_type").agg(F.count("*").alias("n"))
    return tags.select("poi_type").join(counts, "poi_type", "left").select("poi_type", F.coalesce("n", F.lit(0)).alias("n"))


@query("src17_labelled_text", "SELECT task_id, concat(title, ', \"x\"') AS text, category AS label FROM tasks")
def src17(d: Domain) -> DataFrame:
    """Labelled text as CSV lines and back; commas, quotes and spaces at the ends stay."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    lines = d.tasks.select("task_id", F.to_csv(F.struct(F.concat("title", F.lit(', "x"')).alias("text"), F.col("category").alias("label")), options).alias("line"))
    return lines.select("task_id", F.from_csv("line", "text string, label string", options).alias("r")).select("task_id", "r.text", "r.label")


def settled(read: Callable[[], DataFrame], default: DataFrame) -> DataFrame:
    """What a source gives, or default where it can't be read; other sources go on."""
    try:
        return read()
    except AnalysisException:  # no such path, or columns that aren't there
        return default


@query("rel3_settle_all", "SELECT u.uid, coalesce(t.n, 0) AS open_tasks, coalesce(r.n, 0) AS trips, CAST(0 AS BIGINT) AS forecasts FROM users u LEFT JOIN (SELECT uid, count(*) AS n FROM tasks WHERE NOT done GROUP BY uid) t USING (uid) LEFT JOIN (SELECT uid, count(*) AS n FROM trips GROUP BY uid) r USING (uid)")
def rel3(d: Domain) -> DataFrame:
    """A screen's counts from several sources, one of which isn't there: each failed or empty source gives its default."""
    nothing = d.spark.createDataFrame([], "uid long, n long")
    per_user = lambda rows: rows.groupBy("uid").agg(F.count("*").alias("n"))
    sources = {"open_tasks": lambda: per_user(d.tasks.where("not done")), "trips": lambda: per_user(d.trips), "forecasts": lambda: per_user(d.raw("no_such_table"))}
    out = d.users.select("uid")
    for name, read in sources.items():
        out = out.join(settled(read, nothing).withColumnRenamed("n", name), "uid", "left")
    return out.select("uid", *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in sources))
