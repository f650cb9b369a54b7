"""Distances, boxes and grid cells as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
METRES_PER_DEGREE = 111195.0
#: Pairs of a cell that one task compares; a cell with more is dealt to several.
CELL_PAIRS = 4_000_000
#: The same where points and places stand for several rows each: pairs of those rows, which a task makes one after another.
LISTED_PAIRS = 1_000_000_000


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lng) * F.sin(half_lng)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def reach_lat(metres: Column) -> Column:
    return metres / METRES_PER_DEGREE


def reach_lng(metres: Column, lat: Column) -> Column:
    """Degrees of longitude that span metres at a latitude; the cosine is kept from vanishing."""
    return metres / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))


def in_box(lat: Column, lng: Column, at_lat: Column, at_lng: Column, metres: Column) -> Column:
    """A cheap necessary condition of being within metres, which scans can push down."""
    return lat.between(at_lat - reach_lat(metres), at_lat + reach_lat(metres)) & lng.between(at_lng - reach_lng(metres, at_lat), at_lng + reach_lng(metres, at_lat))


def cell(x: Column, size: float) -> Column:
    """Grid number of a coordinate; half rounds up, also below zero."""
    return F.floor(x / size + 0.5).cast("long")


def duck_haversine(a: str, b: str, c: str, d: str) -> str:
    """The same in DuckDB's SQL."""
    h = f"(sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2) + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


def with_chord(rows, lat: str, lng: str, prefix: str):
    """rows with the point on the unit sphere as three columns, so that pairs are told apart without trigonometry."""
    y, x = F.radians(F.col(lat)), F.radians(F.col(lng))
    parts = (F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y))
    return rows.withColumns({f"{prefix}{i}": part for i, part in enumerate(parts)})


def pair_tasks(spark) -> int:
    """Tasks that near_pairs deals cells to."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def near_pairs(points, places, metres: float, also: tuple[str, ...] = (), stand_for: tuple[str, str] | None = None):
    """points x places with their distance, metres to three places; all pairs within the reach and a few just beyond, to be cut by the caller.

    An equi-join on grid cells (and on the columns also, which both sides have), then straight distances, then the exact one.
    Cells are as high as the reach. Each row of cells is cut into as many columns as leave a cell as wide as the reach at the row's
    far end from the equator and that of its neighbours, so that cells hold at all latitudes and close up at 180 degrees.
    points(lat, lng, ..) are dealt to the cells around theirs, nine at most; nothing is compared across the map. Cells are counted
    first: where points times places are more than CELL_PAIRS, the larger side is cut into parts by a hash of its rows and the
    smaller one goes to each, so that a dense cell becomes many tasks. Rows are few against their pairs, so they are dealt to a
    number of tasks that doesn't go by their size. places' lat and lng become p_lat and p_lng. Where a point and a place stand for
    several rows (expressions of their numbers), rows are counted, and a cell is cut where they make more than LISTED_PAIRS and more
    than half a task's share of all pairs: the number of parts has a limit that doesn't go by the tables then.
    """
    high = 1.0001 * metres / METRES_PER_DEGREE
    row = lambda lat: F.floor(lat / high).cast("long")

    def columns(y):
        far = F.least(F.lit(90.0), (F.greatest(F.abs(y), F.abs(y + 1)) + 1) * high)
        chord = F.least(F.lit(1.0), F.sin(F.radians(F.lit(high / 2))) / F.greatest(F.cos(F.radians(far)), F.lit(1e-9)))
        return F.greatest(F.lit(1), F.floor(180 / F.degrees(F.asin(chord)))).cast("long")

    def column(lng, n):
        return F.floor((F.pmod(lng, F.lit(360.0)) / 360) * n).cast("long") % n

    keys, tasks = ["_y", "_x", *also], pair_tasks(points.sparkSession)
    dealt = with_chord(points, "lat", "lng", "_a").withColumn("_y", F.explode(F.sequence(row(F.col("lat")) - 1, row(F.col("lat")) + 1)))
    n, x = columns(F.col("_y")), column(F.col("lng"), columns(F.col("_y")))
    dealt = dealt.withColumn("_x", F.explode(F.array_distinct(F.array(*(F.pmod(x + step, n) for step in (-1, 0, 1))))))
    there = with_chord(places.withColumnsRenamed({"lat": "p_lat", "lng": "p_lng"}), "p_lat", "p_lng", "_b").withColumn("_y", row(F.col("p_lat")))
    there = there.withColumn("_x", column(F.col("p_lng"), columns(F.col("_y"))))
    straight = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) * (F.col(f"_a{i}") - F.col(f"_b{i}")) for i in (1, 2)), (F.col("_a0") - F.col("_b0")) * (F.col("_a0") - F.col("_b0")))
    most = (2 * math.sin(min(math.pi, (metres + 0.01) / EARTH_M) / 2)) ** 2 * (1 + 1e-6) + 1e-18
    count = lambda rows, name, stands: rows.groupBy(*keys).agg(F.sum(F.expr(stands)).alias(name))
    of_points, of_places = stand_for or ("1", "1")
    cells = count(dealt, "_n", of_points).join(count(there, "_m", of_places), keys).withColumn("_pairs", F.col("_n").cast("double") * F.col("_m"))
    limit = F.lit(CELL_PAIRS)
    if stand_for:
        cells = cells.crossJoin(F.broadcast(cells.agg((F.sum("_pairs") / (2 * tasks)).alias("_share"))))
        limit = F.greatest(F.lit(LISTED_PAIRS), F.col("_share"))
    dense = cells.where(F.col("_pairs") > limit).select(*keys, F.ceil(F.col("_pairs") / limit).cast("int").alias("_parts"), (F.col("_n") >= F.col("_m")).alias("_cut"))
    if stand_for:  # fewer than twice the tasks have more than the share
        dense = F.broadcast(dense)

    def in_parts(rows, cut):
        """One part by a hash where this side is cut, every part where the other is."""
        own = F.array(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))
        parts = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(cut, own).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        return rows.join(dense, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts", "_cut").repartition(tasks, *keys, "_part")

    met = in_parts(dealt, F.col("_cut")).join(in_parts(there, ~F.col("_cut")), [*keys, "_part"]).where(straight <= most)
    exact = F.round(haversine(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng")), 3)
    return met.drop("_y", "_x", "_part", *(f"{side}{i}" for side in ("_a", "_b") for i in range(3))).withColumn("metres", exact)
