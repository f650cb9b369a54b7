"""Queries over single expressions: geography, labels, text, hashes, dates, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeloom.binding import NOW, TODAY, Domain, query
from lodeloom.functions.geo import cell, duck_haversine, haversine
from lodeloom.functions.text import ACCENTED, PLAIN, folded, message_time, ngrams, tokens, trimmed, without_html, xor_hash36

HOME = (38.72, -9.14)
TIERS = (0, 50, 200, 500, 1200, 3000)


@query("geo1_haversine", f"SELECT place_id, round({duck_haversine('lat', 'lng', '38.72', '-9.14')}, 3) AS metres FROM places")
def geo1(d: Domain) -> DataFrame:
    return d.places.select("place_id", F.round(haversine(F.col("lat"), F.col("lng"), F.lit(HOME[0]), F.lit(HOME[1])), 3).alias("metres"))


@query("geo2_bounding_box", "SELECT uid, round(lat - 700 / 111195.0, 9) AS south, round(lat + 700 / 111195.0, 9) AS north, round(lng - 700 / (111195.0 * greatest(cos(radians(lat)), 0.01)), 9) AS west, round(lng + 700 / (111195.0 * greatest(cos(radians(lat)), 0.01)), 9) AS east FROM users")
def geo2(d: Domain) -> DataFrame:
    tall, wide = F.lit(700) / 111195.0, F.lit(700) / (111195.0 * F.greatest(F.cos(F.radians("lat")), F.lit(0.01)))
    return d.users.select("uid", F.round(F.col("lat") - tall, 9).alias("south"), F.round(F.col("lat") + tall, 9).alias("north"), F.round(F.col("lng") - wide, 9).alias("west"), F.round(F.col("lng") + wide, 9).alias("east"))


@query("geo3_grid_cell", "SELECT place_id, concat(poi, ':', CAST(floor(lat / 0.05 + 0.5) AS BIGINT), ':', CAST(floor(lng / 0.05 + 0.5) AS BIGINT)) AS cell FROM places")
def geo3(d: Domain) -> DataFrame:
    return d.places.select("place_id", F.concat_ws(":", "poi", cell(F.col("lat"), 0.05), cell(F.col("lng"), 0.05)).alias("cell"))


@query("geo4_map_zoom", "SELECT trip_id, CAST(least(20, greatest(1, floor(log2(156543.03392 * cos(radians(lat)) * 320 / radius)))) AS INTEGER) AS zoom FROM trips")
def geo4(d: Domain) -> DataFrame:
    return d.trips.select("trip_id", F.least(F.lit(20), F.greatest(F.lit(1), F.floor(F.log2(156543.03392 * F.cos(F.radians("lat")) * 320 / F.col("radius"))))).cast("int").alias("zoom"))


@query("geo5_valid_coordinates", "SELECT fix_id, (lat * 3 BETWEEN -90 AND 90) AND (lng BETWEEN -180 AND 180) AS valid FROM fixes")
def geo5(d: Domain) -> DataFrame:
    return d.fixes.select("fix_id", ((F.col("lat") * 3).between(-90, 90) & F.col("lng").between(-180, 180)).alias("valid"))


@query("geo6_fence_id", "SELECT place_id, concat(poi, '_', place_id, '_x') AS fence, regexp_extract(concat(poi, '_', place_id, '_x'), '^([^_]*)_(.*)$', 1) AS poi_part, regexp_extract(concat(poi, '_', place_id, '_x'), '^([^_]*)_(.*)$', 2) AS rest FROM places")
def geo6(d: Domain) -> DataFrame:
    fence = F.concat_ws("_", "poi", "place_id", F.lit("x"))
    return d.places.select("place_id", fence.alias("fence"), F.regexp_extract(fence, "^([^_]*)_(.*)$", 1).alias("poi_part"), F.regexp_extract(fence, "^([^_]*)_(.*)$", 2).alias("rest"))


@query("fmt1_distance_label", f"SELECT place_id, CASE WHEN m < 1000 THEN concat(CAST(round(m) AS BIGINT), ' m') ELSE concat(CAST(floor(m / 1000) AS BIGINT), '.', CAST(floor(m / 100) AS BIGINT) % 10, ' km') END AS label FROM (SELECT place_id, floor({duck_haversine('lat', 'lng', '38.72', '-9.14')}) + 50 AS m FROM places)")
def fmt1(d: Domain) -> DataFrame:
    m = F.floor(haversine(F.col("lat"), F.col("lng"), F.lit(HOME[0]), F.lit(HOME[1]))) + 50
    km = F.concat(F.floor(m / 1000).cast("string"), F.lit("."), (F.floor(m / 100) % 10).cast("string"), F.lit(" km"))
    return d.places.select("place_id", F.when(m < 1000, F.concat(m.cast("string"), F.lit(" m"))).otherwise(km).alias("label"))


@query("fmt2_size_label", "SELECT place_id, CASE WHEN place_id * 9000 < 1000000 THEN '< 1 MB' ELSE concat(CAST(floor(place_id * 9000 / 1000000 + 0.5) AS BIGINT), ' MB') END AS label FROM places")
def fmt2(d: Domain) -> DataFrame:
    size = F.col("place_id") * 9000
    return d.places.select("place_id", F.when(size < 1000000, "< 1 MB").otherwise(F.concat(F.floor(size / 1000000 + 0.5).cast("string"), F.lit(" MB"))).alias("label"))


@query("fmt3_type_label", "SELECT p_partkey AS place_id, concat(upper(substr(lower(p_brand), 1, 1)), substr(replace(lower(p_brand), '#', ' '), 2)) AS label FROM part")
def fmt3(d: Domain) -> DataFrame:
    return d.raw("part").select(F.col("p_partkey").alias("place_id"), F.initcap(F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" "))).alias("label"))


_AGO = f"({NOW} - created_s)"


@query("fmt4_relative_time", f"SELECT task_id, CASE WHEN {_AGO} < 60 THEN 'now' WHEN {_AGO} < 3600 THEN concat({_AGO} // 60, ' min') WHEN {_AGO} < 86400 THEN concat({_AGO} // 3600, ' h') ELSE concat({_AGO} // 86400, ' d') END AS label FROM tasks")
def fmt4(d: Domain) -> DataFrame:
    ago = F.lit(NOW) - F.col("created_s")
    say = lambda unit, name: F.concat(F.expr(f"({NOW} - created_s) div {unit}").cast("string"), F.lit(name))
    return d.tasks.select("task_id", F.when(ago < 60, "now").when(ago < 3600, say(60, " min")).when(ago < 86400, say(3600, " h")).otherwise(say(86400, " d")).alias("label"))


@query("fmt5_notice_body", "SELECT uid, left_over, CASE WHEN left_over = 0 THEN 'All done for today' WHEN left_over = 1 THEN 'One task is left' ELSE concat(left_over, ' tasks are left') END AS body FROM (SELECT uid, CAST(sum(CASE WHEN done THEN 0 ELSE 1 END) AS BIGINT) AS left_over FROM tasks GROUP BY uid)")
def fmt5(d: Domain) -> DataFrame:
    rows = d.tasks.groupBy("uid").agg(F.count_if(~F.col("done")).alias("left_over"))
    n = F.col("left_over")
    return rows.withColumn("body", F.when(n == 0, "All done for today").when(n == 1, "One task is left").otherwise(F.concat(n.cast("string"), F.lit(" tasks are left"))))


_DUCK_FOLDED = f"trim(regexp_replace(translate(lower({{}}), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


@query("str1_normalise", f"SELECT doc_id, md5({_DUCK_FOLDED.format('text')}) AS digest FROM documents")
def str1(d: Domain) -> DataFrame:
    return d.raw("documents").select("doc_id", F.md5(folded(F.col("text"))).alias("digest"))


def _duck_html(x: str) -> str:
    x = f"regexp_replace({x}, '(?i)<br\\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for entity, plain in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''")):
        x = f"replace({x}, '{entity}', {plain})"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("str2_strip_html", f"SELECT page_id, md5({_duck_html('html')}) AS digest, length({_duck_html('html')}) AS n FROM pages")
def str2(d: Domain) -> DataFrame:
    plain = without_html(F.col("html"))
    return d.raw("pages").select("page_id", F.md5(plain).alias("digest"), F.length(plain).cast("long").alias("n"))


@query("str3_clean_description", "SELECT task_id, nullif(regexp_replace(CASE WHEN task_id % 4 = 0 THEN '   ' ELSE title END, '^\\s+|\\s+$', '', 'g'), '') AS description FROM tasks")
def str3(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.nullif(trimmed(F.when(F.col("task_id") % 4 == 0, "   ").otherwise(F.col("title"))), F.lit("")).alias("description"))


_AT = r"\bat\s+(\d{1,2})(?::(\d{2}))?\b\s*(am|pm)?\b"
_CLOCK = r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"


@query(
    "str5_spoken_time",
    f"""
WITH said AS (
  SELECT task_id, CASE WHEN regexp_matches(text, '{_AT}', 'i') THEN regexp_extract(text, '{_AT}', ['h', 'm', 'half'], 'i') WHEN regexp_matches(text, '{_CLOCK}', 'i') THEN regexp_extract(text, '{_CLOCK}', ['h', 'm', 'half'], 'i') END AS t FROM messages
), clock AS (
  SELECT task_id, CAST(t.h AS INTEGER) + CASE WHEN lower(t.half) = 'pm' AND CAST(t.h AS INTEGER) < 12 THEN 12 WHEN lower(t.half) = 'am' AND CAST(t.h AS INTEGER) = 12 THEN -12 ELSE 0 END AS h, CAST(coalesce(nullif(t.m, ''), '0') AS INTEGER) AS m FROM said
)
SELECT task_id, CASE WHEN h < 24 AND m < 60 THEN printf('%02d:%02d', h, m) END AS at_time FROM clock""",
)
def str5(d: Domain) -> DataFrame:
    return d.messages.select("task_id", message_time(F.col("text")).alias("at_time"))


@query("str7_birthday", f"SELECT task_id, regexp_matches({_DUCK_FOLDED.format('title')}, 'birthday|aniversario') AS birthday FROM tasks")
def str7(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", folded(F.col("title")).rlike("birthday|aniversario").alias("birthday"))


@query("str9_ngrams", f"""SELECT task_id, concat_ws('|', CASE WHEN len(w) >= 3 THEN array_to_string([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)], '|') END, CASE WHEN len(w) >= 2 THEN array_to_string([array_to_string(w[i:i+1], ' ') FOR i IN range(1, len(w))], '|') END, array_to_string(w, '|')) AS phrases FROM (SELECT task_id, string_split({_DUCK_FOLDED.format('title')}, ' ') AS w FROM tasks)""")
def str9(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.array_join(ngrams(F.split(folded(F.col("title")), " ")), "|").alias("phrases"))


@query("str10_tokens", "SELECT task_id, array_to_string(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda t: length(t) >= 3), ',') AS words FROM tasks")
def str10(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.array_join(tokens(F.col("title")), ",").alias("words"))


@query("str12_sentence", "SELECT uid, sentence, regexp_replace(lower(trim(sentence)), '\\s+', ' ', 'g') AS norm FROM misses")
def str12(d: Domain) -> DataFrame:
    return d.misses.select("uid", "sentence", F.regexp_replace(F.lower(F.trim("sentence")), r"\s+", " ").alias("norm"))


@query("str15_parser_cleanup", "SELECT task_id, nullif(category, 'work') AS poi, CASE WHEN regexp_matches(hhmm, '^([01][0-9]|2[0-3]):[0-5][0-9]$') THEN hhmm END AS at_time, substr(repeat(title, 8), 1, 80) AS title FROM tasks")
def str15(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.nullif("category", F.lit("work")).alias("poi"), F.when(F.col("hhmm").rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), F.col("hhmm")).alias("at_time"), F.substring(F.repeat("title", 8), 1, 80).alias("title"))


@query("str17_locale", "SELECT doc_id, CASE WHEN starts_with(lower(CASE WHEN lang = 'es' THEN 'PT-br' ELSE lang END), 'pt') THEN 'pt-PT' ELSE 'en' END AS language FROM documents")
def str17(d: Domain) -> DataFrame:
    locale = F.when(F.col("lang") == "es", "PT-br").otherwise(F.col("lang"))
    return d.raw("documents").select("doc_id", F.when(F.lower(locale).startswith("pt"), "pt-PT").otherwise("en").alias("language"))


@query("hsh1_import_key", "SELECT trip_id, concat('imp_', lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(destination, '')]), lambda a, c: xor(a * 33, c) % 4294967296), 36))) AS key FROM trips")
def hsh1(d: Domain) -> DataFrame:
    return d.trips.select("trip_id", F.concat(F.lit("imp_"), xor_hash36(F.col("destination"))).alias("key"))


@query("hsh2_contact_hash", "SELECT uid, sha256(lower(trim(email))) AS hash FROM users")
def hsh2(d: Domain) -> DataFrame:
    return d.users.select("uid", F.sha2(F.lower(F.trim("email")), 256).alias("hash"))


@query("dat2_week_bounds", f"SELECT task_id, CAST(date_trunc('week', day) AS DATE) AS monday, CAST(date_trunc('week', day) AS DATE) + 6 AS sunday, date_trunc('week', day) = date_trunc('week', DATE '{TODAY}') AS this_week FROM tasks")
def dat2(d: Domain) -> DataFrame:
    monday = F.trunc("day", "week")
    return d.tasks.select("task_id", monday.alias("monday"), F.date_add(monday, 6).alias("sunday"), (monday == F.trunc(F.lit(TODAY).cast("date"), "week")).alias("this_week"))


@query("dat3_trip_expiry", f"SELECT trip_id, CASE WHEN end_day IS NOT NULL THEN (CAST(end_day - DATE '1970-01-01' AS BIGINT) + 5) * 86400 ELSE {NOW} + 30 * 86400 END AS expires FROM trips")
def dat3(d: Domain) -> DataFrame:
    return d.trips.select("trip_id", F.coalesce((F.unix_date("end_day").cast("long") + 5) * 86400, F.lit(NOW + 30 * 86400).cast("long")).alias("expires"))


@query("dat4_days_between", f"SELECT trip_id, CAST(start_day - DATE '{TODAY}' AS BIGINT) AS days, coalesce(start_day - DATE '{TODAY}' BETWEEN 0 AND 2 AND (refreshed_s IS NULL OR refreshed_s < {NOW} - 86400), false) AS refresh FROM trips")
def dat4(d: Domain) -> DataFrame:
    days = F.datediff("start_day", F.lit(TODAY).cast("date")).cast("long")
    stale = F.col("refreshed_s").isNull() | (F.col("refreshed_s") < NOW - 86400)
    return d.trips.select("trip_id", days.alias("days"), F.coalesce(days.between(0, 2) & stale, F.lit(False)).alias("refresh"))


@query("dat5_offgrid_expiry", "SELECT task_id, created_s + 18000 AS five_hours, CASE WHEN created_s % 86400 >= 79200 THEN created_s + 10800 ELSE created_s // 86400 * 86400 + 79200 END AS tonight, greatest(created_s + 60, completed_s) AS picked FROM tasks")
def dat5(d: Domain) -> DataFrame:
    s = F.col("created_s")
    return d.tasks.select("task_id", (s + 18000).alias("five_hours"), F.when(s % 86400 >= 79200, s + 10800).otherwise(s - s % 86400 + 79200).alias("tonight"), F.greatest(s + 60, "completed_s").alias("picked"))


@query("dat6_next_sunday", "SELECT task_id, CASE WHEN dayofweek(day) = 0 AND hhmm < '19:00' THEN day ELSE day + CAST(7 - dayofweek(day) AS INTEGER) END AS sunday FROM tasks")
def dat6(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.when((F.dayofweek("day") == 1) & (F.col("hhmm") < "19:00"), F.col("day")).otherwise(F.next_day("day", "Sun")).alias("sunday"))


@query("dat7_reminder", "SELECT task_id, CASE WHEN hhmm <= '12:00' THEN day + 1 ELSE day END AS fire_day FROM tasks WHERE hhmm IS NOT NULL")
def dat7(d: Domain) -> DataFrame:
    return d.tasks.where("hhmm is not null").select("task_id", F.when(F.col("hhmm") <= "12:00", F.date_add("day", 1)).otherwise(F.col("day")).alias("fire_day"))


@query("dat8_lenient_parse", "SELECT task_id, TRY_CAST(CASE WHEN task_id % 3 = 0 THEN 'soon' ELSE CAST(day AS VARCHAR) END AS DATE) AS parsed FROM tasks")
def dat8(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.when(F.col("task_id") % 3 == 0, "soon").otherwise(F.col("day").cast("string")).try_cast("date").alias("parsed"))


@query("dat9_strict_day", "SELECT task_id, regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND TRY_CAST(s AS DATE) IS NOT NULL AS valid FROM (SELECT task_id, concat('2024-02-', lpad(CAST(task_id % 40 AS VARCHAR), 2, '0')) AS s FROM tasks)")
def dat9(d: Domain) -> DataFrame:
    s = F.concat(F.lit("2024-02-"), F.lpad((F.col("task_id") % 40).cast("string"), 2, "0"))
    return d.tasks.select("task_id", (s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & s.try_cast("date").isNotNull()).alias("valid"))


@query("dat10_timestamp_shapes", "SELECT task_id, CASE task_id % 3 WHEN 0 THEN created_s WHEN 1 THEN created_s * 1000 // 1000 ELSE (CAST(day - DATE '1970-01-01' AS BIGINT)) * 86400 END AS seconds FROM tasks")
def dat10(d: Domain) -> DataFrame:
    kind = F.col("task_id") % 3
    shapes = d.tasks.select("task_id", F.when(kind == 0, F.col("created_s").cast("string")).when(kind == 1, F.concat((F.col("created_s") * 1000).cast("string"), F.lit("ms"))).otherwise(F.col("day").cast("string")).alias("s"))
    return shapes.select("task_id", F.coalesce(F.col("s").try_cast("long"), F.expr("try_cast(regexp_extract(s, '^([0-9]+)ms$', 1) as bigint) div 1000"), F.unix_date(F.col("s").try_cast("date")).cast("long") * 86400).alias("seconds"))


@query("dat11_month_shift", "SELECT task_id, strftime(day, '%Y-%m') AS month, strftime(day + INTERVAL 1 MONTH, '%Y-%m') AS next_month, day + 10 AS later FROM tasks")
def dat11(d: Domain) -> DataFrame:
    return d.tasks.select("task_id", F.date_format("day", "yyyy-MM").alias("month"), F.date_format(F.add_months("day", 1), "yyyy-MM").alias("next_month"), F.date_add("day", 10).alias("later"))


@query("dat12_greeting", "SELECT fix_id, CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 22 THEN 'evening' ELSE 'night' END AS greeting FROM (SELECT fix_id, at_s // 3600 % 24 AS h FROM fixes)")
def dat12(d: Domain) -> DataFrame:
    h = F.hour(F.timestamp_seconds("at_s"))
    return d.fixes.select("fix_id", F.when((h >= 5) & (h < 12), "morning").when((h >= 12) & (h < 17), "afternoon").when((h >= 17) & (h < 22), "evening").otherwise("night").alias("greeting"))


@query("dat13_display_time", "SELECT fix_id, strftime(make_timestamp(at_s * 1000000), '%I:%M %p') AS clock, strftime(make_timestamp(at_s * 1000000), '%H:%M') AS hhmm, strftime(make_timestamp(at_s * 1000000), '%A') AS weekday FROM fixes")
def dat13(d: Domain) -> DataFrame:
    t = F.timestamp_seconds("at_s")
    return d.fixes.select("fix_id", F.date_format(t, "hh:mm a").alias("clock"), F.date_format(t, "HH:mm").alias("hhmm"), F.date_format(t, "EEEE").alias("weekday"))


@query("gen1_month_grid", """SELECT m AS month, CAST(slot AS INTEGER) AS slot, CASE WHEN slot - lead < days AND slot >= lead THEN CAST(slot - lead + 1 AS INTEGER) END AS day_of_month FROM (SELECT m, dayofweek(m) AS lead, day(last_day(m)) AS days, unnest(range(0, CAST(ceil((dayofweek(m) + day(last_day(m))) / 7.0) * 7 AS BIGINT))) AS slot FROM (SELECT DISTINCT CAST(date_trunc('month', day + CAST(task_id % 12 * 31 AS INTEGER)) AS DATE) AS m FROM tasks))""")
def gen1(d: Domain) -> DataFrame:
    months = d.tasks.select(F.trunc(F.expr("day + cast(task_id % 12 * 31 as int)"), "month").alias("month")).distinct()
    lead, days = F.dayofweek("month") - 1, F.dayofmonth(F.last_day("month"))
    slots = months.select("month", lead.alias("lead"), days.alias("days"), F.explode(F.sequence(F.lit(0), (F.ceil((lead + days) / 7.0) * 7 - 1).cast("int"))).alias("slot"))
    return slots.select("month", "slot", F.when((F.col("slot") >= F.col("lead")) & (F.col("slot") - F.col("lead") < F.col("days")), F.col("slot") - F.col("lead") + 1).alias("day_of_month"))


@query("mth1_tier", "SELECT uid, total, CAST(len(list_filter([0, 50, 200, 500, 1200, 3000], lambda t: t <= total)) - 1 AS INTEGER) AS tier, CASE WHEN total < 3000 THEN list_filter([0, 50, 200, 500, 1200, 3000], lambda t: t > total)[1] - total END AS to_go FROM (SELECT uid, CAST(sum(points) AS BIGINT) AS total FROM ledger GROUP BY uid)")
def mth1(d: Domain) -> DataFrame:
    total, steps = F.col("total"), F.array(*(F.lit(t).cast("long") for t in TIERS))
    rows = d.ledger.groupBy("uid").agg(F.sum("points").alias("total"))
    return rows.select("uid", "total", (F.size(F.filter(steps, lambda t: t <= total)) - 1).alias("tier"), F.when(total < TIERS[-1], F.array_min(F.filter(steps, lambda t: t > total)) - total).alias("to_go"))


@query("mth2_download_estimate", "SELECT trip_id, CAST(round(pi() * radius * radius / 1000000 * 0.3 * 16 * 200) AS BIGINT) AS bytes FROM trips")
def mth2(d: Domain) -> DataFrame:
    return d.trips.select("trip_id", F.round(F.pi() * F.col("radius") * F.col("radius") / 1000000 * 0.3 * 16 * 200).cast("long").alias("bytes"))


@query("mth3_safe_count", "SELECT task_id, CAST(greatest(coalesce(floor(TRY_CAST(s AS DOUBLE)), 0), 0) AS BIGINT) AS n FROM (SELECT task_id, CASE WHEN task_id % 4 = 0 THEN 'x' WHEN task_id % 4 = 1 THEN '-3' ELSE concat(task_id % 9, '.7') END AS s FROM tasks)")
def mth3(d: Domain) -> DataFrame:
    k = F.col("task_id")
    s = F.when(k % 4 == 0, "x").when(k % 4 == 1, "-3").otherwise(F.concat((k % 9).cast("string"), F.lit(".7")))
    return d.tasks.select("task_id", F.greatest(F.coalesce(F.floor(s.try_cast("double")), F.lit(0)), F.lit(0)).cast("long").alias("n"))


@query("jsn1_task_json", "SELECT uid, CAST(count(*) AS BIGINT) AS n, CAST(sum(task_id) AS BIGINT) AS ids FROM tasks WHERE NOT done GROUP BY uid")
def jsn1(d: Domain) -> DataFrame:
    sent = d.tasks.where("not done").groupBy("uid").agg(F.to_json(F.collect_list(F.struct("task_id", "title", "day"))).alias("payload"))
    read = sent.select("uid", F.explode(F.from_json("payload", "array<struct<task_id:bigint,title:string>>")).alias("t"))
    return read.groupBy("uid").agg(F.count("*").alias("n"), F.sum("t.task_id").alias("ids"))


@query("arr1_type_places", "SELECT area, poi, place_id FROM places WHERE area IS NOT NULL")
def arr1(d: Domain) -> DataFrame:
    grouped = d.places.where("area is not null").groupBy("area", "poi").agg(F.collect_list("place_id").alias("ids"))
    return grouped.select("area", "poi", F.explode("ids").alias("place_id"))


@query("map2_explode_players", "SELECT challenge_id, uid, CAST(max(completed) AS BIGINT) AS completed FROM players GROUP BY ALL")
def map2(d: Domain) -> DataFrame:
    """Players of a challenge as rows. Stored as a map of a challenge, they would be one value that grows with it; so no map is built."""
    return d.players.groupBy("challenge_id", "uid").agg(F.max("completed").cast("long").alias("completed"))
