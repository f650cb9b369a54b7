"""Free text to place types: layered inference, ranked type search, and the chains that use both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.binding import Domain, query
from lodeloom.functions.text import message_time, normalized, normalized_text, trimmed
from lodeloom.plans import dictionary, type_search
from lodeloom.plans.dictionary import category_entries, infer_types, learned_entries, seed_entries
from lodeloom.plans.type_search import MOST_RESULTS, labels_table, search_types

# The built-in place types, and what types of the search they stand for.
BUILT_IN = {
    "atm": "atm", "cafe": "cafe", "supermarket": "supermarket", "pharmacy": "pharmacy", "gas": "gas_station", "gym": "gym", "bank": "bank", "restaurant": "restaurant",
    "park": "park", "library": "library", "post": "post_office", "store": "store", "clinic": "doctor", "salon": "hair_care", "bus": "bus_station", "school": "school",
}
ALSO = {"coffee_shop": "cafe", "grocery_store": "supermarket", "convenience_store": "supermarket", "drugstore": "pharmacy", "transit_station": "bus", "light_rail_station": "bus"}
MOST_TEXT, MOST_TITLE, MOST_SEARCHED = 2000, 80, 200


def own_entries(d: Domain) -> DataFrame:
    """What users have taught and the names of their categories."""
    categories = d.own_categories.select("uid", "id", "name", F.array("synonym").alias("synonyms"), "type")
    return learned_entries(d.learnings).unionByName(category_entries(categories))


def inferred(d: Domain, texts: DataFrame) -> DataFrame:
    """texts with rule_en and rule_pt, by the seed and the user's own entries."""
    return infer_types(texts, F.col("text"), seed_entries(d.spark), own_entries(d))


def built_in(type_: Column) -> Column:
    """The built-in type that a type of the search stands for, or null."""
    found = F.lit(None).cast("string")
    for searched, own in ({v: k for k, v in BUILT_IN.items()} | ALSO).items():
        found = F.when(type_ == searched, own).otherwise(found)
    return found


def searched(texts: DataFrame, labels: DataFrame, text: Column) -> DataFrame:
    """texts with every type that a search for the text finds: type, score, place."""
    named = texts.withColumn("norm", normalized(text))
    return named.join(search_types(named, labels), ["norm", "lang"])


def parse_messages(d: Domain, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """task_id, title, type, at_time, confidence of shared messages (task_id, uid, lang, text).

    The dictionary's English type counts as high if it is or stands for a built-in type; else the first of the search's results that
    stands for one counts as medium; else there is none. Empty messages have an empty title.
    """
    cut = texts.withColumn("text", F.substring(trimmed(F.col("text")), 1, MOST_TEXT))
    ruled = inferred(d, cut)
    sure = F.coalesce(F.when(F.col("rule_en").isin(*BUILT_IN), F.col("rule_en")), built_in(F.col("rule_en")))
    ruled = ruled.withColumn("sure", sure)
    unsure = ruled.where(F.col("sure").isNull() & (F.col("text") != "")).select("task_id", "lang", "text")
    found = searched(unsure, labels, F.substring("text", 1, MOST_SEARCHED)).where(F.col("place") <= MOST_RESULTS).withColumn("stands", built_in(F.col("type")))
    second = found.where(F.col("stands").isNotNull()).groupBy("task_id").agg(F.min_by("stands", "place").alias("second"))
    both = ruled.join(second, "task_id", "left")
    confidence = F.when(F.col("sure").isNotNull(), "high").when(F.col("second").isNotNull(), "medium").otherwise("low")
    return both.select("task_id", F.substring("text", 1, MOST_TITLE).alias("title"), F.coalesce("sure", "second").alias("type"), message_time(F.col("text")).alias("at_time"), confidence.alias("confidence"))


# The twins compare every text with every phrase and every name.


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _norm(x: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"


_INFER = f"""
seed AS (
  SELECT lang, phrase, 2 AS layer, position, type FROM (VALUES {_values([(lang, normalized_text(k), i, t) for lang, k, i, t in dictionary.seed_rows()])}) v(lang, phrase, position, type)
), learned AS (
  SELECT uid, lang, {_norm("keyword")} AS phrase, type, at_s, id FROM learnings WHERE type <> '' AND lang IN ('en', 'pt-PT')
), terms AS (
  SELECT uid, id, type, {_norm("unnest([name, synonym])")} AS phrase, unnest([0, 1]) AS nth FROM own_categories WHERE type IS NOT NULL
), own AS (
  SELECT uid, lang, phrase, 0 AS layer, 0 AS position, type FROM learned WHERE phrase <> '' QUALIFY row_number() OVER (PARTITION BY uid, lang, phrase ORDER BY at_s DESC, id DESC) = 1
  UNION ALL
  SELECT uid, unnest(['en', 'pt-PT']), phrase, 1, first, type FROM (
    SELECT uid, phrase, type, min(id) OVER (PARTITION BY uid, phrase) AS first FROM terms WHERE phrase <> ''
    QUALIFY row_number() OVER (PARTITION BY uid, phrase ORDER BY id DESC, nth DESC) = 1)
), asked AS (
  SELECT task_id, uid, concat(' ', {_norm("text")}, ' ') AS f FROM messages
), met AS (
  SELECT task_id, e.* FROM asked JOIN seed e ON contains(f, concat(' ', phrase, ' '))
  UNION ALL
  SELECT task_id, e.lang, e.phrase, e.layer, e.position, e.type FROM asked JOIN own e ON e.uid = asked.uid AND contains(f, concat(' ', phrase, ' '))
), first AS (
  SELECT task_id, lang, type FROM met QUALIFY row_number() OVER (PARTITION BY task_id, lang ORDER BY length(phrase) DESC, layer, position, phrase, type) = 1
), ruled AS (
  SELECT m.*, e.type AS rule_en, p.type AS rule_pt FROM messages m LEFT JOIN first e ON e.task_id = m.task_id AND e.lang = 'en' LEFT JOIN first p ON p.task_id = m.task_id AND p.lang = 'pt-PT'
)
"""


def _key_rows() -> list[tuple]:
    aliases = {(t, lang): (list(dict.fromkeys(map(normalized_text, ws))), set(map(normalized_text, req))) for t, lang, ws, req in type_search.alias_rows()}
    rows = []
    for t, en, pt in type_search.label_rows():
        if t not in type_search.GENERIC:
            for lang, first, second in (("en", en, pt), ("pt-PT", pt, en)):
                own, other = aliases.get((t, lang), ([], set())), aliases.get((t, "en" if lang == "pt-PT" else "pt-PT"), ([], set()))
                keys = [normalized_text(first), normalized_text(second), normalized_text(t), *own[0], *other[0]]
                open_keys = [i for i, k in enumerate(keys) if k not in own[1]]
                rows += [(lang, t, first, k, i, open_keys.index(i) if i in open_keys else None) for i, k in enumerate(keys)]
    return rows


_STOP = {lang: sorted({*type_search.NOISE[lang].split(), *(normalized_text(w) for ts in type_search.INTENTS[lang].values() for w in ts.replace(",", "").split())}) for lang in type_search.LANGUAGES}
_WORDS = "string_split({}, ' ')"
_HOLDS = "len(list_filter(string_split({key}, ' '), lambda w: NOT list_contains(string_split(phrase, ' '), w))) = 0"
_MOVE = " + ".join(f"CASE WHEN list_contains(coalesce(intents, []), '{i}') AND type IN ({', '.join(repr(t) for t in ts)}) THEN {by} ELSE 0 END" for i, ts, by in type_search.MOVES)
_CONCEPTS = _values([(str(i), c[0], c[1]) for i, c in enumerate(type_search.CONCEPTS)])


def _search(text: str, where: str = "true") -> str:
    return f"""
q AS (
  SELECT DISTINCT {_norm(text)} AS norm, lang FROM messages WHERE {where}
), focus AS (
  SELECT norm, lang, list_filter(string_split(norm, ' '), lambda t: NOT list_contains(CASE lang WHEN 'en' THEN {_STOP["en"]} ELSE {_STOP["pt-PT"]} END, t)) AS f FROM q WHERE norm <> ''
), raw AS (
  SELECT norm, lang, list_concat([norm], list_transform(range(1, len(f) - 1), lambda i: array_to_string(f[i:i + 2], ' ')), list_transform(range(1, len(f)), lambda i: array_to_string(f[i:i + 1], ' ')), f) AS raw FROM focus
), kept AS (
  SELECT norm, lang, list_filter(raw, lambda k, i: list_position(raw, k) = i AND (k = norm OR contains(k, ' ') OR length(k) >= 4)) AS kept FROM raw
), tried AS (
  SELECT norm, lang, phrase, nth, CASE WHEN nth = 0 THEN 0 ELSE 5 + nth END AS penalty FROM (SELECT norm, lang, unnest(kept) AS phrase, generate_subscripts(kept, 1) - 1 AS nth FROM kept)
), terms_of(lang, kind, name, term) AS (
  VALUES {_values([(lang, kind, name, normalized_text(t)) for lang, kind, name, t in type_search.term_rows()])}
), told AS (
  SELECT norm, t.lang, kind, name, nth FROM tried JOIN terms_of t ON t.lang = tried.lang AND {_HOLDS.format(key="term")}
  WHERE kind <> 'intent' OR nth = 0 AND contains(concat(' ', phrase, ' '), concat(' ', term, ' '))
), wants AS (
  SELECT norm, lang, list(DISTINCT name) AS intents FROM told WHERE kind = 'intent' GROUP BY norm, lang
), about AS (
  SELECT t.norm, t.lang, unnest(string_split(c.types, ' ')) AS type, count(DISTINCT nth) FILTER (kind = 'concept') AS hits, bool_or(kind = 'required') AS required,
    coalesce(len(list_intersect(string_split(any_value(c.wanted), ' '), any_value(w.intents))) > 0, false) AS aligned
  FROM told t JOIN (VALUES {_CONCEPTS}) c(name, wanted, types) ON c.name = t.name AND t.kind <> 'intent' LEFT JOIN wants w ON w.norm = t.norm AND w.lang = t.lang
  GROUP BY t.norm, t.lang, c.name, c.types
), subject AS (
  SELECT norm, lang, type, max(hits) AS hits, bool_or(aligned) AS aligned FROM about WHERE hits > 0 AND (aligned OR NOT required) GROUP BY norm, lang, type
), keys(lang, type, label, key, base, open_base) AS (
  VALUES {_values(_key_rows())}
), banded AS (
  SELECT norm, t.lang, type, label, base, open_base, penalty, key,
    CASE WHEN key = phrase THEN 0 WHEN contains(concat(' ', phrase, ' '), concat(' ', key, ' ')) THEN 10 WHEN {_HOLDS.format(key="key")} THEN 20 WHEN starts_with(key, phrase) THEN 30 WHEN contains(key, phrase) THEN 40 END AS band
  FROM tried t JOIN keys k ON k.lang = t.lang
), priced AS (
  SELECT norm, lang, type, label, min((penalty + band + base) * 100 - least(length(key), 99)) AS every, min((penalty + band + open_base) * 100 - least(length(key), 99)) AS open
  FROM banded WHERE band IS NOT NULL GROUP BY norm, lang, type, label
), moved AS (
  SELECT p.norm, p.lang, p.type, p.label, s.hits, coalesce(s.aligned, false) AS ok, w.intents, CASE WHEN ok THEN every WHEN b.type IS NULL THEN open END AS least
  FROM priced p LEFT JOIN subject s ON s.norm = p.norm AND s.lang = p.lang AND s.type = p.type
  LEFT JOIN (SELECT DISTINCT norm, lang, type FROM about WHERE required) b ON b.norm = p.norm AND b.lang = p.lang AND b.type = p.type
  LEFT JOIN wants w ON w.norm = p.norm AND w.lang = p.lang
), scored AS (
  SELECT norm, lang, type, label, CAST(least + 100 * (CASE WHEN hits IS NULL THEN 0 ELSE -8 - hits - CASE WHEN ok THEN 4 ELSE 0 END END + {_MOVE}) AS BIGINT) AS score FROM moved WHERE least IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY norm, lang ORDER BY score, length(label), label, type) AS place FROM scored
), found AS (
  SELECT task_id, type, score, place FROM messages m JOIN placed p ON p.lang = m.lang AND p.norm = {_norm(text.replace("text", "m.text"))} WHERE {where}
)"""


@query("str4_keyword_inference", f"WITH {_INFER} SELECT task_id, CASE lang WHEN 'en' THEN rule_en ELSE rule_pt END AS type FROM ruled")
def str4(d: Domain) -> DataFrame:
    return inferred(d, d.messages).select("task_id", F.when(F.col("lang") == "en", F.col("rule_en")).otherwise(F.col("rule_pt")).alias("type"))


@query("jn23_phrase_join", f"WITH {_INFER} SELECT lang, type, count(*) AS n FROM first GROUP BY lang, type")
def jn23(d: Domain) -> DataFrame:
    ruled = inferred(d, d.messages)
    each = F.explode(F.array(*(F.struct(F.lit(lang).alias("lang"), F.col(f"rule_{lang[:2]}").alias("type")) for lang in dictionary.LANGUAGES))).alias("r")
    return ruled.select(each).where("r.type is not null").groupBy("r.lang", "r.type").agg(F.count("*").alias("n"))


_BUILT_IN = ", ".join(f"'{t}'" for t in BUILT_IN)
_STANDS = "CASE {} " + " ".join(f"WHEN '{s}' THEN '{own}'" for s, own in ({v: k for k, v in BUILT_IN.items()} | ALSO).items()) + " END"
_CUT = "substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 2000)"
_TIME = "CASE WHEN text LIKE '% at 9am' THEN '09:00' WHEN text LIKE '% at 14:30' THEN '14:30' WHEN text LIKE '% 5pm' THEN '17:00' END"


@query(
    "str6_message_parse",
    f"WITH {_INFER}, sure AS (SELECT *, CASE WHEN rule_en IN ({_BUILT_IN}) THEN rule_en ELSE {_STANDS.format('rule_en')} END AS sure FROM ruled), {_search(f'substr({_CUT}, 1, 200)')}, "
    f"second AS (SELECT task_id, arg_min({_STANDS.format('type')}, place) AS second FROM found WHERE place <= 8 AND {_STANDS.format('type')} IS NOT NULL GROUP BY task_id) "
    f"SELECT s.task_id, substr({_CUT}, 1, 80) AS title, coalesce(sure, second) AS type, {_TIME} AS at_time, CASE WHEN sure IS NOT NULL THEN 'high' WHEN second IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM sure s LEFT JOIN second USING (task_id)",
)
def str6(d: Domain) -> DataFrame:
    return parse_messages(d, d.messages.select("task_id", "uid", "lang", "text"), labels_table(d.spark))


@query("str13_quick_add", f"WITH {_INFER}, {_search('text')} SELECT r.task_id, coalesce(f.type, rule_en, rule_pt) AS type FROM ruled r LEFT JOIN found f ON f.task_id = r.task_id AND f.place = 1")
def str13(d: Domain) -> DataFrame:
    found = searched(d.messages, labels_table(d.spark), F.col("text")).where("place = 1").select("task_id", "type")
    return inferred(d, d.messages).join(found, "task_id", "left").select("task_id", F.coalesce("type", "rule_en", "rule_pt").alias("type"))


@query("str14_import_inference", f"WITH {_INFER} SELECT task_id, coalesce(rule_en, rule_pt) AS type FROM ruled WHERE NOT done")
def str14(d: Domain) -> DataFrame:
    return inferred(d, d.messages.where("not done")).select("task_id", F.coalesce("rule_en", "rule_pt").alias("type"))


@query("str8_type_search", f"WITH {_search('text')} SELECT task_id, type, score FROM found")
def str8(d: Domain) -> DataFrame:
    return searched(d.messages, labels_table(d.spark), F.col("text")).select("task_id", "type", "score")


@query("top15_suggestions", f"WITH {_search('text')} SELECT task_id, type, place FROM found WHERE place <= 8")
def top15(d: Domain) -> DataFrame:
    return searched(d.messages, labels_table(d.spark), F.col("text")).where(F.col("place") <= MOST_RESULTS).select("task_id", "type", "place")


@query("str11_token_ids", "SELECT t.task_id, array_to_string(list_resize(list_slice([coalesce(v[w], 1) FOR w IN string_split(lower(trim(title)), ' ')], 1, 12), 12, 0), ',') AS ids FROM tasks t, (SELECT map_from_entries(list((token, id))) AS v FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS id FROM (SELECT token, count(*) AS n FROM (SELECT unnest(string_split(lower(trim(title)), ' ')) AS token FROM tasks) WHERE token <> '' GROUP BY token) ORDER BY n DESC, token LIMIT 4998))")
def str11(d: Domain) -> DataFrame:
    words = F.split(F.lower(F.trim("title")), " ")
    counts = d.tasks.select(F.explode(words).alias("token")).where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(4998)
    ids = counts.selectExpr("token", "cast(row_number() over (order by n desc, token) + 1 as bigint) as id")
    table = ids.agg(F.map_from_entries(F.collect_list(F.struct("token", "id"))).alias("v"))  # 4,998 entries at most, as in agg23
    rows = d.tasks.select("task_id", words.alias("w")).join(F.broadcast(table))
    known = F.transform(F.slice("w", 1, 12), lambda t: F.coalesce(F.try_element_at("v", t), F.lit(1).cast("long")))
    padded = F.slice(F.concat(known, F.array_repeat(F.lit(0).cast("long"), 12)), 1, 12)
    return rows.select("task_id", F.array_join(padded, ",").alias("ids"))
