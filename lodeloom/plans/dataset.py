"""A labelled training set of short texts: keywords in templates, with typing errors, so many of each class.

Every choice is made by a hash of (seed, label, position), not by a generator, so the rows are the same however they are dealt
to tasks. Texts of a class are numbered once and then drawn by number, as often as its quota asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeloom.binding import Domain, query
from lodeloom.plans.dictionary import LANGUAGES, SEED, infer_types, seed_entries
from lodeloom.plans.numbering import numbered

# How a keyword stands in a task, by language.
TEMPLATES = {
    "en": "{kw}|buy {kw}|buy some {kw}|get {kw}|get some {kw}|need {kw}|need some {kw}|need a {kw}|pick up {kw}|pick up some {kw}|go to the {kw}|go get {kw}|grab {kw}|grab some {kw}|remember to buy {kw}|stop for {kw}|{kw} run",
    "pt-PT": "{kw}|comprar {kw}|comprar uns {kw}|preciso de {kw}|preciso de uns {kw}|ir buscar {kw}|ir ao {kw}|ir a {kw}|apanhar {kw}|trazer {kw}|lembrar de comprar {kw}|passar por {kw}",
}
# Letters next to each letter on a keyboard.
NEXT_TO = {
    "a": "sq", "b": "vn", "c": "xv", "d": "sf", "e": "wr", "f": "dg", "g": "fh", "h": "gj", "i": "uo", "j": "hk", "k": "jl", "l": "k", "m": "n",
    "n": "bm", "o": "ip", "p": "o", "q": "wa", "r": "et", "s": "ad", "t": "ry", "u": "yi", "v": "cb", "w": "qe", "x": "zc", "y": "tu", "z": "x",
}
SEED_NUMBER, PER_CLASS, VALIDATION, TYPOS, LEAST_LETTERS, NONE = 42, 1000, 0.15, 0.15, 4, "none"


def draw(*what: Column | str | int) -> Column:
    """32 bits of a hash of all of these; the same for the same ones."""
    text = F.concat_ws("|", *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in what))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def chance(*what: Column | str | int) -> Column:
    return draw(*what) / F.lit(float(2**32))


def with_typo(word: Column, *by: Column | str | int) -> Column:
    """The word with one edit chosen by a hash: neighbours swapped, a letter replaced by one next to it, dropped or doubled.

    Words of under four letters stay, as do those whose edit doesn't apply (a swap at the end, a letter without neighbours).
    """
    i = (draw("at", *by) % F.greatest(F.length(word), F.lit(1)) + 1).cast("int")
    how, here = draw("how", *by) % 4, F.substr(word, i, F.lit(1))
    head, tail = F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)
    beside = F.create_map(*(F.lit(x) for pair in NEXT_TO.items() for x in pair))
    letters = F.coalesce(F.try_element_at(beside, here), here)
    other = F.substr(letters, (draw("other", *by) % F.greatest(F.length(letters), F.lit(1)) + 1).cast("int"), F.lit(1))
    swapped = F.concat(head, F.substr(tail, F.lit(1), F.lit(1)), here, F.substr(tail, F.lit(2)))
    edited = F.when(how == 0, swapped).when(how == 1, F.concat(head, other, tail)).when(how == 2, F.concat(head, tail)).otherwise(F.concat(head, here, here, tail))
    return F.when(F.length(word) >= LEAST_LETTERS, edited).otherwise(word)


def class_texts(keywords: DataFrame, plain: DataFrame) -> DataFrame:
    """label, text: each keyword (label, lang, keyword) in the templates of its language, and plain texts as the class none; all different."""
    templates = F.create_map(*(x for lang in LANGUAGES for x in (F.lit(lang), F.split(F.lit(TEMPLATES[lang]), r"\|"))))
    each = keywords.select("label", "keyword", F.explode(templates[F.col("lang")]).alias("template"))
    texts = each.select("label", F.trim(F.replace("template", F.lit("{kw}"), F.col("keyword"))).alias("text"))
    return texts.unionByName(plain.select(F.lit(NONE).alias("label"), F.trim("text").alias("text"))).where("text <> ''").distinct()


def synthesize(texts: DataFrame, per_class: int = PER_CLASS, seed: int = SEED_NUMBER, typos: float = TYPOS, validation: float = VALIDATION) -> DataFrame:
    """label, position, text, part: per_class rows of each class of texts (label, text), some with a typing error, in small letters.

    Texts are drawn with repeats. part is validation for a share of all rows, to the row, in the order of a hash, else train.
    """
    h = draw(seed, F.col("label"), F.col("text"))
    pool = numbered(texts.withColumn("h", h), F.shiftright("h", 22), [F.col("h"), F.col("text")], ["label"])
    sizes = texts.groupBy("label").agg(F.count("*").alias("size"))
    rows = sizes.select("label", "size", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))).alias("position"))
    by = (seed, F.col("label"), F.col("position"))
    drawn = rows.withColumn("nth", draw("pick", *by) % F.col("size")).join(pool.select("label", "nth", "text"), ["label", "nth"])
    spoken = F.split("text", " ")
    which = (draw("word", *by) % F.size(spoken)).cast("int")
    typed = F.array_join(F.transform(spoken, lambda w, i: F.when(i == which, with_typo(w, *by)).otherwise(w)), " ")
    made = drawn.select("label", "position", F.lower(F.when(chance("typo", *by) < typos, typed).otherwise(F.col("text"))).alias("text"))
    ordered = numbered(made.withColumn("h", draw("part", seed, F.col("label"), F.col("position"))), F.shiftright("h", 20), [F.col("h"), F.col("label"), F.col("position")])
    cut = F.floor(ordered.agg(F.count("*")).first()[0] * F.lit(validation))
    return ordered.select("label", "position", "text", F.when(F.col("nth") < cut, "validation").otherwise("train").alias("part"))


def keywords_of(d: Domain) -> DataFrame:
    """label, lang, keyword: the seed's, and what users have taught."""
    rows = [(t, lang, k) for lang, types in SEED.items() for t, ks in types.items() for k in ks.split(", ")]
    seed = d.spark.createDataFrame(rows, "label string, lang string, keyword string")
    taught = d.learnings.where(F.col("lang").isin(*LANGUAGES) & (F.col("type") != "") & F.col("keyword").rlike("[a-z]")).select(F.col("type").alias("label"), "lang", "keyword")
    return seed.unionByName(taught)


def plain_texts(d: Domain) -> DataFrame:
    """Messages in which the dictionary finds nothing."""
    return infer_types(d.messages.select("text"), F.col("text"), seed_entries(d.spark)).where("rule_en is null and rule_pt is null").select("text")


def _duck_draw(*what: str) -> str:
    return f"CAST(concat('0x', substr(sha256(concat_ws('|', {', '.join(what)})), 1, 8)) AS BIGINT)"


def _dataset_sql(none: str, per_class: int, seed: int = SEED_NUMBER) -> str:
    by = (f"'{seed}'", "label", "CAST(position AS VARCHAR)")
    d = lambda name: _duck_draw(f"'{name}'", *by)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(t)}, {quoted(lang)}, {quoted(k)})" for lang, types in SEED.items() for t, ks in types.items() for k in ks.split(", "))
    beside = "CASE letter " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NEXT_TO.items()) + " ELSE letter END"
    return f"""
keywords AS (
  SELECT * FROM (VALUES {rows}) v(label, lang, keyword)
  UNION ALL SELECT type, lang, keyword FROM learnings WHERE lang IN ('en', 'pt-PT') AND type <> '' AND regexp_matches(keyword, '[a-z]')
), texts AS (
  SELECT DISTINCT label, trim(replace(template, '{{kw}}', keyword)) AS text FROM keywords JOIN (
    SELECT 'en' AS lang, unnest(string_split({quoted(TEMPLATES["en"])}, '|')) AS template UNION ALL SELECT 'pt-PT', unnest(string_split({quoted(TEMPLATES["pt-PT"])}, '|'))) USING (lang) WHERE trim(replace(template, '{{kw}}', keyword)) <> ''
  UNION SELECT '{NONE}', trim(text) FROM ({none}) WHERE trim(text) <> ''
), pool AS (
  SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY {_duck_draw(f"'{seed}'", "label", "text")}, text) - 1 AS nth, count(*) OVER (PARTITION BY label) AS size FROM texts
), wanted AS (
  SELECT label, position, {d("pick")} % size AS nth FROM (SELECT label, size, unnest(range({per_class})) AS position FROM (SELECT DISTINCT label, size FROM pool))
), drawn AS (
  SELECT label, position, text, string_split(text, ' ') AS words FROM wanted JOIN pool USING (label, nth)
), placed AS (
  SELECT *, {d("word")} % len(words) + 1 AS which, words[which] AS w, {d("at")} % greatest(length(w), 1) + 1 AS i, {d("how")} % 4 AS how, substr(w, i, 1) AS letter, substr(w, 1, i - 1) AS head, substr(w, i + 1) AS tail, {beside} AS letters,
    substr(letters, {d("other")} % greatest(length(letters), 1) + 1, 1) AS other FROM drawn
), edited AS (
  SELECT label, position, text, words, which, CASE WHEN length(w) < {LEAST_LETTERS} THEN w WHEN how = 0 THEN concat(head, substr(tail, 1, 1), letter, substr(tail, 2)) WHEN how = 1 THEN concat(head, other, tail) WHEN how = 2 THEN concat(head, tail) ELSE concat(head, letter, letter, tail) END AS typed FROM placed
), made AS (
  SELECT label, position, lower(CASE WHEN {d("typo")} / 4294967296.0::DOUBLE < {TYPOS}::DOUBLE THEN array_to_string(list_concat(words[1:which - 1], [typed], words[which + 1:]), ' ') ELSE text END) AS text FROM edited
)
SELECT label, CAST(position AS INTEGER) AS position, text, CASE WHEN row_number() OVER (ORDER BY {_duck_draw("'part'", f"'{seed}'", "label", "CAST(position AS VARCHAR)")}, label, position) <= floor(count(*) OVER () * {VALIDATION}::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM made"""


def _register() -> None:
    from lodeloom.plans.text_search import _INFER

    none = "SELECT text FROM messages m WHERE NOT EXISTS (SELECT 1 FROM plain_first f WHERE f.task_id = m.task_id)"
    only_seed = "plain_first AS (SELECT DISTINCT task_id FROM asked JOIN seed ON contains(f, concat(' ', phrase, ' ')))"

    @query("biz31_dataset", f"WITH {_INFER}, {only_seed}, {_dataset_sql(none, PER_CLASS)}")
    def biz31(d: Domain) -> DataFrame:
        return synthesize(class_texts(keywords_of(d), plain_texts(d)))


_register()
