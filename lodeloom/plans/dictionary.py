"""Place types of free text by a dictionary in layers.

A layer is a set of phrases, each with a type. What a user has taught comes first, then the names of the user's own
categories, then the seed that all share. In a text the longest phrase that stands there as whole words wins, then the
earlier layer, then the earlier place in it. The taught layers grow with the users, so the dictionary is a table: a text's
words meet the first words of phrases by equality, and only phrases of lengths that begin so are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeloom.functions.text import normalized, words

LANGUAGES = ("en", "pt-PT")
LEARNED, CATEGORY, SEEDED = 0, 1, 2

# The seed's phrases by language and type, in order.
SEED = {
    "en": {
        "atm": "atm, cash, withdraw, withdrawal, cash machine",
        "cafe": "coffee, latte, espresso, cappuccino, cafe, tea, flat white",
        "supermarket": "groceries, grocery, supermarket, market, food shopping, bread, milk, eggs, butter, vegetables, veggies, fruit",
        "pharmacy": "pharmacy, drugstore, prescription, meds, medicine, medication, pills, vitamins",
        "gas": "gas, gas station, fuel, petrol, diesel, fill up, fill the tank",
        "gym": "gym, workout, work out, exercise, fitness, training",
        "bank": "bank, deposit, bank branch, cheque",
        "restaurant": "restaurant, lunch, dinner, eat out, dine out, reservation",
        "park": "park, walk, playground, picnic",
        "library": "library, return book, borrow book, library book",
        "post": "post office, mail, parcel, package, stamp, stamps, ship package",
        "store": "store, shop, mall, shopping mall, book store, bookstore, bookshop, buy book, buy a book, purchase a book",
        "clinic": "clinic, doctor, doctor appointment, checkup, dentist, medical appointment",
        "salon": "salon, haircut, barber, hair appointment, nails, manicure",
        "bus": "bus, bus stop, bus station, catch the bus",
        "school": "school, class, pick up kids, parent meeting, drop off kids",
    },
    "pt-PT": {
        "atm": "multibanco, dinheiro, levantar, levantamento",
        "cafe": "café, galão, bica, chá, pastel de nata, pequeno almoço",
        "supermarket": "compras, supermercado, mercearia, mercado, pão, leite, ovos, fruta, legumes",
        "pharmacy": "farmácia, receita, medicamentos, remédios, comprimidos",
        "gas": "gasolina, combustível, gasóleo, abastecer, meter gasolina, bomba de gasolina",
        "gym": "ginásio, treino, exercício, musculação",
        "bank": "banco, depósito, balcão",
        "restaurant": "restaurante, almoço, jantar, reserva, refeição",
        "park": "parque, passear, jardim, piquenique",
        "library": "biblioteca, devolver livro, requisitar livro",
        "post": "correios, carta, encomenda, selo, enviar encomenda",
        "store": "loja, centro comercial, shopping, livraria, comprar livro, comprar um livro",
        "clinic": "clínica, médico, consulta, dentista, exame",
        "salon": "cabeleireiro, corte de cabelo, barbeiro, unhas, manicure",
        "bus": "autocarro, paragem, apanhar o autocarro",
        "school": "escola, aula, buscar os miúdos, reunião de pais",
    },
}

ENTRY = ("lang", "phrase", "layer", "position", "type")


def seed_rows() -> list[tuple[str, str, int, str]]:
    """(lang, keyword, position, type) of the seed."""
    return [(lang, k, i, t) for lang, types in SEED.items() for i, (k, t) in enumerate((k, t) for t, ks in types.items() for k in ks.split(", "))]


def seed_entries(spark: SparkSession) -> DataFrame:
    """The seed as entries of a dictionary, for all users."""
    rows = spark.createDataFrame(seed_rows(), "lang string, keyword string, position int, type string")
    return rows.select("lang", normalized(F.col("keyword")).alias("phrase"), F.lit(SEEDED).alias("layer"), F.col("position").cast("long").alias("position"), "type")


def learned_entries(learnings: DataFrame) -> DataFrame:
    """The latest type of each keyword a user has taught (uid, lang, keyword, type, at_s, id).

    Rows without a keyword, a type or a known language are left out. Keywords that normalise alike are one; the latest wins,
    then the greatest id.
    """
    phrase = normalized(F.col("keyword"))
    usable = learnings.where((phrase != "") & (F.col("type") != "") & F.col("lang").isin(*LANGUAGES))
    latest = usable.groupBy("uid", "lang", phrase.alias("phrase")).agg(F.max_by("type", F.struct("at_s", "id")).alias("type"))
    return latest.select("uid", "lang", "phrase", F.lit(LEARNED).alias("layer"), F.lit(0).cast("long").alias("position"), "type")


def category_entries(categories: DataFrame) -> DataFrame:
    """Names and synonyms of users' own categories (uid, id, name, synonyms, type), in every language.

    Categories without a type are left out. The last category that has a phrase gives its type; its place is the first's.
    """
    terms = F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))
    each = categories.where(F.col("type").isNotNull()).select("uid", "id", "type", F.posexplode(terms).alias("nth", "term"))
    each = each.withColumn("phrase", normalized(F.col("term"))).where(F.col("phrase") != "")
    one = each.groupBy("uid", "phrase").agg(F.max_by("type", F.struct("id", "nth")).alias("type"), F.min("id").alias("position"))
    lang = F.explode(F.array(*map(F.lit, LANGUAGES))).alias("lang")
    return one.select("uid", lang, "phrase", F.lit(CATEGORY).alias("layer"), "position", "type")


def best_phrases(texts: DataFrame, entries: DataFrame, scope: list[str], name: str) -> DataFrame:
    """scope, norm, name_en, name_pt: of each normalised text the winning phrase (rank and type) of the entries of its scope, by language.

    rank orders phrases over all layers: the longest, then layer, position and phrase. A text's words go with the text alone, and
    are parted again where they have met the first words; a phrase that stands in a text twice is looked up twice, as the
    best of them is the same.
    """
    entries = entries.withColumn("spoken", F.split("phrase", " "))
    heads = entries.select(*scope, F.col("spoken")[0].alias("head"), F.size("spoken").alias("n")).distinct()
    at = texts.select(*scope, "norm", F.posexplode(words(F.col("norm"))).alias("at", "head"))
    begun = at.join(heads, [*scope, "head"]).withColumn("all", words(F.col("norm"))).where(F.col("at") + F.col("n") <= F.size("all"))
    phrases = begun.select(*scope, "norm", F.array_join(F.slice("all", F.col("at") + 1, F.col("n")), " ").alias("phrase"))
    rank = F.struct((-F.length("phrase")).alias("longest"), "layer", "position", "phrase", "type")
    found = phrases.join(entries.drop("spoken"), [*scope, "phrase"])
    return found.groupBy(*scope, "norm").agg(*(F.min(F.when(F.col("lang") == lang, rank)).alias(f"{name}_{lang[:2]}") for lang in LANGUAGES))


def infer_types(texts: DataFrame, text: Column, seed: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """texts with rule_en and rule_pt: the type that the dictionary gives the text in each language, or null.

    own has entries of users (uid and ENTRY); texts must then have uid. Texts that normalise alike are looked up once, in the
    seed for all users and in a user's own entries for that user. A null or empty text has no type.
    """
    named = texts.withColumn("norm", F.coalesce(normalized(text), F.lit("")))
    asked = named.select("norm").where(F.col("norm") != "").distinct()
    out = named.join(best_phrases(asked, seed, [], "seed"), "norm", "left")
    if own is not None:
        mine = best_phrases(named.select("uid", "norm").where(F.col("norm") != "").distinct(), own, ["uid"], "own")
        out = out.join(mine, ["uid", "norm"], "left")
        rules = [F.least(f"own_{lang[:2]}", f"seed_{lang[:2]}")["type"].alias(f"rule_{lang[:2]}") for lang in LANGUAGES]
    else:
        rules = [F.col(f"seed_{lang[:2]}")["type"].alias(f"rule_{lang[:2]}") for lang in LANGUAGES]
    return out.select(*texts.columns, *rules)
