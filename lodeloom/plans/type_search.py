"""Search of place types by free text: a scored inverted index.

A query is tried whole and as its phrases of up to three words that carry meaning. Every type goes by its names in two
languages, its slug and other words for it, in an order of preference. A phrase meets a name in five ways, the closest is
the cheapest; what the query is about moves types up or down. Phrases and names meet by equality: names that a phrase holds
by one of their words, names that hold the phrase by its first letters. So the work grows with the matches and not with
queries times names, and the names can be a large table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeloom.functions.text import ngrams, normalized, normalized_text, words

MOST_RESULTS, MOST_WORDS, LEAST_LETTERS = 8, 3, 4
#: Letters of a gram that names are found by.
GRAM = 3

# Types with their names in Portuguese. English names follow from the type, but for a few.
TYPES = """
bakery: Padaria | book_store: Livraria | clothing_store: Loja de roupa | coffee_shop: Cafetaria
convenience_store: Loja de conveniência | department_store: Loja de departamento | discount_store: Loja de desconto
drugstore: Farmácia | electronics_store: Loja de eletrónica | florist: Florista | furniture_store: Loja de mobiliário
grocery_store: Mercearia | home_goods_store: Loja para o lar | liquor_store: Loja de bebidas | pet_store: Loja de animais
pharmacy: Farmácia | shoe_store: Loja de sapatos | sporting_goods_store: Loja de artigos desportivos | store: Loja
supermarket: Mercado | warehouse_store: Loja de warehouse | market: Mercado | cafe: Café | gym: Ginásio | park: Parque
post_office: Correios | library: Biblioteca | restaurant: Restaurante | bank: Banco | atm: Multibanco
gas_station: Posto de combustível | school: Escola | bus_stop: Paragem de autocarro | hair_salon: Cabeleireiro
beauty_salon: Salão de beleza | barber_shop: Loja de barbeiro | sushi_restaurant: Restaurante de sushi | dentist: Dentista
doctor: Médico | hospital: Hospital | shopping_mall: Centro comercial | bus_station: Estação de autocarros
train_station: Estação de comboios | fitness_center: Centro de fitness | playground: Parque infantil | bar: Bar
movie_theater: Cinema | museum: Museu | hotel: Hotel | lodging: Alojamento | parking: Estacionamento | taxi_stand: Praça de táxis
laundry: Lavandaria | car_wash: Lavagem de carros | car_repair: Oficina automóvel | veterinary_care: Cuidados veterinários
subway_station: Estação de metro | airport: Aeroporto | gift_shop: Loja de presentes | jewelry_store: Joalharia
hardware_store: Loja de ferragens | toy_store: Loja de brinquedos | hair_care: Hair cuidados | transit_station: Estação de transportes
"""
ENGLISH = {"atm": "ATM", "cafe": "Café", "lodging": "Hotel", "hair_care": "Hair Salon", "home_goods_store": "Home Goods", "taxi_stand": "Taxi", "veterinary_care": "Veterinary"}

# Types too general to offer.
GENERIC = (
    "establishment point_of_interest food store health finance service political locality sublocality country route "
    "street_address premise subpremise postal_code natural_feature transit_station place_of_worship geocode"
).split()
# Types that sell, and those of them that sell of all kinds.
COMMERCIAL = (
    "bakery book_store clothing_store coffee_shop convenience_store department_store discount_store drugstore electronics_store "
    "florist furniture_store grocery_store home_goods_store liquor_store pet_store pharmacy shoe_store sporting_goods_store "
    "store supermarket warehouse_store"
).split()
BROAD = "convenience_store department_store discount_store grocery_store market store supermarket warehouse_store".split()
# Phrases that say what a query is about, by language.
INTENTS = {
    "en": {
        "retail": "buy, shop, purchase, get, pick up",
        "food": "eat, drink, grab",
        "fitness": "work out, train, exercise, jog, jogging, run, running, relax, relaxing",
        "medical": "pick up medicine, pick up prescription, get medicine, get prescription",
        "postal": "mail, post, ship, send package",
    },
    "pt-PT": {
        "retail": "comprar, loja, buscar, ir buscar, levantar",
        "food": "comer, beber, lanchar",
        "fitness": "treinar, exercício, ginásio, correr, corrida, jogging, relaxar, relaxante",
        "medical": "buscar medicamento, levantar receita, comprar remédios",
        "postal": "correio, enviar encomenda, posta",
    },
}
# Words that carry no meaning, by language.
NOISE = {"en": "a an the go new some my to for from near", "pt-PT": "o a os as ir um uma uns umas novo nova algum alguma meu minha para perto"}
# Concepts, each with intents, types, and the words for it by language; a type goes by these words too.
CONCEPTS = (
    ("retail", "bakery", "bread, loaf, pastry, cake, croissant, bakery", "pão, broa, pastel, croissant, bolo, padaria"),
    ("retail", "book_store", "book, books, book shop, bookstore, novel, notebook", "livro, livros, livraria, romance, caderno"),
    ("retail", "florist", "flower, flowers, bouquet", "flor, flores, ramo de flores"),
    ("retail food", "coffee_shop cafe", "coffee, coffee shop, espresso, latte", "café, cafetaria, expresso, galão"),
    ("retail medical", "pharmacy drugstore", "medicine, medicines, medication, prescription, chemist", "medicamento, medicamentos, farmácia, remédio, remédios, receita"),
    ("retail", "shoe_store", "shoe, shoes, sneakers, footwear, boots", "sapato, sapatos, ténis, calçado, botas"),
    ("fitness", "gym", "gym, work out, workout, fitness, exercise, train, training", "ginásio, treinar, treino, fitness, exercício"),
    ("fitness", "park", "jog, jogging, run, running, trail, park, outdoor run, relax, relaxing, calm place", "correr, corrida, jogging, trilho, parque, corrida ao ar livre, relaxar, relaxante, lugar calmo"),
    ("postal", "post_office", "mail, post, ship, send package, post office", "correio, posta, enviar encomenda, correios"),
)
#: Words that name a type only where an intent of the type's concept is there (the concept's number).
REQUIRED = {1: ("book, books", "livro, livros")}
# What a type's score moves by where the query has an intent.
MOVES = (
    ("retail", COMMERCIAL, -2), ("retail", BROAD, 6), ("food", ["bakery", "cafe", "coffee_shop", "restaurant"], -2), ("fitness", ["gym"], -3),
    ("medical", ["pharmacy", "drugstore", "clinic"], -3), ("postal", ["post_office", "post"], -3),
)

LANGUAGES = ("en", "pt-PT")


def label_rows() -> list[tuple[str, str, str]]:
    """(type, English name, Portuguese name) of the built-in types."""
    pairs = [p.split(": ") for line in TYPES.strip().splitlines() for p in line.split(" | ")]
    return [(t, ENGLISH.get(t, t.replace("_", " ").title()), pt) for t, pt in pairs]


def labels_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(label_rows(), "type string, en string, pt string")


def term_rows() -> list[tuple[str, str, str, str]]:
    """(lang, kind, name, term): terms of intents, of concepts (by number), and those that a concept's type requires an intent for."""
    rows = [(lang, "intent", name, t) for lang, by in INTENTS.items() for name, ts in by.items() for t in ts.split(", ")]
    rows += [(lang, "concept", str(i), t) for i, c in enumerate(CONCEPTS) for lang, ts in zip(LANGUAGES, c[2:], strict=True) for t in ts.split(", ")]
    return rows + [(lang, "required", str(i), t) for i, by in REQUIRED.items() for lang, ts in zip(LANGUAGES, by, strict=True) for t in ts.split(", ")]


def alias_rows() -> list[tuple[str, str, list[str], list[str]]]:
    """(type, lang, other words, those of them that require an intent)."""
    out: dict[tuple[str, str], tuple[list, list]] = {}
    for i, (_, types, *by_lang) in enumerate(CONCEPTS):
        for t in types.split():
            for k, lang in enumerate(LANGUAGES):
                own = out.setdefault((t, lang), ([], []))
                own[0].extend(by_lang[k].split(", "))
                own[1].extend(REQUIRED[i][k].split(", ") if i in REQUIRED else [])
    return [(t, lang, *own) for (t, lang), own in out.items()]


def _spaced(x: Column) -> Column:
    return F.concat(F.lit(" "), x, F.lit(" "))


def variants(queries: DataFrame) -> DataFrame:
    """norm, lang, nth, phrase, spoken, penalty: the whole query first, then phrases of its words that carry meaning, the longest first.

    Words of noise and of intents carry none. A single word of under four letters is tried only as the whole query.
    """
    stop = [F.array(*map(F.lit, sorted({*NOISE[lang].split(), *(w for ts in INTENTS[lang].values() for w in normalized_text(ts).split())}))) for lang in LANGUAGES]
    all_words = words(F.col("norm"))
    focused = F.filter(all_words, lambda t: ~F.array_contains(F.when(F.col("lang") == "pt-PT", stop[1]).otherwise(stop[0]), t))
    tried = F.array_distinct(F.concat(F.array("norm"), ngrams(focused, MOST_WORDS)))
    kept = F.filter(tried, lambda k: (k != "") & ((k == F.col("norm")) | k.contains(" ") | (F.length(k) >= LEAST_LETTERS)))
    each = queries.select("norm", "lang", F.posexplode(kept).alias("nth", "phrase"))
    return each.select("*", words(F.col("phrase")).alias("spoken"), F.when(F.col("nth") == 0, 0).otherwise(5 + F.col("nth")).alias("penalty"))


def names(labels: DataFrame) -> DataFrame:
    """lang, type, label, key, spoken, base, open_base: what each type goes by, in order of preference for each language.

    base is a name's place; open_base its place among names that require no intent, null for those that do.
    """
    spark = labels.sparkSession
    aliases = spark.createDataFrame(alias_rows(), "type string, lang string, words array<string>, required array<string>")
    plain = lambda c: F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<string>")), normalized))
    by_type = aliases.groupBy("type").agg(*(F.first(F.when(F.col("lang") == lang, F.struct("words", "required")), ignorenulls=True).alias(lang[:2]) for lang in LANGUAGES))
    every = labels.where(~F.col("type").isin(*GENERIC)).withColumnsRenamed({"en": "en_label", "pt": "pt_label"}).join(F.broadcast(by_type), "type", "left")

    def in_language(own: str, other: str, lang: str) -> DataFrame:
        keys = F.concat(F.transform(F.array(f"{own}_label", f"{other}_label", "type"), normalized), plain(F.col(own)["words"]), plain(F.col(other)["words"]))
        return every.select(F.lit(lang).alias("lang"), "type", F.col(f"{own}_label").alias("label"), keys.alias("keys"), plain(F.col(own)["required"]).alias("required"))

    both = in_language("en", "pt", "en").unionByName(in_language("pt", "en", "pt-PT"))
    each = both.select("*", F.posexplode("keys").alias("base", "key")).where(F.col("key") != "")
    before = F.size(F.filter(F.slice("keys", 1, F.col("base")), lambda k: F.array_contains("required", k)))
    open_base = F.when(~F.array_contains("required", F.col("key")), F.col("base") - before)
    return each.select("lang", "type", "label", "key", words(F.col("key")).alias("spoken"), "base", open_base.alias("open_base"))


def held_phrases(tried: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs of a tried phrase and a key (lang, key, key_spoken, ...) all of whose words the phrase has; by the key's longest word."""
    longest = F.sort_array(F.transform("key_spoken", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))[0]["w"]
    asked = tried.select("*", F.explode(F.array_distinct("spoken")).alias("word"))
    return asked.join(keys.withColumn("word", longest), ["lang", "word"]).where(F.size(F.array_except("key_spoken", "spoken")) == 0).drop("word")


def subjects(tried: DataFrame, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For each query: its intents (norm, lang, intents); the types its concepts name (norm, lang, type, hits, aligned); and
    the types that a word names which requires an intent (norm, lang, type)."""
    plain = normalized(F.col("term"))
    terms = spark.createDataFrame(term_rows(), "lang string, kind string, name string, term string").select("lang", "kind", "name", plain.alias("term"), words(plain).alias("key_spoken"))
    concepts = spark.createDataFrame([(str(i), c[0].split(), c[1].split()) for i, c in enumerate(CONCEPTS)], "name string, wanted array<string>, types array<string>")
    # fixed tables of some two hundred short rows
    met = held_phrases(tried, F.broadcast(terms)).where((F.col("kind") != "intent") | ((F.col("nth") == 0) & _spaced(F.col("phrase")).contains(_spaced(F.col("term")))))
    kind = F.col("kind")
    by_name = met.groupBy("norm", "lang", "name").agg(
        F.count_distinct(F.when(kind == "concept", F.col("nth"))).alias("hits"), F.max(kind == "required").alias("required"), F.max(kind == "intent").alias("intent")
    )
    intents = by_name.where("intent").groupBy("norm", "lang").agg(F.collect_set("name").alias("intents"))  # five at most
    about = by_name.where(~F.col("intent")).join(F.broadcast(concepts), "name").join(intents, ["norm", "lang"], "left")
    about = about.withColumn("aligned", F.coalesce(F.arrays_overlap("wanted", "intents"), F.lit(False))).withColumn("type", F.explode("types"))
    named = about.where((F.col("hits") > 0) & (F.col("aligned") | ~F.col("required"))).groupBy("norm", "lang", "type").agg(F.max("hits").alias("hits"), F.max("aligned").alias("aligned"))
    return intents, named, about.where("required").select("norm", "lang", "type").distinct()


def matches(tried: DataFrame, keys: DataFrame) -> DataFrame:
    """norm, lang, type, label, base, open_base, cost: every way a tried phrase meets a name; cost in hundredths without base."""
    keys = keys.withColumnRenamed("spoken", "key_spoken")
    phrase, key = F.col("phrase"), F.col("key")
    inside = held_phrases(tried, keys).withColumn("band", F.when(phrase == key, 0).when(_spaced(phrase).contains(_spaced(key)), 10).otherwise(20))

    def of_length(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substr(key, i, F.lit(n)))

    grams = F.array_distinct(F.concat(*(of_length(n) for n in range(1, GRAM + 1))))
    begun = tried.withColumn("gram", F.substring("phrase", 1, GRAM)).join(keys.withColumn("gram", F.explode(grams)), ["lang", "gram"]).where(key.contains(phrase)).drop("gram")
    around = begun.withColumn("band", F.when(key.startswith(phrase), 30).otherwise(40))
    cost = (F.col("penalty") + F.col("band")) * 100 - F.least(F.length(key), F.lit(99))
    return inside.unionByName(around).select("norm", "lang", "type", "label", "base", "open_base", cost.alias("cost"))


def search_types(queries: DataFrame, labels: DataFrame) -> DataFrame:
    """norm, lang, type, label, score, place: the types that each query finds, the lowest score (in hundredths) first.

    queries has norm, a normalised text, and lang; empty texts find nothing, and repeated ones are searched once. place goes by
    score, the label's length and the label. All matches are returned; MOST_RESULTS places are what a search shows.
    """
    asked = queries.select("norm", "lang").where(F.col("norm") != "").distinct()
    tried = variants(asked)
    intents, named, required = subjects(tried, queries.sparkSession)
    found = matches(tried, names(labels))
    # a type has two prices: with an intent of its concept all its names count, without it those that require none
    least = found.groupBy("norm", "lang", "type", "label").agg(F.min(F.col("cost") + F.col("base") * 100).alias("all"), F.min(F.col("cost") + F.col("open_base") * 100).alias("open"))
    on = ["norm", "lang", "type"]
    priced = least.join(named, on, "left").join(required.withColumn("barred", F.lit(True)), on, "left").join(intents, ["norm", "lang"], "left")
    aligned = F.coalesce("aligned", F.lit(False))
    priced = priced.withColumn("least", F.when(aligned, F.col("all")).when(F.col("barred").isNull(), F.col("open"))).where(F.col("least").isNotNull())
    move = F.when(F.col("hits").isNull(), 0).otherwise(-8 - F.col("hits") - F.when(aligned, 4).otherwise(0))
    for intent, types, by in MOVES:
        has = F.coalesce(F.array_contains("intents", intent), F.lit(False))
        move = move + F.when(has & F.col("type").isin(*types), by).otherwise(0)
    scored = priced.select(*on, "label", (F.col("least") + move * 100).cast("long").alias("score"))
    order = Window.partitionBy("norm", "lang").orderBy("score", F.length("label"), "label", "type")
    return scored.withColumn("place", F.row_number().over(order).cast("long"))
