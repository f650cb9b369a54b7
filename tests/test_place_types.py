"""The dictionary in layers and the search of place types, on cases with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodeloom.functions.text import message_time, normalized
from lodeloom.plans.dictionary import category_entries, infer_types, learned_entries, seed_entries
from lodeloom.plans.type_search import GENERIC, label_rows, labels_table, search_types

RULES = {
    "en": "withdraw cash=atm|grab a coffee=cafe|buy bread=supermarket|pick up prescription=pharmacy|fill up on petrol=gas|morning workout=gym|deposit cheque at bank=bank|dinner reservation=restaurant|"
    "walk in the park=park|return book to library=library|mail a parcel=post|shop at the mall=store|dentist checkup=clinic|book a haircut=salon|catch the bus=bus|pick up kids from school=school|"
    "milk=supermarket|CAFÉ!=cafe|call mom=|finish quarterly report=|!!!=|    =|=|breadcrumbs=|buy a book=store",
    "pt-PT": "comprar pão=supermarket|tomar um café=cafe|levantar dinheiro no multibanco=atm|ir à farmácia=pharmacy|comprar um livro=store|beber um cafe=cafe|comprar pastel de nata=cafe|meter gasolina=gas|"
    "ir ao ginásio=gym|ir ao banco=bank|reserva no restaurante=restaurant|passear no parque=park|devolver livro=library|enviar encomenda=post|comprar no centro comercial=store|consulta no médico=clinic|"
    "corte de cabelo=salon|apanhar o autocarro=bus|reunião de pais=school",
}


def test_seed(spark):
    cases = [(lang, *c.split("=")) for lang, cs in RULES.items() for c in cs.split("|")] + [("en", None, "")]
    texts = spark.createDataFrame(cases, "lang string, text string, want string")
    got = infer_types(texts, F.col("text"), seed_entries(spark)).collect()
    assert len(got) == len(cases)
    assert [(r.text, r.rule_en if r.lang == "en" else r.rule_pt) for r in got if ((r.rule_en if r.lang == "en" else r.rule_pt) or "") != r.want] == []


def test_layers(spark):
    learnings = spark.createDataFrame(
        [
            (1, "en", "Buy bread", "bakery", 10, 1), (1, "en", "buy BREAD!", "market", 20, 2), (1, "en", "buy bread", "late but earlier", 5, 3),
            (1, "fr", "milk", "x", 1, 4), (1, None, "milk", "x", 1, 5), (1, "en", None, "x", 1, 6), (1, "en", " !", "x", 1, 7), (1, "en", "milk", None, 1, 8), (1, "en", "milk", "", 1, 9),
            (2, "pt-PT", "pão", "bakery", 1, 10), (1, "en", "one two three four five six seven", "long", 1, 11), (1, "en", "eggs", "farm", 1, 12), (1, "en", "beer", "bar", 1, 13),
        ],
        "uid long, lang string, keyword string, type string, at_s long, id long",
    )
    categories = spark.createDataFrame(
        [(1, 1, "Milk", ["cheese", None], "dairy"), (1, 2, "cheese", None, "cheesemonger"), (1, 3, "fruit", ["kiwi"], None), (1, 4, "eggs", [], "shed"), (2, 5, "", ["Milk"], "other"), (1, 6, "jams", [], "jam")],
        "uid long, id long, name string, synonyms array<string>, type string",
    )
    own = learned_entries(learnings).unionByName(category_entries(categories))
    cases = [
        (1, "please buy bread", "market", "dairy_none"), (2, "please buy bread", "supermarket", ""), (1, "milk", "dairy", "dairy"), (2, "milk", "other", "other"), (3, "milk", "supermarket", None),
        (1, "cheese", "cheesemonger", "cheesemonger"), (1, "kiwi fruit", "supermarket", None), (1, "eggs", "farm", "shed"), (2, "comprar pao", None, "bakery"), (1, "one two three four five six seven", "long", None),
        (1, "one two three four five six", None, None), (1, "eggs jams milk", "farm", "dairy"), (1, "beer eggs", "bar", "shed"), (None, "milk", "supermarket", None), (1, None, None, None),
    ]
    texts = spark.createDataFrame([c[:3] for c in cases], "uid long, text string, want string")
    got = infer_types(texts, F.col("text"), seed_entries(spark), own).collect()
    assert len(got) == len(cases) and [(r.uid, r.text, r.rule_en, r.want) for r in got if r.rule_en != r.want] == []
    pt = {(r.uid, r.text): r.rule_pt for r in got}
    assert [pt[c[0], c[1]] for c in cases[2:]] == [c[3] for c in cases[2:]]


#: Query, then the first type; nothing after "=" means that nothing is found.
SEARCHES = {
    "en": "gym=gym|sushi_restaurant=sushi_restaurant|sushi=sushi_restaurant|buy a book=book_store|buy a new book=book_store|purchase a novel=book_store|buy some bread=bakery|get a loaf of bread=bakery|"
    "find a place to jog=park|place to run=park|relaxing place=park|work out=gym|place to train=gym|buy flowers=florist|get coffee=coffee_shop|pick up medicine=pharmacy|buy shoes=shoe_store|go to the gym=gym|"
    "send package=post_office|mail=post_office|library=library|totally made up poi xyz=|florist=florist|=",
    "pt-PT": "ginasio=gym|comprar um livro=book_store|comprar pão=bakery|treinar=gym",
}


@pytest.fixture(scope="module")
def found(spark):
    cases = [(lang, q) for lang, cs in SEARCHES.items() for q in (c.split("=")[0] for c in cs.split("|"))] + [("en", q) for q in ("book a flight", "country", "store", "sto", "s", "buy market food")]
    queries = spark.createDataFrame(cases, "lang string, text string").withColumn("norm", normalized(F.col("text")))
    out = {}
    for r in search_types(queries, labels_table(spark)).collect():
        out.setdefault((r.lang, r.norm), []).append((r.place, r.type, r.label, r.score))
    return {k: [x[1:] for x in sorted(v)] for k, v in out.items()}


def test_first_results(found, spark):
    wrong = []
    for lang, cases in SEARCHES.items():
        for query, want in (c.split("=") for c in cases.split("|")):
            norm = spark.range(1).select(normalized(F.lit(query))).first()[0]
            got = found.get((lang, norm), [])
            if (got[0][0] if got else "") != want:
                wrong.append((query, want, got))
    assert wrong == []


def test_whole_results(found):
    assert [x[:2] for x in found["en", "gym"]] == [("gym", "Gym")] and [x[:2] for x in found["pt-PT", "ginasio"]] == [("gym", "Ginásio")]
    assert [x[:2] for x in found["en", "library"]] == [("library", "Library")]
    assert ("en", "country") not in found and "book_store" not in [x[0] for x in found.get(("en", "book a flight"), [])]
    assert "store" not in [x[0] for x in found["en", "store"]]  # too general to offer
    assert found["pt-PT", "comprar um livro"][0][1] == "Livraria" and found["pt-PT", "comprar pao"][0][1] == "Padaria"


def test_scores(found):
    # whole query, first name, less the name's length; a concept of one word, with its intent, moves it by 9 + 4
    assert found["en", "gym"][0][2] == -3 - 900 and found["en", "mail"][0][2] == 300 - 4 - 900 - 400 - 300
    # a name that begins so, and one that holds it further on
    scores = {x[0]: x[2] for x in found["en", "sto"]}
    assert scores["book_store"] == 4000 - 10 and "pet_store" in scores
    assert all(a[2] <= b[2] for xs in found.values() for a, b in zip(xs, xs[1:], strict=False))


def test_search_grows_with_matches(spark):
    """Many names and queries: each meets only names that share a word or first letters with it."""
    labels = spark.range(3000).selectExpr("concat('kind_', id) as type", "concat('Kind ', id, ' place') as en", "concat('Lugar ', id) as pt").union(spark.createDataFrame([("country", "Country", "País")], "type string, en string, pt string"))
    queries = spark.range(300).selectExpr("concat('visit kind ', id * 7, ' place today') as norm", "'en' as lang")
    got = search_types(queries, labels).where("place = 1").collect()
    assert len(got) == 300 and all(r.type == f"kind_{r.norm.split()[2]}" for r in got)


def test_built_in_names():
    rows = label_rows()
    assert len(rows) == len({r[0] for r in rows}) < 200 and {"store", "transit_station"} <= {r[0] for r in rows} & set(GENERIC)


def test_times_and_letters(spark):
    cases = [("call at 9am", "09:00"), ("at 14:30 call", "14:30"), ("3:45pm", "15:45"), ("9 PM", "21:00"), ("at 5th Avenue", None), ("at 5", "05:00"), ("12am", "00:00"), ("at 25:00", None), ("14:30", None), ("at 3rd, 4pm", "16:00"), ("", None), (None, None)]
    rows = spark.createDataFrame(cases, "x string, want string").select("x", "want", message_time(F.col("x")).alias("got")).collect()
    assert [r for r in rows if r.got != r.want] == []
    letters = spark.createDataFrame([("Ação Ñandú ẽ ſ ǅ é İ ø",)], "x string").select(normalized(F.col("x"))).first()[0]
    assert letters.startswith("acao nandu e") and "e" in letters.split()


def test_inference_deals_texts_out_few_times(spark):
    """Shuffles that are planned where nothing is broadcast, and a phrase that a text has twice."""
    texts = spark.createDataFrame([(1, "milk and milk, bread"), (1, "milk or milk"), (2, "milk")], "uid long, text string")
    learnings = spark.createDataFrame([(1, "en", "milk", "dairy", 1, 1)], "uid long, lang string, keyword string, type string, at_s long, id long")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = infer_types(texts, F.col("text"), seed_entries(spark), learned_entries(learnings))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 18
        assert {(r.uid, r.text): r.rule_en for r in found.collect()} == {(1, "milk and milk, bread"): "supermarket", (1, "milk or milk"): "dairy", (2, "milk"): "supermarket"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
