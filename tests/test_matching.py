import random

import pytest

from graphmill.operators import match
from graphmill.plans import matching as plans


def table(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def words(count, seed, letters="abcdinr"):
    pick = random.Random(seed)
    make = lambda: "".join(pick.choice(letters) for _ in range(pick.randint(1, 7)))
    return sorted({" ".join(make() for _ in range(pick.randint(1, 4))) for _ in range(count)})


@pytest.mark.parametrize(("k", "floor"), [(5, 50), (3, 62.5), (2, 76), (1, 90), (4, 95)])
def test_fuzzy_finds_what_scoring_every_pair_finds(spark, k, floor):
    names = words(120, 1)
    terms = words(60, 2) + names[:20] + [n.replace("a", "", 1) for n in names[20:60] if n.replace("a", "", 1).strip()]
    left, right = table(spark, terms, "term"), table(spark, names, "alias")
    found = {(r.term, r.alias, r.score, r["rank"]) for r in match.fuzzy(left, right, k, floor).collect()}
    # Brute force on a small fixture only: every pair, scored by the same formula.
    scored = (
        left.distinct().crossJoin(right)
        .select("term", "alias", match.fuzzy_score(match.folded("term"), match.folded("alias")).alias("score"))
        .where(f"score > {floor}").collect()
    )
    wanted = set()
    for term in {r.term for r in scored}:
        best = sorted(((-r.score, r.alias) for r in scored if r.term == term))[:k]
        wanted |= {(term, alias, -score, i + 1) for i, (score, alias) in enumerate(best)}
    assert found == wanted and found


def test_fuzzy_refuses_floors_it_cannot_answer_exactly(spark):
    with pytest.raises(ValueError):
        match.fuzzy(table(spark, ["a"], "term"), table(spark, ["a"], "alias"), 1, 40)


def test_shared_word_alone_is_enough_below_ninety(spark):
    near = match.fuzzy(table(spark, ["Apple"], "term"), table(spark, ["Apple Incorporated", "Pear"], "alias"), 5, 50)
    assert [(r.alias, r.score) for r in near.collect()] == [("Apple Incorporated", 90.0)]


def test_a_hot_name_part_loses_no_match(spark):
    names = [f"holding {i:03d} trust" for i in range(150)] + ["holding"]
    found = match.fuzzy(table(spark, ["holding", "holding 007 trust"], "term"), table(spark, names, "alias"), 200, 50)
    assert found.where("term = 'holding'").count() == 151
    assert found.where("term = 'holding 007 trust' and rank = 1").first().score == 100.0


def test_ticker_hit_comes_before_name_hit(spark):
    nodes = spark.createDataFrame(
        [("Company", "MSFT", "MSFT", "Microsoft"), ("Person", "msft", None, "msft"), ("City", "Rome", None, "Rome")],
        "label string, key string, ticker string, name string",
    )
    rows = match.exact_either(table(spark, ["Msft", "ROME", "none"], "term"), nodes).collect()
    assert {(r.term, r.label) for r in rows} == {("Msft", "Company"), ("ROME", "City")}


def test_stages_settle_in_order(spark):
    dictionary = spark.createDataFrame(
        [("Alphabet Inc.", "Company", "GOOG"), ("Federal Reserve", "Fund", "Federal Reserve"), ("UK", "Country", "UK")],
        "alias string, label string, key string",
    )
    official = spark.createDataFrame(
        [("Google", "Alphabet Inc."), ("The Fed", "Federal Reserv"), ("UK", "Alphabet Inc."), ("Fog", None), ("Xy", "UK")],
        "term string, official_name string",
    )
    terms = table(spark, ["UK", "Alphabet Inc", "Google", "The Fed", "Fog", "Xy"], "term")
    rows = {r.term: (r.stage, r.key) for r in match.resolve_names(terms, dictionary, official).collect()}
    assert rows == {
        "UK": ("exact", "UK"),
        "Alphabet Inc": ("fuzzy", "GOOG"),
        "Google": ("official_exact", "GOOG"),
        "The Fed": ("official_fuzzy", "Federal Reserve"),
    }


def test_gazetteer_reads_whole_texts_and_whole_words(spark):
    long = "word " * 30000 + "General Electric, and GENERAL electric again; generals electric"
    texts = spark.createDataFrame([(1, long), (2, "nothing here"), (3, "")], "doc_id long, text string")
    found = match.gazetteer(texts, table(spark, ["General Electric", "again", "a b c d e f g h i j"], "alias"), "doc_id")
    assert {(r.doc_id, r.alias, r.pos, r.n) for r in found.collect()} == {(1, "General Electric", 30001, 2), (1, "again", 30006, 1)}


def test_decisions_choose_among_what_is_offered(spark):
    dictionary = spark.createDataFrame(
        [("Alphabet", "GOOG"), ("Meta", "META"), ("Apple Inc", "AAPL")], "alias string, ticker string"
    )

    def load():
        answers = {"Alphabit": "GOOG", "appel inc": "ZZZ", "Metal": None}

        def answer(batch):
            assert all(list(o)[0]["rank"] == 1 for o in batch["offered"])
            return ["{\"match_ticker\": %s}" % (f'"{answers[n]}"' if answers.get(n) else "null") for n in batch["name"]]

        return answer

    names = table(spark, ["Meta", "Alphabit", "Zzz", "Metal", "appel inc"], "name")
    rows = match.decide_matches(names, dictionary, load).collect()
    assert {(r.name, r.match, r.stage) for r in rows} == {("Meta", "META", "exact"), ("Alphabit", "GOOG", "decided")}
    offered = match.candidates(table(spark, ["appel inc"], "name"), dictionary).collect()
    assert [(r["rank"], r.alias, r.ticker) for r in offered] == [(1, "Apple Inc", "AAPL")]


def test_terms_are_cleaned_before_they_are_looked_up(spark):
    dictionary = spark.createDataFrame([("Acme", "Company", "ACM")], "alias string, label string, key string")
    official = spark.createDataFrame([("Mr.Road", "Acme")], "term string, official_name string")
    rows = match.resolve_names(table(spark, ["Acme plc", "Mr.Acme", "Mr.Road", "plc"], "term"), dictionary, official).collect()
    assert {(r.term, r.stage, r.key) for r in rows} == {
        ("Acme plc", "exact", "ACM"), ("Mr.Acme", "exact", "ACM"), ("Mr.Road", "official_exact", "ACM"),
    }


def test_share_of_names_that_meet_falls_with_scale(spark):
    shares = []
    for sf in ("0.001", "0.01", "0.1"):
        path = f"/root/testdata/sf{sf}"
        terms = plans.derive(spark, path, plans.TYPOS, "part").select(match.folded("term").alias("text")).distinct()
        names = plans.derive(spark, path, plans.PART_NAMES, "part").select(match.folded("alias").alias("text")).distinct()
        met = match._segment_pairs(terms, names, 0.9).count()
        shares.append(met / (terms.count() * names.count()))
    assert shares[0] > shares[1] > shares[2] and shares[2] < 0.06
