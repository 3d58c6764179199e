import datetime

from pyspark.sql import functions as F

from graphmill import schemas
from graphmill.functions import clean, jsontext, relations, text
from graphmill.operators import evaluate


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_numbers(spark):
    cases = {"1.5": 1.5, " 7 ": 7.0, "N/A": None, "": None, "nan": None, "about 3": None, "-2e3": -2000.0, None: None}
    for raw, wanted in cases.items():
        assert one(spark, clean.clean_number("v"), v=raw) == wanted


def test_names_keep_a_title_followed_by_a_blank(spark):
    cases = {"Mr. X": "Mr. X", "Mr.X": "X", "Acme Inc.": "Acme Inc.", "Shell plc": "Shell", "SHELL PLC": "SHELL", None: ""}
    for raw, wanted in cases.items():
        assert one(spark, clean.clean_name("v"), v=raw) == wanted
    assert one(spark, clean.clean_name("v", True), v="Mr. X") == "X"
    assert one(spark, clean.clean_name("v", True), v="Acme Inc.") == "Acme"
    assert one(spark, clean.clean_name("v", True), v="Mr.X") == "Mr.X"


def test_dates_fall_back_to_the_given_day(spark):
    as_of = datetime.date(2024, 1, 2)
    for raw, wanted in {
        "Jul 8 2020": datetime.date(2020, 7, 8), " Jul 08 2020 ": datetime.date(2020, 7, 8),
        "2020-07-08": as_of, "": as_of, None: as_of,
    }.items():
        assert one(spark, clean.parse_news_date("v", "2024-01-02"), v=raw) == wanted


def test_lists_are_trimmed_and_drop_empty_parts(spark):
    assert one(spark, clean.split_list("v"), v=" a ;; b c;") == ["a", "b c"]


def test_missing_text_stays_missing(spark):
    assert one(spark, clean.prefix("v", 5), v=None) is None
    assert one(spark, clean.flatten_lines("v"), v="\t a\nb \n") == "a b"


def test_broken_json_is_null_and_a_bad_field_drops_only_itself(spark):
    assert one(spark, jsontext.officers("v"), v="{oops") is None
    rows = one(spark, jsontext.officers("v"), v='[{"name": "A", "age": "old"}, {"name": "B", "title": "CEO", "age": 5}]')
    assert [(r["name"], r["title"], r["age"]) for r in rows] == [("A", None, None), ("B", "CEO", 5)]


def test_single_quotes_are_repaired_only_without_double_quotes(spark):
    assert one(spark, jsontext.tolerant_json("v", schemas.ADDRESS)["city"], v="{'city': 'Rome'}") == "Rome"
    assert one(spark, jsontext.tolerant_json("v", schemas.ADDRESS)["city"], v="{'city': \"Rome\"}") is None


def test_responses(spark):
    body = '{"entities": ["A"], "sentiment": "POSITIVE"}'
    good = [body, f"```json\n{body}\n```", f"[{body}, {{}}]", f"Sure!\n{body} Bye", f"[{body}, 1]"]
    for response in good:
        assert one(spark, jsontext.parse_response("v", schemas.NEWS_ANALYSIS)["entities"], v=response) == ["A"]
    for response in ["", "no", "{", "[]", "[1]", None]:
        assert one(spark, jsontext.parse_response("v", schemas.NEWS_ANALYSIS), v=response) is None
    rows = spark.createDataFrame([(r,) for r in [*good, "no", "[1]", None]], "v string")
    read, rejected = jsontext.split_responses(rows, "v", schemas.NEWS_ANALYSIS)
    assert [r.parsed.entities for r in read.collect()] == [["A"]] * len(good)
    assert [r.v for r in rejected.collect()] == ["no", "[1]", None]


def test_evidence_lists_take_records_and_bare_names(spark):
    items = one(spark, jsontext.named_evidence("v", "none", "bare"), v='["X", {"name": "Y"}, {"name": "Z", "evidence": "e"}]')
    assert [tuple(i) for i in items] == [("X", "bare"), ("Y", "none"), ("Z", "e")]


def test_relation_rules(spark):
    assert one(spark, relations.pair_relation("v"), v="Partner and competitor") == "COMPETES_WITH"
    assert one(spark, relations.pair_outcome("v"), v="RELATED_ENTITY") == "same_entity"
    assert one(spark, relations.pair_outcome("v"), v=None) == "unknown"
    assert one(spark, relations.news_relation("v", "l"), v="expansion", l="City") == "AFFECTS_REGION"
    assert one(spark, relations.news_relation("v", "l"), v="investment", l="City") == "INVESTED_IN"
    assert one(spark, relations.upper_snake("v"), v="joint venture") == "JOINT_VENTURE"


def test_node_texts(spark):
    node = {"l": "Company", "n": "Acme", "t": "ACM", "d": "Makes things", "x": None}
    assert one(spark, text.company_text("n", "t", "d"), **node) == "Company: Acme (ACM). Description: Makes things"
    assert one(spark, text.company_short_text("n", "t"), **node) == "Company: Acme, Ticker: ACM"
    assert one(spark, text.labelled_text("l", "n", "x", "x"), **node) == "Company: Acme"
    assert one(spark, text.industry_text("x", "x"), **node) == "Unknown: "
    assert one(spark, text.entity_text("l", "n", "t", "x", "x", "x"), **node) == "Company: Acme (ACM). Info: "
    person = {**node, "l": "Person"}
    assert one(spark, text.entity_text("l", "n", "t", "d", "x", "x"), **person) == "Person: Acme. Position: Expert in S&P 500 context"
    assert one(spark, text.key_of("l", "t", "n"), **person) == "Acme"
    assert one(spark, text.company_search_text("n", "x"), **node) is None


def test_halves_round_to_even(spark):
    assert one(spark, text.two_decimals(F.lit(0.125)), v="") == "0.12"
    assert one(spark, text.two_decimals(F.lit(0.8)), v="") == "0.80"


def test_fact_key_does_not_depend_on_the_day(spark):
    key = one(spark, text.fact_json("a", "b", "c"), a="t", b=None, c=None)
    assert "date_recorded" not in key and '"reason":""' in key
    assert '"date_recorded":"2024-01-02"' in one(spark, text.fact_json("a", "b", "c", F.lit("2024-01-02")), a="t", b=None, c=None)


def test_verdicts(spark):
    for said, loose, strict in [(" true.", True, True), ("UNTRUE", True, False), ("FALSE", False, False), (None, False, False)]:
        assert one(spark, evaluate.verdict("v"), v=said) is loose
        assert one(spark, evaluate.verdict("v", strict=True), v=said) is strict


def test_one_bare_name_is_a_list_of_one(spark):
    for response, wanted in (('{"entities":"Apple"}', ["Apple"]), ('{"entities":["A","B"]}', ["A", "B"]), ('{"entities":[]}', []),
                             ('{"entities":""}', None), ('{"sentiment":"x"}', None)):
        assert one(spark, jsontext.parse_response("v", schemas.NEWS_ANALYSIS)["entities"], v=response) == wanted
