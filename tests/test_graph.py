import datetime

from pyspark.sql import functions as F

from graphmill.operators import build, digest, evaluate, linking, maintain, upsert
from graphmill.sources import news as news_source
from graphmill.sources import profiles as profile_source
from graphmill.sources import tables

PROFILE = (
    "seq long, ticker string, name string, sector string, industry string, market_cap string, employees string, "
    "website string, description string, officers_json string, holders_json string, address_json string"
)


def profile(spark, **values):
    rows = values.pop("rows", [values])
    columns = [c.split()[0] for c in PROFILE.split(", ")]
    return spark.createDataFrame([tuple({"seq": i, **r}.get(c) for c in columns) for i, r in enumerate(rows)], PROFILE)


def triples(edges):
    return {(r.src_key, r.rel, r.dst_key) for r in edges.collect()}


def test_an_officer_without_a_title_drops_nobody(spark):
    rows = profile(spark, ticker="T", officers_json='[{"name": "A", "title": null, "age": 1}, {"name": ""}, {"name": "B", "title": "CFO"}]')
    nodes, edges = build.people(rows)
    assert {(r.src_key, r.title) for r in edges.collect()} == {("A", ""), ("B", "CFO")}
    assert nodes.count() == 2


def test_same_named_people_merge_and_the_last_row_sets_the_age(spark):
    officer = '[{"name": "A", "title": "%s", "age": %d}]'
    rows = profile(spark, rows=[{"ticker": "T1", "officers_json": officer % ("CEO", 50)}, {"ticker": "T2", "officers_json": officer % ("CFO", 51)}])
    nodes, edges = build.people(rows)
    assert [(r.key, r.age, r.title) for r in nodes.collect()] == [("A", 51, "CFO")]
    assert edges.count() == 2


def test_missing_country_keeps_the_city(spark):
    rows = profile(
        spark,
        rows=[
            {"ticker": "T1", "address_json": '{"city": "Rome", "country": "N/A"}'},
            {"ticker": "T2", "address_json": '{"city": "N/A", "country": "Italy"}'},
            {"ticker": "T3", "address_json": '{"city": "Bonn", "state": "NRW", "country": "Germany"}'},
            {"ticker": "T4", "address_json": "broken"},
        ],
    )
    assert triples(build.geography_edges(rows)) == {
        ("T1", "LOCATED_IN", "Rome"), ("T3", "LOCATED_IN", "Bonn"), ("Bonn", "IN_STATE", "NRW"), ("NRW", "IN_COUNTRY", "Germany"),
    }


def test_company_nodes_take_the_last_row_with_its_nulls(spark):
    rows = profile(spark, rows=[{"ticker": "T", "name": "old", "market_cap": "5"}, {"ticker": "T", "name": "new", "market_cap": "N/A"}])
    node = build.company_nodes(rows, "2024-01-02").first()
    assert (node.name, node.market_cap, node.description, node.last_updated) == ("new", None, None, datetime.date(2024, 1, 2))


def test_candidates_win_over_stored_nodes(spark):
    stored = spark.createDataFrame([("Company", "A", "old"), ("Company", "B", "kept")], "label string, key string, name string")
    new = spark.createDataFrame([("Company", "A", "first", 0), ("Company", "A", "second", 1)], "label string, key string, name string, seq long")
    assert {(r.key, r.name) for r in upsert.upsert_nodes(new, stored, ["label", "key"]).collect()} == {("A", "second"), ("B", "kept")}


def test_stub_nodes_are_added_once(spark):
    nodes = spark.createDataFrame([("Company", "A", "a")], "label string, key string, name string")
    edges = spark.createDataFrame([("Company", "A", "PARTNER_WITH", "Company", "Z")] * 2, ", ".join(f"{c} string" for c in upsert.EDGE_KEY))
    assert {(r.key, r.name) for r in upsert.stub_nodes(nodes, edges).collect()} == {("A", "a"), ("Z", None)}


def test_duplicate_names_resolve_to_the_last_ticker(spark):
    rows = spark.createDataFrame([("Acme", "A1", 1), ("Acme", "A2", 2), (None, "X", 3)], "name string, ticker string, seq long")
    assert [tuple(r) for r in upsert.lookup_table(rows, "name", ["ticker"], ["seq"]).collect()] == [("Acme", "A2")]


def test_logs_ignore_a_rerun(spark):
    rows = spark.createDataFrame([("e", "f1", 1), ("e", "f2", 2), ("e", "f1", 3)], "edge string, fact string, seq long")
    log = upsert.append_absent(rows, None, ["edge"], "fact", ["seq"])
    assert {tuple(r) for r in upsert.append_absent(rows, log, ["edge"], "fact", ["seq"]).collect()} == {("e", "f1", 1), ("e", "f2", 2)}


def test_inferred_edges_are_deleted_null_safe(spark):
    edges = spark.createDataFrame(
        [("a", None, None, None), ("b", "AI Inference", None, None), ("c", None, "ev", ["x"]), ("d", "extracted", "ev", None)],
        "key string, source string, evidence string, evidence_log array<string>",
    )
    assert {r.key for r in maintain.delete_inferred(edges).collect()} == {"a", "d"}
    assert {r.key for r in maintain.delete_inferred(edges, keep_extracted=True).collect()} == {"a", "c", "d"}


def test_undirected_view_joins_both_directions(spark):
    columns = ", ".join(f"{c} string" for c in upsert.EDGE_KEY)
    rows = [("Company", "b", "PARTNER_WITH", "Company", "a"), ("Company", "a", "PARTNER_WITH", "Company", "b"), ("Company", "a", "PRODUCES", "Product", "x")]
    assert [tuple(r) for r in maintain.undirected(spark.createDataFrame(rows, columns)).collect()] == [("Company", "PARTNER_WITH", "a", "b")]


def test_digest_cuts_at_the_limit_in_order_for_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        F.col("id").alias("o"), F.concat(F.lit("- "), F.col("id").cast("string")).alias("line"),
    )
    found = {r.g: r.digest for r in digest.digest(rows, ["g"], ["o"], limit=100).collect()}
    assert found["hot"] == "\n".join(f"- {i}" for i in range(0, 5000, 3))[:100]
    whole = {r.g: r.digest for r in digest.digest(rows, ["g"], ["o"], limit=10**6).collect()}
    assert whole["hot"] == "\n".join(f"- {i}" for i in range(0, 5000, 3))


def test_section_digest_falls_back_to_content(spark):
    pages = spark.createDataFrame([(1, "sum", "body one"), (2, "sum", "body two")], "page_id long, summary string, content string")
    sections = spark.createDataFrame(
        [(1, 0, "History", "h"), (1, 1, "Products", "p1"), (1, 2, "Business", "p2"), (1, 3, "Services", "p3"), (2, 0, "History", "h")],
        "page_id long, sec_no int, title string, body string",
    )
    found = {r.page_id: r.digest for r in digest.section_digest(pages, sections).collect()}
    assert found[1] == "SUMMARY:\nsum\n\nSECTION 'PRODUCTS':\np1\n\nSECTION 'BUSINESS':\np2\n\n"
    assert found[2] == "SUMMARY:\nsum\n\nCONTENT:\nbody two"


def test_news_identity(spark):
    rows = spark.createDataFrame(
        [("h", "2024-01-01", "a", 1), ("h", "2024-01-02", "b", 2), ("h", "2024-01-02", "c", 3)], "headline string, date string, body string, seq long"
    )
    by_both = {(r.date, r.body) for r in linking.news_nodes(rows).collect()}
    assert by_both == {("2024-01-01", "a"), ("2024-01-02", "c")}
    assert [(r.date, r.body) for r in linking.news_nodes(rows, "headline").collect()] == [("2024-01-02", "c")]


def _news(spark):
    news = spark.createDataFrame([(1, "h1", "2024-01-01", None, 1), (2, "h2", "2024-01-02", "GOOD", 2)], "news_id long, headline string, date string, sentiment string, seq long")
    terms = spark.createDataFrame([(1, 0, "A"), (1, 1, "B"), (1, 2, "A"), (2, 0, "A")], "news_id long, pos int, term string")
    resolved = spark.createDataFrame([("A", "Company", "1", "a", 1.0), ("B", "City", "1", "b", 0.9)], "term string, label string, key string, name string, score double")
    return news, resolved, linking.entities(terms, resolved)


def test_interactions_need_two_entities_and_compare_label_and_key(spark):
    news, resolved, found = _news(spark)
    claims = spark.createDataFrame([(1, "?", "B", "x", None), (2, "A", "B", "x", None)], "news_id long, source string, target string, relation string, summary string")
    rows = linking.interactions(news, claims, resolved, found).collect()
    assert [(r.news_id, r.src_label, r.rel, r.dst_label, r.entry) for r in rows] == [
        (1, "Company", "AFFECTS_REGION", "City", "[2024-01-01] NEUTRAL: h1 -> h1")
    ]
    assert linking.interactions(news, claims, resolved, found, fallback=False).count() == 0


def test_history_is_idempotent(spark):
    news, resolved, found = _news(spark)
    claims = spark.createDataFrame([(1, "A", "B", "a partner", "s")], "news_id long, source string, target string, relation string, summary string")
    rows = linking.interactions(news, claims, resolved, found)
    edges, log = linking.interaction_edges(rows)
    again, log = linking.interaction_edges(rows, log)
    assert [(r.rel, r.n_entries, r.created, r.updated) for r in again.collect()] == [("PARTNER_WITH", 1, "2024-01-01", None)]


def test_separator_is_read_off_the_header(spark, tmp_path):
    for sep in ";", ",":
        path = tmp_path / f"p{ord(sep)}.csv"
        path.write_text(sep.join(["Ticker", "Name", "Description"]) + "\n" + sep.join(["T", '"a ""b"""', '"x\ny;z, "']) + "\n")
        row = profile_source.read_profiles(spark, str(path), multi_line=True).first()
        assert (row.ticker, row.name, row.description, row.sector) == ("T", 'a "b"', "x\ny;z, ", None)


def test_news_spellings(spark):
    rows = spark.createDataFrame([("h", None, "b")], "headline string, Headlines string, Description string")
    got = news_source.normalise_news(rows, "2024-01-02").first()
    assert (got.headline, got.body, got.time, got.date, got.categories) == ("h", "b", "", datetime.date(2024, 1, 2), [])


def test_rows_survive_a_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a;b", 'say "x"\nnow', None), ("c", "", "z")], "q string, a string, b string")
    tables.write_rows(rows, str(tmp_path / "rows"))
    assert {tuple(r) for r in tables.read_rows(spark, str(tmp_path / "rows"), "q string, a string, b string", multi_line=True).collect()} == {tuple(r) for r in rows.collect()}


def test_questions_give_whole_numbers_and_skip_missing_answers(spark):
    rows = profile(spark, ticker="T", name="N", employees="1234.0", market_cap="N/A", address_json="{'city': 'Rome'}")
    found = {(r.question_type, r.ground_truth) for r in evaluate.questions(rows).collect()}
    assert found == {("ticker", "T"), ("employees", "1234"), ("headquarters", "Rome")}


def test_failed_answers_count_as_wrong(spark):
    answers = spark.createDataFrame(
        [("q1", "t", "p", "TRUE", None), ("q2", "t", None, "TRUE", "timeout"), ("q3", "t", "p", None, None)],
        "question string, ground_truth string, prediction string, judgement string, error string",
    ).withColumns({"retrieved_context": F.lit("c"), "time_sec": F.lit(0.5), "question_type": F.lit(None).cast("string")})
    rows = evaluate.results(answers)
    assert {(r.question, r.is_correct, r.prediction) for r in rows.collect()} == {("q1", True, "p"), ("q2", False, "ERROR: timeout"), ("q3", False, "p")}
    assert round(evaluate.accuracy(rows).first().accuracy, 6) == round(100 / 3, 6)


def test_append_reads_only_the_parts_that_new_rows_fall_in(spark, tmp_path):
    columns = "e string, f string, day string"
    old = spark.createDataFrame([("a", "1", "d1"), ("b", "2", "d2"), ("c", "3", "d3")], columns)
    old.write.partitionBy("day").parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    new = spark.createDataFrame([("a", "1", "d1"), ("a", "9", "d1"), ("b", "8", "d2")], columns)
    wanted = sorted([("a", "1", "d1"), ("b", "2", "d2"), ("c", "3", "d3"), ("a", "9", "d1"), ("b", "8", "d2")])
    for out in (upsert.append_events(new, log, ["e"], ["f"], part="day"), upsert.append_absent(new, log, ["e"], "f", ["day"], part="day")):
        assert sorted((r.e, r.f, str(r.day)) for r in out.collect()) == wanted
