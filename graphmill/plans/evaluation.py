"""Queries: question sets, round trips, verdicts and the accuracy report."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.operators import evaluate
from graphmill.plans.registry import Registry
from graphmill.plans.standins import PROFILE_CTE, profiles, table
from graphmill.session import fresh_dir
from graphmill.sources import tables

query = Registry()

WHOLE = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS STRING) ELSE CAST({0} AS STRING) END"
QUESTIONS = f"""{PROFILE_CTE}, p AS (SELECT *, nullif(json_extract_string(address_json, '$.city'), 'N/A') AS city,
    nullif(json_extract_string(address_json, '$.state'), 'N/A') AS state,
    CASE WHEN employees <> 'nan' THEN TRY_CAST(employees AS DOUBLE) END AS emp, TRY_CAST(market_cap AS DOUBLE) AS cap,
    concat_ws(', ', 'Company: ' || name, 'Ticker: ' || ticker, 'Sector: ' || sector, 'Description: ' || description) AS context FROM profiles),
  q AS (
    SELECT concat('Under which ticker is ', name, ' listed?') AS question, ticker AS ground_truth, 'ticker' AS question_type, ticker, context FROM p
    UNION ALL SELECT concat('Which sector does ', name, ' belong to?'), sector, 'sector', ticker, context FROM p
    UNION ALL SELECT concat('Which industry does ', name, ' belong to?'), industry, 'industry', ticker, context FROM p
    UNION ALL SELECT concat('How many people does ', name, ' employ full time?'), {WHOLE.format("emp")}, 'employees', ticker, context FROM p
    UNION ALL SELECT concat('What is the market value of ', ticker, '?'), {WHOLE.format("cap")}, 'market_cap', ticker, context FROM p
    UNION ALL SELECT concat('Where does ', name, ' have its head office?'), city || ', ' || state, 'headquarters', ticker, context FROM p WHERE state IS NOT NULL
    UNION ALL SELECT concat('Which city is home to ', name, '?'), city, 'headquarters', ticker, context FROM p WHERE state IS NULL
    UNION ALL SELECT concat('What is the web address of ', name, '?'), website, 'website', ticker, context FROM p
    UNION ALL SELECT concat('What does ', name, ' do, in short?'), description, 'description', ticker, context FROM p),
  questions AS (SELECT * FROM q WHERE ground_truth IS NOT NULL)"""


@query("question_set", f"WITH {QUESTIONS} SELECT * FROM questions")
def question_set(spark, sf):
    return evaluate.questions(profiles(spark, sf))


@query(
    "question_chief_executive",
    f"""
    WITH {PROFILE_CTE} SELECT concat('Who leads ', name, ' as chief executive?') AS question, json_extract_string(officers_json, '$[0].name') AS ground_truth, ticker
    FROM profiles WHERE json_valid(officers_json)
    """,
)
def question_chief_executive(spark, sf):
    return evaluate.questions(profiles(spark, sf), ["chief_executive"]).select("question", "ground_truth", "ticker")


@query(
    "question_sample",
    f"WITH {QUESTIONS} SELECT * FROM questions ORDER BY md5(concat('7:', question)), question LIMIT 100",
)
def question_sample(spark, sf):
    return evaluate.sample_questions(evaluate.questions(profiles(spark, sf)), 100, seed=7)


@query(
    "question_roundtrip",
    f"WITH {QUESTIONS} SELECT question_type, count(*) AS n, CAST(sum(length(ground_truth)) AS BIGINT) AS answer_length FROM questions GROUP BY 1",
)
def question_roundtrip(spark, sf):
    path = fresh_dir(spark, "questions")
    made = evaluate.questions(profiles(spark, sf))
    tables.write_rows(made, path)
    stored = tables.read_rows(spark, path, made.schema.simpleString()[len("struct<") : -1].replace(":", " "))
    return stored.groupBy("question_type").agg(
        F.count("*").alias("n"), F.sum(F.length("ground_truth")).alias("answer_length")
    )


ANSWERS = """answers AS (SELECT d.doc_id, source AS question, lang AS ground_truth, CASE WHEN n_chars > 100 THEN text END AS prediction,
  CASE WHEN quality = 1 THEN ' true, it is' WHEN toxic = 1 THEN 'FALSE' WHEN quality = 0 THEN 'untrue' END AS judgement, CASE WHEN lang <> 'de' THEN lang END AS question_type
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
  results AS (SELECT doc_id, question, ground_truth, coalesce(prediction, 'ERROR: timeout') AS prediction, prediction IS NOT NULL AND coalesce(upper(judgement) LIKE '%TRUE%', FALSE) AS is_correct,
    '' AS retrieved_context, 1.23::DOUBLE AS time_sec, coalesce(question_type, 'unknown') AS question_type FROM answers)"""


def _answers(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("source").alias("question"), F.col("lang").alias("ground_truth"),
        F.when(F.col("n_chars") > 100, F.col("text")).alias("prediction"),
        F.when(F.col("quality") == 1, " true, it is").when(F.col("toxic") == 1, "FALSE").when(F.col("quality") == 0, "untrue").alias("judgement"),
        F.when(F.col("lang") != "de", F.col("lang")).alias("question_type"), F.lit("timeout").alias("error"),
        F.lit(None).cast("string").alias("retrieved_context"), F.lit(1.2345).alias("time_sec"),
    )


@query(
    "result_rows",
    f"WITH {ANSWERS} SELECT question, ground_truth, prediction, is_correct, retrieved_context, time_sec, question_type FROM results",
)
def result_rows(spark, sf):
    return evaluate.results(_answers(spark, sf))


@query(
    "accuracy_report",
    f"""
    WITH {ANSWERS} SELECT question_type, count(*) AS n, count(*) FILTER (is_correct) AS n_correct,
      (count(*) FILTER (is_correct)) * 100.0::DOUBLE / count(*) AS accuracy FROM results GROUP BY 1
    UNION ALL SELECT 'all', count(*), count(*) FILTER (is_correct), (count(*) FILTER (is_correct)) * 100.0::DOUBLE / count(*) FROM results
    """,
)
def accuracy_report(spark, sf):
    rows = evaluate.results(_answers(spark, sf))
    total = evaluate.accuracy(rows).withColumn("question_type", F.lit("all"))
    both = evaluate.accuracy(rows, ["question_type"]).unionByName(total)
    return both.withColumn("accuracy", F.col("accuracy").cast("double"))


@query(
    "wrong_answers",
    f"WITH {ANSWERS} SELECT doc_id, question, ground_truth, prediction FROM results WHERE NOT is_correct ORDER BY doc_id LIMIT 5",
)
def wrong_answers(spark, sf):
    answers = _answers(spark, sf)
    rows = answers.withColumn("is_correct", F.col("prediction").isNotNull() & evaluate.verdict("judgement"))
    wrong = evaluate.wrong_answers(rows, "doc_id")
    return wrong.select(
        "doc_id", "question", "ground_truth",
        F.coalesce("prediction", F.concat(F.lit("ERROR: "), "error")).alias("prediction"),
    )


@query(
    "results_roundtrip",
    f"""
    WITH {ANSWERS} SELECT question_type, count(*) AS n, count(*) FILTER (is_correct) AS n_correct, CAST(sum(length(prediction)) AS BIGINT) AS answer_length,
      round(sum(time_sec), 2) AS seconds FROM results GROUP BY 1
    """,
)
def results_roundtrip(spark, sf):
    """Result rows, whole predictions with their line ends, written as text and read again."""
    path = fresh_dir(spark, "results")
    made = evaluate.results(_answers(spark, sf))
    tables.write_rows(made, path)
    schema = made.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    return tables.read_rows(spark, path, schema, multi_line=True).groupBy("question_type").agg(
        F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"),
        F.sum(F.length("prediction")).alias("answer_length"), F.round(F.sum("time_sec"), 2).alias("seconds"),
    )


@query("question_preview", f"WITH {QUESTIONS} SELECT * FROM questions ORDER BY question, ticker LIMIT 5")
def question_preview(spark, sf):
    return evaluate.first_questions(evaluate.questions(profiles(spark, sf)))
