"""Queries: news nodes, mention and interaction edges, routing, inferred edges, micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill import schemas
from graphmill.functions import clean, jsontext
from graphmill.operators import enrich, hooks, linking, maintain, vectors
from graphmill.plans.matching import PAIRED, _owned, _vectors
from graphmill.plans.registry import Registry
from graphmill.plans.standins import table, texts
from graphmill.session import fresh_dir, stored
from graphmill.sources import news as news_source
from graphmill.streaming import ingest

query = Registry()
AS_OF = "2024-01-31"

# ---------------------------------------------------------------- news nodes


def _documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("news_id"), F.col("text").alias("headline"), F.col("lang").alias("date"), "source",
        F.col("doc_id").alias("seq"),
    )


@query(
    "news_nodes",
    """
    SELECT 'headline' AS identity, text AS headline, arg_max(lang, doc_id) AS date, arg_max(source, doc_id) AS source FROM documents GROUP BY text
    UNION ALL SELECT 'headline_date', text, lang, arg_max(source, doc_id) FROM documents GROUP BY text, lang
    UNION ALL SELECT 'id', text, lang, source FROM documents
    """,
)
def news_nodes(spark, sf):
    docs = _documents(spark, sf)

    def by(identity):
        nodes = linking.news_nodes(docs, identity)
        return nodes.select(F.lit(identity).alias("identity"), "headline", "date", "source")

    return by("headline").unionByName(by("headline_date")).unionByName(by("id"))


@query(
    "news_keys",
    "SELECT sha256(concat(text, chr(1), lang)) AS news_key, count(*) AS n FROM documents GROUP BY 1",
)
def news_keys(spark, sf):
    docs = _documents(spark, sf)
    return docs.groupBy(linking.news_key(["headline", "date"]).alias("news_key")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- mentions

# Turns of a conversation are the names in a news item: role and length class make the name.
TERM = "concat(role, ' ', CAST(least(length(text) // 200, 4) AS STRING))"
TERM_SPARK = "concat(role, ' ', CAST(least(length(text) div 200, 4) AS STRING))"
RESOLVED = """resolved AS (SELECT DISTINCT term, CASE WHEN term LIKE 'user%' THEN 'Person' WHEN term LIKE 'assistant%' THEN 'Company' ELSE 'City' END AS label,
  CASE WHEN term LIKE '%4' THEN 'long' ELSE term END AS key FROM terms WHERE term NOT LIKE '%1')"""
FOUND = f"""terms AS (SELECT conv_id AS news_id, turn AS pos, {TERM} AS term, text FROM conversations), {RESOLVED},
  found AS (SELECT news_id, label, key, min(pos) AS pos FROM terms JOIN resolved USING (term) GROUP BY 1, 2, 3)"""


def _terms(spark, sf):
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("news_id"), F.col("turn").alias("pos"), F.expr(TERM_SPARK).alias("term"), "text"
    )


def _resolved(terms):
    known = terms.select("term").distinct().where(~F.col("term").endswith("1"))
    return known.select(
        "term",
        F.when(F.col("term").startswith("user"), "Person").when(F.col("term").startswith("assistant"), "Company")
        .otherwise("City").alias("label"),
        F.when(F.col("term").endswith("4"), "long").otherwise(F.col("term")).alias("key"),
        F.col("term").alias("name"),
        F.length("term").cast("double").alias("score"),
    )


def _found(spark, sf):
    terms = _terms(spark, sf)
    return linking.entities(terms, _resolved(terms))


@query("news_entities", f"WITH {FOUND} SELECT news_id, label, key, pos FROM found")
def news_entities(spark, sf):
    return _found(spark, sf).select("news_id", "label", "key", "pos")


@query(
    "first_entity_per_news",
    f"""
    WITH {FOUND} SELECT news_id, label, key FROM (
      SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY pos, label, key) AS r FROM found) WHERE r = 1
    """,
)
def first_entity_per_news(spark, sf):
    return linking.first_entity(_found(spark, sf))


MATCHES = f"""{PAIRED}, matches AS (SELECT q_id AS news_id, i_label, round((1 + cos) / 2, 6) AS score FROM ranked WHERE rank = 1 AND cos >= 0.36)"""


def _nearest(spark, sf):
    items = _vectors(spark, sf)
    nearest = vectors.knn(items, items, 1, 0.68, skip_self=True)
    labels = items.select(F.col("id").alias("i_id"), F.col("label").alias("i_label"))
    return nearest.join(labels, "i_id").select(
        F.col("q_id").alias("news_id"), F.lit("Company").alias("label"), F.col("i_label").alias("key"),
        F.round("score", 6).alias("score"),
    )


@query(
    "mention_edges",
    f"WITH {MATCHES} SELECT news_id AS src_key, 'MENTIONS' AS rel, i_label AS dst_key, score FROM matches",
)
def mention_edges(spark, sf):
    news = _vectors(spark, sf).select(F.col("id").alias("news_id"), F.col("id").alias("news_key"))
    edges = linking.mention_edges(news, _nearest(spark, sf))
    return edges.select("src_key", "rel", "dst_key", "score")


@query(
    "semantic_edges",
    f"""
    WITH {MATCHES}, terms AS (SELECT label AS news_id, id AS pos, concat('t', CAST(id AS STRING)) AS term, id FROM v),
    rows AS (SELECT t.news_id, m.i_label, m.score, t.term, t.pos FROM terms t JOIN matches m ON t.id = m.news_id)
    SELECT CAST(news_id AS STRING) AS src_key, i_label AS dst_key, arg_max(score, pos) AS score, arg_max(term, pos) AS matched_term
    FROM rows GROUP BY 1, 2
    """,
)
def semantic_edges(spark, sf):
    terms = _vectors(spark, sf).select(
        F.col("label").alias("news_id"), F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term")
    )
    near = _nearest(spark, sf).select(F.concat(F.lit("t"), F.col("news_id").cast("string")).alias("term"), "key", "score")
    return linking.semantic_edges(terms, near).select("src_key", "dst_key", "score", "matched_term")


@query(
    "run_counters",
    f"""
    WITH {MATCHES} SELECT (SELECT count(*) FROM v) AS n_news, (SELECT count(*) FROM matches) AS n_linked,
      (SELECT count(*) FROM v) - (SELECT count(*) FROM matches) AS n_skipped, (SELECT count(*) FROM matches) AS n_links
    """,
)
def run_counters(spark, sf):
    news = _vectors(spark, sf).select(F.col("id").alias("news_id"))
    return maintain.run_counters(news, _nearest(spark, sf), ["news_id"])


@query(
    "category_mapping",
    """
    WITH c AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS category FROM part),
    mapping AS (SELECT category, min(p_type) FILTER (p_size > 49) AS industry FROM c JOIN part USING (p_partkey) GROUP BY 1 HAVING industry IS NOT NULL)
    SELECT CAST(p_partkey AS STRING) AS src_key, 'RELATES_TO_INDUSTRY' AS rel, industry AS dst_key
    FROM (SELECT DISTINCT p_partkey, industry FROM c JOIN mapping USING (category))
    """,
)
def category_mapping(spark, sf):
    parts = table(spark, sf, "part")
    news = parts.select(
        F.col("p_partkey").alias("news_id"), clean.split_list("p_name", " ").alias("categories"), "p_type", "p_size"
    )
    categories = news_source.category_rows(news)
    mapping = (
        news.select(F.explode("categories").alias("category"), F.when(F.col("p_size") > 49, F.col("p_type")).alias("p_type"))
        .groupBy("category").agg(F.min("p_type").alias("industry")).where("industry is not null")
    )
    edges = linking.industry_edges(linking.industry_links(categories, mapping))
    return edges.select("src_key", "rel", "dst_key")


# ---------------------------------------------------------------- interactions

CLAIMS = f"""{FOUND}, ranked AS (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY pos, label, key) AS r FROM found),
  pair AS (SELECT a.news_id, a.label AS l1, a.key AS k1, b.label AS l2, b.key AS k2 FROM ranked a JOIN ranked b ON a.news_id = b.news_id AND a.r = 1 AND b.r = 2),
  turns AS (SELECT news_id, arg_min(term, pos) AS source, arg_max(term, pos) AS target, coalesce(sum(length(text)) FILTER (pos % 2 = 0), 0) AS n,
    coalesce(sum(length(text)) FILTER (pos % 2 = 1), 0) AS m FROM terms GROUP BY 1 HAVING count(*) > 1),
  claims AS (SELECT news_id, source, target,
    CASE WHEN n * 3 > m THEN 'big partnership' WHEN n > 100 THEN 'dispute over' WHEN n > 50 THEN 'investment' ELSE 'other thing' END AS relation,
    CASE WHEN n > 80 THEN concat('sum ', CAST(n AS STRING)) END AS summary FROM turns),
  news AS (SELECT news_id, CAST(max(pos) AS BIGINT) AS n_turns, CASE WHEN max(pos) > 3 THEN 'POSITIVE' END AS sentiment FROM terms GROUP BY 1),
  ends AS (SELECT c.*, coalesce(s.label, {{l1}}) AS src_label, coalesce(s.key, {{k1}}) AS src_key, coalesce(t.label, {{l2}}) AS dst_label, coalesce(t.key, {{k2}}) AS dst_key
    FROM claims c JOIN pair USING (news_id) LEFT JOIN resolved s ON c.source = s.term LEFT JOIN resolved t ON c.target = t.term),
  rows AS (SELECT *, CAST(DATE '2024-01-01' + CAST(n_turns AS INTEGER) AS STRING) AS date,
    concat('[', CAST(DATE '2024-01-01' + CAST(n_turns AS INTEGER) AS STRING), '] ', coalesce(sentiment, 'NEUTRAL'), ': news ', CAST(news_id AS STRING), ' -> ',
      coalesce(summary, concat('news ', CAST(news_id AS STRING)))) AS entry,
    CASE WHEN relation LIKE '%partner%' THEN 'PARTNER_WITH' WHEN relation LIKE '%dispute%' THEN 'IN_DISPUTE_WITH' WHEN relation LIKE '%invest%' THEN 'INVESTED_IN'
      WHEN dst_label IN ('City', 'Country') THEN 'AFFECTS_REGION' ELSE 'RELATED_TO' END AS rel
    FROM ends JOIN news USING (news_id) WHERE src_label IS NOT NULL AND dst_label IS NOT NULL AND (src_label <> dst_label OR src_key <> dst_key))"""
FALLBACK = CLAIMS.format(l1="l1", k1="k1", l2="l2", k2="k2")
BOTH_KNOWN = CLAIMS.format(l1="NULL", k1="NULL", l2="NULL", k2="NULL")


def _interactions(spark, sf, **options):
    terms = _terms(spark, sf)
    # A claim from all turns: first and last name, and how much either side says.
    even = lambda r: F.coalesce(F.sum(F.when(F.col("pos") % 2 == r, F.length("text"))), F.lit(0))
    turns = terms.groupBy("news_id").agg(
        F.min_by("term", "pos").alias("source"), F.max_by("term", "pos").alias("target"), even(0).alias("n"), even(1).alias("m"),
        F.count("*").alias("turns"),
    )
    claims = turns.where("turns > 1").select(
        "news_id", "source", "target",
        F.when(F.col("n") * 3 > F.col("m"), "big partnership").when(F.col("n") > 100, "dispute over")
        .when(F.col("n") > 50, "investment").otherwise("other thing").alias("relation"),
        F.when(F.col("n") > 80, F.concat(F.lit("sum "), F.col("n").cast("string"))).alias("summary"),
    )
    news = (
        terms.groupBy("news_id").agg(F.max("pos").alias("n_turns"))
        .select(
            "news_id", F.concat(F.lit("news "), F.col("news_id").cast("string")).alias("headline"),
            F.expr("date_add(date'2024-01-01', cast(n_turns as int))").cast("string").alias("date"),
            F.when(F.col("n_turns") > 3, "POSITIVE").alias("sentiment"), F.col("news_id").alias("seq"),
        )
    )
    resolved = _resolved(terms)
    found = linking.entities(terms, resolved)
    return news, found, linking.interactions(news, claims, resolved, found, **options)


ROW = "news_id, src_label, src_key, rel, dst_label, dst_key, date, entry"


@query("interaction_rows", f"WITH {FALLBACK} SELECT {ROW} FROM rows")
def interaction_rows(spark, sf):
    return _interactions(spark, sf)[2].drop("seq")


@query("interaction_rows_known", f"WITH {BOTH_KNOWN} SELECT {ROW} FROM rows")
def interaction_rows_known(spark, sf):
    return _interactions(spark, sf, fallback=False)[2].drop("seq")


@query(
    "interaction_edges",
    f"""
    WITH {FALLBACK} SELECT src_label, src_key, replace(upper(relation), ' ', '_') AS rel, dst_label, dst_key, count(*) AS n_entries,
      arg_min(date, news_id) AS created, CASE WHEN count(*) > 1 THEN arg_max(date, news_id) END AS updated
    FROM rows GROUP BY 1, 2, 3, 4, 5
    """,
)
def interaction_edges(spark, sf):
    return linking.interaction_edges(_interactions(spark, sf, free_form=True)[2])[0]


@query(
    "link_or_mention_routing",
    f"""
    WITH {FALLBACK}, linked AS (SELECT DISTINCT news_id FROM rows),
    open_news AS (SELECT * FROM found WHERE news_id NOT IN (SELECT news_id FROM linked))
    SELECT 'first' AS variant, news_id, label, key FROM (
      SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY pos, label, key) AS r FROM open_news) WHERE r = 1
    UNION ALL SELECT 'all', news_id, label, key FROM open_news
    UNION ALL SELECT 'both', news_id, label, key FROM found
    """,
)
def link_or_mention_routing(spark, sf):
    news, found, linked = _interactions(spark, sf)
    parts = [
        linking.route(news, found, linked, variant).withColumn("variant", F.lit(variant))
        for variant in ("first", "all", "both")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "news_outcomes",
    f"""
    WITH {FALLBACK} SELECT news_id, CASE WHEN news_id IN (SELECT news_id FROM rows) THEN 'interaction'
      WHEN news_id IN (SELECT news_id FROM found) THEN 'mention' ELSE 'skipped' END AS outcome FROM news
    """,
)
def news_outcomes(spark, sf):
    return linking.outcomes(*_interactions(spark, sf))


# ---------------------------------------------------------------- inferred edges


# Companies: every vector, and for three labels a second company with the very same description.
COMPANIES = f"""{PAIRED}, companies AS (SELECT id, vec, label AS industry FROM v
    UNION ALL SELECT id + 1000000, vec, (label + 1) % 10 FROM v WHERE label < 3),
  alike AS (SELECT p.id AS a, q.id AS b, p.industry AS ia, q.industry AS ib, round(list_cosine_similarity(p.vec, q.vec), 9) + 0.0 AS cos
    FROM companies p JOIN companies q ON p.id < q.id)"""


def _company_pairs(spark, sf):
    companies = _vectors(spark, sf).withColumnRenamed("label", "industry")
    twins = companies.where("industry < 3").select(
        (F.col("id") + 1000000).alias("id"), "vec", ((F.col("industry") + 1) % 10).alias("industry")
    )
    return enrich.company_pairs(companies.unionByName(twins), 0.38)


@query(
    "company_pairs",
    f"""
    WITH {COMPANIES} SELECT a, b, round(cos, 6) AS score, concat('High business description similarity (',
      CAST(CAST(round_even(cos, 2) AS DECIMAL(18, 2)) AS STRING), ') in sector ', CAST(ia AS STRING)) AS evidence
    FROM alike WHERE cos > 0.38
    """,
)
def company_pairs(spark, sf):
    return enrich.listed(*_company_pairs(spark, sf)).withColumn("score", F.round("score", 6))


CANDIDATES = f"""{COMPANIES}, counted AS (
  SELECT least(q_label, i_label) AS a, greatest(q_label, i_label) AS b, count(*) AS n FROM pairs WHERE q_id < i_id AND cos > 0.35 AND q_label <> i_label GROUP BY 1, 2
  UNION ALL SELECT least(ia, ib), greatest(ia, ib), count(*) FROM alike WHERE cos > 0.38 AND ia <> ib GROUP BY 1, 2),
  candidates AS (SELECT a, b, CAST(sum(n) AS BIGINT) AS n_evidence FROM counted GROUP BY 1, 2)"""


def _candidates(spark, sf):
    return enrich.combine_candidates(_owned(spark, sf)[0], enrich.counted(*_company_pairs(spark, sf)))


@query("candidate_pairs", f"WITH {CANDIDATES} SELECT a, b, n_evidence FROM candidates")
def candidate_pairs(spark, sf):
    return enrich.by_evidence(_candidates(spark, sf))


def _judge():
    def answer(batch):
        return [
            '```json\n{"relationships": [{"type": "%s", "topic": "n%d"}, {"type": "RELATED_ENTITY"}]}\n```'
            % ("competitor" if n > 6 else "Strategic Partner" if n > 3 else "none", n)
            for n in batch["n_evidence"]
        ]

    return answer


def _decisions(spark, sf):
    """Responses of the decision hook, parsed into one row per claimed relation."""
    # Decided once: the candidates cost two searches, and the decisions are read twice.
    answered = stored(hooks.decide(_candidates(spark, sf), _judge), "decisions")
    parsed = jsontext.split_responses(answered, "response", schemas.PAIR_DECISION)[0]
    return parsed.select("a", "b", F.inline("parsed.relationships"))


@query(
    "inferred_edges",
    f"""
    WITH {CANDIDATES} SELECT CAST(a AS STRING) AS src_key, CASE WHEN n_evidence > 6 THEN 'COMPETES_WITH' ELSE 'PARTNER_WITH' END AS rel,
      CAST(b AS STRING) AS dst_key, 1::BIGINT AS n_entries, '{AS_OF}' AS created, CAST(NULL AS STRING) AS updated FROM candidates WHERE n_evidence > 3
    """,
)
def inferred_edges(spark, sf):
    decisions = _decisions(spark, sf)
    first, log = enrich.inferred_edges(enrich.inferred_facts(decisions, AS_OF))
    # A second run on a later day finds the same facts and adds nothing.
    again = enrich.inferred_facts(decisions, "2024-02-29")
    edges, _ = enrich.inferred_edges(again, log)
    dates = [F.col(c).cast("string").alias(c) for c in ("created", "updated")]
    return edges.select("src_key", "rel", "dst_key", "n_entries", *dates)


@query(
    "inferred_facts",
    f"""
    WITH {CANDIDATES} SELECT CAST(a AS STRING) AS src_key, CAST(b AS STRING) AS dst_key,
      concat(chr(123), '"topic":"n', CAST(n_evidence AS STRING), '","reason":"","specific_evidence":"Vector Inference","source":"AI Inference","date_recorded":"{AS_OF}"', chr(125)) AS entry
    FROM candidates WHERE n_evidence > 3
    """,
)
def inferred_facts(spark, sf):
    return enrich.inferred_facts(_decisions(spark, sf), AS_OF).select("src_key", "dst_key", "entry")


# ---------------------------------------------------------------- hooks and micro-batches


def _letter_counter():
    def model(texts):
        return [[float(t.count("e")), float(t.count("n")), float(len(t))] for t in texts]

    return model


@query(
    "hooks",
    """
    SELECT doc_id, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS e, CAST(length(text) AS DOUBLE) AS n FROM documents
    """,
)
def embed_hook(spark, sf):
    rows = hooks.embed(texts(spark, sf, "documents").select("doc_id", "text"), _letter_counter)
    return rows.select("doc_id", F.col("vec")[0].alias("e"), F.col("vec")[2].alias("n"))


@query(
    "news_microbatch",
    """
    SELECT concat(event_type, ' ', CAST(user_id AS STRING)) AS headline, CAST(CAST(ts AS DATE) AS STRING) AS day, 'Company' AS label, event_type AS key
    FROM events WHERE event_type <> 'error' GROUP BY ALL
    """,
)
def news_microbatch(spark, sf):
    """The events table as a stream of news, all that is there, in micro-batches."""
    static = table(spark, sf, "events")
    def link(news):
        return news.where("event_type <> 'error'").select(
            "news_key", "headline", F.col("date").alias("day"), F.lit("Company").alias("label"), F.col("event_type").alias("key")
        )

    # Three micro-batches, each with news of all times: later ones bring news older than those already stored.
    source = fresh_dir(spark, "news")
    for i in range(3):
        static.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == i).write.mode("append").parquet(source)
    files = len(spark.read.parquet(source).inputFiles())
    rows = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", str(-(-files // 3))).parquet(source)
    stream = rows.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("headline"),
        F.to_date("ts").alias("date"), "event_type",
    )
    path = fresh_dir(spark, "ingest")
    ingest.ingest_news(stream, link, path, f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/links").select("headline", F.col("day").cast("string").alias("day"), "label", "key")
