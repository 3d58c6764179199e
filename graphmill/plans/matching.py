"""Queries: exact, fuzzy and staged matching, mentions, vectors and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill.functions import clean, text
from graphmill.operators import enrich, evaluate, hooks, match, vector_index, vectors
from graphmill.operators.upsert import lookup_table
from graphmill.plans.registry import Registry
from graphmill.plans.standins import PART_NAMES, SUPPLIER_CTE, derive, duck, suppliers, table, texts
from graphmill.session import fresh_dir, stored

query = Registry()

# ---------------------------------------------------------------- names


@query(
    "exact_lookup",
    """
    SELECT p.p_partkey, p.p_name AS term, d.p_type AS label FROM part p
    JOIN (SELECT p_name, arg_max(p_type, p_partkey) AS p_type FROM part WHERE p_size > 25 GROUP BY 1) d ON p.p_name = d.p_name
    """,
)
def exact_lookup(spark, sf):
    parts = table(spark, sf, "part")
    known = parts.where("p_size > 25").select(F.col("p_name").alias("alias"), F.col("p_type").alias("label"), "p_partkey")
    known = lookup_table(known, "alias", ["label"], ["p_partkey"])
    return match.exact(parts.select("p_partkey", F.col("p_name").alias("term")), known)


NODES_SQL = "SELECT 'Company' AS label, ticker AS key, ticker, name FROM profiles"
TERM_FORMS = """SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN lower(concat('S-', CAST(l_suppkey AS STRING)))
  WHEN l_returnflag = 'A' THEN upper(concat('Supplier#', lpad(CAST(l_suppkey AS STRING), 9, '0')))
  ELSE concat('Supplier ', CAST(l_suppkey AS STRING)) END AS term FROM {lineitem}"""


def _nodes(spark, sf):
    return suppliers(spark, sf).select(F.lit("Company").alias("label"), F.col("ticker").alias("key"), "ticker", "name")


@query(
    "exact_either",
    f"""
    WITH {SUPPLIER_CTE}, nodes AS ({NODES_SQL}), terms AS ({duck(TERM_FORMS)})
    SELECT term, label, key, name FROM terms JOIN nodes ON lower(term) = lower(ticker) OR lower(term) = lower(name)
    """,
)
def exact_either(spark, sf):
    return match.exact_either(derive(spark, sf, TERM_FORMS, "lineitem"), _nodes(spark, sf))


@query(
    "exact_first_row",
    "SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1",
)
def exact_first_row(spark, sf):
    return match.first_row(table(spark, sf, "part").select("p_name", "p_partkey", "p_brand"), ["p_name"], ["p_partkey"])


# Misspelt part names: a letter lost, a word moved, a word added.
TYPOS = """SELECT DISTINCT CASE WHEN p_size < 15 THEN replace(alias, 'in', 'n') WHEN p_size < 30 THEN concat(p_brand, ' ', p_name, ' ', p_type)
  ELSE concat(alias, '0 ') END AS term FROM (SELECT *, concat(p_name, ' ', p_type, ' ', p_brand) AS alias FROM {part}) AS p"""
SHORT_TYPOS = """SELECT DISTINCT CASE WHEN p_size < 15 THEN replace(p_name, 'e', '') WHEN p_size < 30 THEN concat(p_name, ' co')
  ELSE p_type END AS term FROM {part}"""

SCORE = """round(100 * greatest(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE,
  0.95 * (1 - levenshtein(sa, sb) / greatest(length(sa), length(sb))::DOUBLE),
  0.9 * (len(list_intersect(wa, wb)) / least(len(wa), len(wb))::DOUBLE)), 6)"""


def _fuzzy_sql(terms: str, names: str, k: int, floor: int) -> str:
    fold = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
    forms = "array_to_string(list_sort(string_split({0}, ' ')), ' ') AS s{0}, list_distinct(string_split({0}, ' ')) AS w{0}"
    return f"""
    terms AS ({duck(terms)}), dict AS ({duck(names)}),
    ta AS (SELECT *, {forms.format("a")} FROM (SELECT term, {fold.format("term")} AS a FROM terms)),
    db AS (SELECT *, {forms.format("b")} FROM (SELECT alias, {fold.format("alias")} AS b FROM dict)),
    scored AS (SELECT term, alias, b, {SCORE} AS score FROM ta, db),
    near AS (SELECT term, alias, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, b) AS rank
      FROM scored WHERE score > {floor} QUALIFY rank <= {k})"""


@query("fuzzy_top1", f"WITH {_fuzzy_sql(TYPOS, PART_NAMES, 1, 90)} SELECT * FROM near")
def fuzzy_top1(spark, sf):
    return match.fuzzy(derive(spark, sf, TYPOS, "part"), derive(spark, sf, PART_NAMES, "part"), 1, 90)


SHORT_NAMES = "SELECT DISTINCT p_name AS alias FROM {part}"


@query("fuzzy_top5", f"WITH {_fuzzy_sql(SHORT_TYPOS, SHORT_NAMES, 5, 50)} SELECT * FROM near")
def fuzzy_top5(spark, sf):
    return match.fuzzy(derive(spark, sf, SHORT_TYPOS, "part"), derive(spark, sf, SHORT_NAMES, "part"), 5, 50)


# Official names given from outside: brand numbers stand for one full part name each.
OFFICIAL = """SELECT concat('alias ', p_brand) AS term, CASE WHEN p_brand < 'Brand#2' THEN min(concat(p_name, ' ', p_type, ' ', p_brand))
  ELSE concat(min(concat(p_name, ' ', p_type, ' ', p_brand)), '9') END AS official_name FROM {part} GROUP BY p_brand"""
STAGED_TERMS = f"""SELECT term FROM ({TYPOS}) AS t UNION SELECT alias FROM ({PART_NAMES}) AS n UNION SELECT term FROM ({OFFICIAL}) AS o"""
TYPED_NAMES = """SELECT concat(p_name, ' ', p_type, ' ', p_brand) AS alias, 'Product' AS label, min(p_partkey) AS key FROM {part} GROUP BY 1"""


# Terms as found in news: some carry a title or a legal form that the dictionary lacks.
DRESSED_TERMS = f"""SELECT CASE WHEN length(term) % 3 = 0 THEN concat('Mr.', term) WHEN length(term) % 3 = 1 THEN concat(term, ' plc') ELSE term END AS term
  FROM ({STAGED_TERMS}) AS s"""
CLEANED = r"trim(regexp_replace(term, '\b(Mr\.|Mrs\.|Ms\.|Dr\.|Inc\.|Corp\.|plc|Ltd\.)\b', '', 'gi'))"


@query(
    "resolve_cascade",
    f"""
    WITH dictionary AS ({duck(TYPED_NAMES)}), dressed AS ({duck(DRESSED_TERMS)}),
    given AS (SELECT DISTINCT term, {CLEANED} AS cleaned FROM dressed), official AS ({duck(OFFICIAL)}),
    all_terms AS (SELECT DISTINCT cleaned AS term FROM given WHERE cleaned <> ''),
    s1 AS (SELECT term, 'exact' AS stage, 100.0::DOUBLE AS score, label, key FROM all_terms JOIN dictionary ON term = alias),
    {_fuzzy_sql("SELECT term FROM all_terms WHERE term NOT IN (SELECT term FROM s1)", "SELECT alias FROM dictionary WHERE length(alias) > 3", 1, 90)},
    s2 AS (SELECT term, 'fuzzy' AS stage, score, label, key FROM near JOIN dictionary USING (alias)),
    left2 AS (SELECT a.term, official_name FROM all_terms a JOIN official o ON a.term = o.term
      WHERE a.term NOT IN (SELECT term FROM s1) AND a.term NOT IN (SELECT term FROM s2)),
    s3 AS (SELECT term, 'official_exact' AS stage, 100.0::DOUBLE AS score, label, key FROM left2 JOIN dictionary ON official_name = alias),
    left3 AS (SELECT * FROM left2 WHERE term NOT IN (SELECT term FROM s3)),
    {_fuzzy_sql("SELECT DISTINCT official_name AS term FROM left3", "SELECT alias FROM dictionary WHERE length(alias) > 3", 1, 90)
      .replace("terms AS", "terms4 AS").replace("FROM terms)", "FROM terms4)").replace("dict AS", "dict4 AS").replace("FROM dict)", "FROM dict4)")
      .replace("ta AS", "ta4 AS").replace("db AS", "db4 AS").replace("FROM ta, db", "FROM ta4, db4").replace("scored AS", "scored4 AS")
      .replace("FROM scored", "FROM scored4").replace("near AS", "near4 AS")},
    s4 AS (SELECT l.term, 'official_fuzzy' AS stage, score, label, key FROM left3 l JOIN near4 n ON l.official_name = n.term JOIN dictionary USING (alias)),
    settled AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)
    SELECT g.term, stage, score, label, key FROM given g JOIN settled s ON g.cleaned = s.term
    """,
)
def resolve_cascade(spark, sf):
    terms = derive(spark, sf, DRESSED_TERMS, "part")
    # Official names are known by the bare term; every spelling of it may ask for them.
    official = terms.select("term", clean.clean_name("term").alias("bare")).join(
        derive(spark, sf, OFFICIAL, "part").withColumnRenamed("term", "bare"), "bare"
    )
    return match.resolve_names(terms, derive(spark, sf, TYPED_NAMES, "part"), official.select("term", "official_name"))


def _second_choice():
    """Takes the second of several candidates; a third of the names get a ticker that nobody offered."""

    def answer(batch):
        out = []
        for name, offered in zip(batch["name"], batch["offered"], strict=True):
            ticker = "ZZZ" if len(name) % 3 == 0 else offered[min(1, len(offered) - 1)]["ticker"]
            out.append('```json\n{"match_ticker": "%s"}\n```' % ticker)
        return out

    return answer


@query(
    "decided_matches",
    f"""
    WITH dictionary AS ({duck(SHORT_NAMES)}), all_terms AS ({duck(SHORT_TYPOS)} UNION SELECT alias FROM dictionary),
    s1 AS (SELECT term AS name, upper(term) AS match, 'exact' AS stage FROM all_terms JOIN dictionary ON term = alias),
    {_fuzzy_sql("SELECT term FROM all_terms WHERE term NOT IN (SELECT name FROM s1)", "SELECT alias FROM dictionary", 5, 50)},
    counted AS (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM near)
    SELECT * FROM s1 UNION ALL SELECT term, upper(alias), 'decided' FROM counted WHERE rank = least(2, n) AND length(term) % 3 <> 0
    """,
)
def decided_matches(spark, sf):
    dictionary = derive(spark, sf, SHORT_NAMES, "part").withColumn("ticker", F.upper("alias"))
    names = derive(spark, sf, SHORT_TYPOS, "part").union(dictionary.select("alias")).distinct()
    return match.decide_matches(names.withColumnRenamed("term", "name"), dictionary, _second_choice)


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


@query(
    "mentions_gazetteer",
    f"""
    WITH b AS (SELECT {WORDS.format("text")} AS words FROM benchmark),
    phrases AS (SELECT DISTINCT array_to_string(list_slice(words, i, i + 4), ' ') AS alias
      FROM (SELECT words, unnest(generate_series(1, len(words) - 4)) AS i FROM b WHERE len(words) >= 5)),
    w AS (SELECT doc_id, {WORDS.format("text")} AS words FROM documents),
    grams AS (SELECT doc_id, i AS pos, array_to_string(list_slice(words, i, i + 4), ' ') AS gram
      FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w WHERE len(words) >= 5))
    SELECT doc_id, alias, min(pos) AS pos, count(*) AS n FROM grams JOIN phrases ON gram = alias GROUP BY 1, 2
    """,
)
def mentions_gazetteer(spark, sf):
    """Every run of five words of a benchmark passage is an alias, looked up in whole documents."""
    words = table(spark, sf, "benchmark").select(match.words_of("text").alias("w")).where("size(w) >= 5")
    runs = F.transform(
        F.sequence(F.lit(1), F.size("w") - 4), lambda i: F.array_join(F.slice(F.col("w"), i, 5), " ")
    )
    phrases = words.select(F.explode_outer(runs).alias("alias")).distinct()
    found = match.gazetteer(texts(spark, sf, "documents"), phrases, "doc_id")
    return found.withColumn("pos", F.col("pos").cast("bigint"))


# ---------------------------------------------------------------- vectors

VECTORS = "SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings"


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), vectors.as_doubles("embedding").alias("vec"), "label")


@query(
    "vector_cosine",
    f"""
    WITH v AS ({VECTORS})
    SELECT id, round(list_cosine_similarity(vec, [1.0::DOUBLE / i for i in generate_series(1, 64)]), 6) + 0.0 AS cos FROM v
    """,
)
def vector_cosine(spark, sf):
    fixed = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.lit(1.0) / i)
    return _vectors(spark, sf).select("id", (F.round(vectors.cosine(F.col("vec"), fixed), 6) + 0.0).alias("cos"))


PAIRED = f"""v AS ({VECTORS}), pairs AS (SELECT q.id AS q_id, i.id AS i_id, q.label AS q_label, i.label AS i_label,
  round(list_cosine_similarity(q.vec, i.vec), 9) + 0.0 AS cos FROM v q, v i WHERE q.id <> i.id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, i_id) AS rank FROM pairs)"""


@query(
    "knn_top1_threshold",
    f"WITH {PAIRED} SELECT q_id, i_id, round((1 + cos) / 2, 6) AS score FROM ranked WHERE rank = 1 AND cos >= 0.38",
)
def knn_top1_threshold(spark, sf):
    items = _vectors(spark, sf)
    nearest = vectors.knn(items, items, 1, 0.69, skip_self=True)
    return nearest.select("q_id", "i_id", F.round("score", 6).alias("score"))


@query("knn_top3", f"WITH {PAIRED} SELECT q_id, i_id, round(cos, 6) AS score, rank FROM ranked WHERE rank <= 3")
def knn_top3(spark, sf):
    items = _vectors(spark, sf)
    nearest = vectors.knn(items, items, 3, scale="cosine", skip_self=True)
    return nearest.select("q_id", "i_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "knn_blocks",
    f"WITH {PAIRED} SELECT q_id, i_id, round(cos, 6) AS score, rank FROM ranked WHERE rank <= 3 AND cos > 0.3",
)
def knn_blocks(spark, sf):
    """A floor as raw cosine, and only scores above it."""
    items = _vectors(spark, sf)
    nearest = vectors.knn(items, items, 3, 0.3, strict=True, scale="cosine", skip_self=True)
    return nearest.select("q_id", "i_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "knn_kept_index",
    f"""WITH v AS ({VECTORS}), pairs AS (SELECT q.id AS q_id, i.id AS i_id, round(list_cosine_similarity(q.vec, i.vec), 9) + 0.0 AS cos
      FROM v q, v i WHERE q.id <> i.id AND i.label <> (SELECT min(label) FROM v)),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY cos DESC, i_id) AS rank FROM pairs)
    SELECT q_id, i_id, round(cos, 6) AS score, rank FROM ranked WHERE rank <= 3""",
)
def knn_kept_index(spark, sf):
    """An index built once, its last day appended and its first removed; labels stand in for days."""
    items = _vectors(spark, sf).withColumn("day", F.col("label").cast("string"))
    first, last = items.agg(F.min("label"), F.max("label")).first()
    index = vector_index.build(items.where(F.col("label") != F.lit(last)), fresh_dir(spark, "vector-index"))
    vector_index.append(items.where(F.col("label") == F.lit(last)), index, 1)
    vector_index.remove_days(spark, index, [str(first)])
    nearest = vector_index.search(items, index, 3, scale="cosine", skip_self=True)
    return nearest.select("q_id", "i_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


CONTEXTS = {"labelled": "\n---\n", "lines": "\n\n", "bars": " || "}


def _context_sql(kind: str, separator: str) -> str:
    info = "concat('label ', CAST(i_label AS STRING))"
    part = f"concat('Type: Topic', chr(10), 'Name: v', CAST(i_id AS STRING), chr(10), 'Info: ', {info}, chr(10))"
    quoted = "concat(" + ", ".join("chr(10)" if c == "\n" else f"'{c}'" for c in separator) + ")"
    return f"SELECT '{kind}' AS form, q_id, string_agg({part if kind == 'labelled' else info}, {quoted} ORDER BY rank) AS context FROM ranked WHERE rank <= 5 GROUP BY 2"


@query("knn_top5_context", f"WITH {PAIRED} " + " UNION ALL ".join(_context_sql(k, v) for k, v in CONTEXTS.items()))
def knn_top5_context(spark, sf):
    items = _vectors(spark, sf)
    nodes = items.select(
        "id", F.lit("Topic").alias("label"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("label "), F.col("label").cast("string")).alias("description"),
    )
    near = stored(vectors.knn(items, items, 5, skip_self=True), "near")
    forms = [
        evaluate.context_text(near, nodes, separator, form == "labelled").withColumn("form", F.lit(form))
        for form, separator in CONTEXTS.items()
    ]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


@query(
    "similar_pairs",
    f"WITH {PAIRED} SELECT q_id AS a, i_id AS b, round(cos, 6) AS score FROM pairs WHERE q_id < i_id AND cos > 0.35",
)
def similar_pairs(spark, sf):
    pairs = vectors.similar_pairs(_vectors(spark, sf).drop("label"), 0.35)
    return pairs.select("a", "b", F.round("score", 6).alias("score"))


OWNED = f"""{PAIRED}, owned AS (SELECT least(q_label, i_label) AS a, greatest(q_label, i_label) AS b, cos,
  CASE WHEN q_label < i_label THEN q_id ELSE i_id END AS item_a, CASE WHEN q_label < i_label THEN i_id ELSE q_id END AS item_b
  FROM pairs WHERE q_id < i_id AND cos > 0.35 AND q_label <> i_label)"""


def _owned(spark, sf):
    return enrich.owner_evidence(_vectors(spark, sf).withColumnRenamed("label", "owner"), 0.35)


@query("pair_evidence", f"WITH {OWNED} SELECT a, b, count(*) AS n_evidence FROM owned GROUP BY 1, 2")
def pair_evidence(spark, sf):
    return _owned(spark, sf)[0]


@query(
    "pair_evidence_shown",
    f"""
    WITH {OWNED} SELECT a, b, rank, concat('Similar products (', CAST(CAST(round_even(cos, 2) AS DECIMAL(18, 2)) AS STRING), '): ''', CAST(item_a AS STRING),
      ''' vs ''', CAST(item_b AS STRING), '''') AS evidence, round(cos, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY cos DESC, item_a, item_b) AS rank FROM owned) WHERE rank <= 10
    """,
)
def pair_evidence_shown(spark, sf):
    shown = _owned(spark, sf)[1]
    return shown.select(
        "a", "b", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"),
        text.product_evidence("score", "item_a", "item_b").alias("evidence"),
    )


@query(
    "embed_text",
    """
    SELECT doc_id, 384::BIGINT AS dimension, 1.0::DOUBLE AS length, TRUE AS same_words_alike, TRUE AS other_words_differ,
      min(doc_id) OVER (PARTITION BY text) AS first_copy FROM documents
    """,
)
def embed_text(spark, sf):
    """Vectors of the texts, of the same words in another order, and of the texts with one word more."""
    docs = texts(spark, sf, "documents").select("doc_id", "text")
    other = F.array_join(F.reverse(F.split("text", " ")), " ")
    variants = [F.col("text"), other, F.concat("text", F.lit(" moreover"))]
    forms = F.array(*[F.struct(F.lit(i).alias("form"), v.alias("words")) for i, v in enumerate(variants)])
    rows = hooks.text_vectors(docs.select("doc_id", "text", F.explode(forms).alias("f")).select("doc_id", "text", "f.*"), "words")
    rows = rows.select("doc_id", F.xxhash64("text").alias("copy"), "form", "vec")
    by_form = rows.groupBy("doc_id", "copy").agg(
        *[F.max(F.when(F.col("form") == i, F.col("vec"))).alias(f"v{i}") for i in range(3)]
    )
    like = lambda a, b: F.coalesce(vectors.cosine(a, b), F.lit(0.0)) > 1 - 1e-9
    # Copies of a text must share one vector.
    copies = by_form.groupBy("copy").agg(F.min("doc_id").alias("first_copy"), F.count_distinct("v0").alias("vectors"))
    return by_form.join(copies.where("vectors = 1"), "copy").select(
        "doc_id", F.size("v0").cast("bigint").alias("dimension"), F.round(vectors.norm("v0"), 6).alias("length"),
        like(F.col("v0"), F.col("v1")).alias("same_words_alike"), (~like(F.col("v0"), F.col("v2"))).alias("other_words_differ"),
        "first_copy",
    )


@query(
    "resolve_exact_then_vector",
    f"""
    WITH {PAIRED}, terms AS (SELECT id, CASE WHEN label < 5 THEN concat('V-', CAST(id AS STRING)) ELSE concat('item ', CAST(id AS STRING)) END AS term FROM v)
    SELECT term, 'Topic' AS label, concat('v-', CAST(id AS STRING)) AS key, 1.0::DOUBLE AS score, 'exact' AS stage FROM terms WHERE term LIKE 'V-%'
    UNION ALL SELECT term, 'Topic', concat('v-', CAST(i_id AS STRING)), round((1 + cos) / 2, 6), 'vector'
    FROM terms JOIN ranked ON id = q_id WHERE rank = 1 AND term LIKE 'item%' AND cos >= 0.3
    """,
)
def resolve_exact_then_vector(spark, sf):
    items = _vectors(spark, sf)
    ident = F.col("id").cast("string")
    nodes = items.select(
        "id", F.lit("Topic").alias("label"), F.concat(F.lit("v-"), ident).alias("key"),
        F.concat(F.lit("v-"), ident).alias("ticker"), F.concat(F.lit("name "), ident).alias("name"),
    )
    terms = items.select("id", F.when(F.col("label") < 5, F.concat(F.lit("V-"), ident)).otherwise(F.concat(F.lit("item "), ident)).alias("term"))
    nearest = vectors.knn(items, items, 1, 0.65, skip_self=True)
    near = (
        nearest.join(terms.withColumnRenamed("id", "q_id"), "q_id")
        .join(nodes.withColumnRenamed("id", "i_id"), "i_id")
        .select("term", "label", "key", "name", F.round("score", 6).alias("score"))
    )
    return match.exact_then_vector(terms.select("term"), nodes.drop("id"), near).drop("name")


@query(
    "search_nodes",
    f"""
    WITH {SUPPLIER_CTE}
    SELECT 'Company' AS label, ticker AS key, 'ticker' AS key_field, concat('Company: ', name, chr(10), 'Description: ', description) AS search_text,
      concat('Company: ', name, ' (', ticker, '). Info: ', substring(description, 1, 400)) AS vector_text FROM profiles
    UNION ALL SELECT 'Industry', n_name, 'name', n_name, concat('Industry: ', n_name) FROM nation
    UNION ALL SELECT 'Sector', r_name, 'name', r_name, concat('Sector: ', r_name) FROM region
    UNION ALL SELECT 'Fund', p_name, 'name', p_name, concat('Financial Fund: ', p_name, '. Institutional holder.') FROM (SELECT DISTINCT p_name FROM part)
    UNION ALL SELECT 'News', CAST(doc_id AS STRING), 'name', concat('News Date: ', lang, chr(10), 'Headline: ', source, chr(10), 'Content: ', text),
      concat('News: ', CAST(doc_id AS STRING)) FROM documents
    """,
)
def search_nodes(spark, sf):
    none = F.lit(None).cast("string")

    def simple(rows, label):
        return rows.select(
            F.lit(label).alias("label"), F.col("name"), none.alias("ticker"), none.alias("description"),
            F.col("name").alias("search_text"),
        )

    companies = suppliers(spark, sf).select(
        F.lit("Company").alias("label"), "name", "ticker", "description",
        text.company_search_text("name", "description").alias("search_text"),
    )
    news = texts(spark, sf, "documents").select(
        F.lit("News").alias("label"), F.col("doc_id").cast("string").alias("name"), none.alias("ticker"),
        none.alias("description"), text.news_search_text("lang", "source", "text").alias("search_text"),
    )
    nodes = (
        companies.unionByName(news)
        .unionByName(simple(table(spark, sf, "nation").withColumnRenamed("n_name", "name"), "Industry"))
        .unionByName(simple(table(spark, sf, "region").withColumnRenamed("r_name", "name"), "Sector"))
        .unionByName(simple(table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct(), "Fund"))
        .withColumn("none", none)
    )
    return nodes.select(
        "label", text.key_of("label", "ticker", "name").alias("key"), text.key_field("label").alias("key_field"), "search_text",
        text.entity_text("label", "name", "ticker", "description", "none", "none").alias("vector_text"),
    )


@query(
    "search_vectors",
    f"""
    WITH {SUPPLIER_CTE}, nodes AS (SELECT 'Company' AS label, ticker AS key FROM profiles UNION ALL SELECT 'Industry', n_name FROM nation
      UNION ALL SELECT 'Sector', r_name FROM region UNION ALL SELECT DISTINCT 'Fund', p_name FROM part
      UNION ALL SELECT 'News', CAST(doc_id AS STRING) FROM documents)
    SELECT label, 384::BIGINT AS dimension, count(*) AS n FROM nodes GROUP BY 1
    """,
)
def search_vectors(spark, sf):
    """One vector table across labels, news by their whole text; every vector has the same length."""
    whole = F.when(F.col("label").isin("Company", "News"), F.col("search_text")).otherwise(F.col("vector_text"))
    nodes = search_nodes(spark, sf).withColumn("indexed_text", whole)
    indexed = vectors.unit_vectors(hooks.text_vectors(nodes, "indexed_text"))
    return indexed.groupBy("label", F.size("vec").cast("bigint").alias("dimension")).agg(F.count("*").alias("n"))


@query(
    "node_texts",
    """
    SELECT c_custkey AS id, concat('Person: ', c_name, '. Position: ', CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'Expert' END, ' in ',
        CASE WHEN c_nationkey > 5 THEN n_name ELSE 'S&P 500 context' END) AS person,
      concat('Company: ', c_name, ', Ticker: ', c_mktsegment) AS short, concat(CASE WHEN c_nationkey > 5 THEN n_name ELSE 'Unknown' END, ': ', c_mktsegment) AS industry
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """,
)
def node_texts(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(
        "c_custkey", "c_name", "c_mktsegment", F.lit("Person").alias("label"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("title"), F.when(F.col("c_nationkey") > 5, F.col("n_name")).alias("place"),
    )
    return rows.select(
        F.col("c_custkey").alias("id"), text.entity_text("label", "c_name", "none", "none", "title", "place").alias("person"),
        text.company_short_text("c_name", "c_mktsegment").alias("short"), text.industry_text("place", "c_mktsegment").alias("industry"),
    )
