"""Queries: sources, cleaning, JSON fields, graph building, upserts and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphmill import schemas
from graphmill.functions import clean, jsontext, relations, text
from graphmill.operators import build, degrees, digest, distinct, kept_table, maintain, match, paths, upsert
from graphmill.plans.registry import Registry
from graphmill.plans.standins import (
    PROFILE_CTE, SUPPLIER_CTE, profiles, suppliers, table, texts,
)
from graphmill.session import fresh_dir, stored
from graphmill.sources import news as news_source
from graphmill.sources import profiles as profile_source
from graphmill.sources import tables

query = Registry()
AS_OF = "2024-01-31"


# ---------------------------------------------------------------- cleaning


@query(
    "clean_number",
    """
    WITH t AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'N/A' WHEN 'error' THEN '' WHEN 'signup' THEN 'nan'
      WHEN 'click' THEN CAST(value AS STRING) ELSE props END AS raw FROM events)
    SELECT event_id, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS amount FROM t
    """,
)
def clean_number(spark, sf):
    raw = F.expr(
        "CASE event_type WHEN 'view' THEN 'N/A' WHEN 'error' THEN '' WHEN 'signup' THEN 'nan' "
        "WHEN 'click' THEN CAST(value AS STRING) ELSE props END"
    )
    return table(spark, sf, "events").select("event_id", clean.clean_number(raw).alias("amount"))


@query(
    "date_parse_fallback",
    f"""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '{AS_OF}' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day
    FROM orders
    """,
)
def date_parse_fallback(spark, sf):
    shown = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", " MMM d yyyy ")).when(
        F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MMM dd yyyy")
    )
    raw = F.coalesce(shown, F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, sf, "orders").select("o_orderkey", clean.parse_news_date(raw, AS_OF).cast("string").alias("day"))


NAME_FORMS = """CASE WHEN s_acctbal < 2000 THEN concat('Mr.', s_name) WHEN s_acctbal < 4000 THEN concat('Mr. ', s_name)
  WHEN s_acctbal < 6000 THEN concat(s_name, ' PLC') WHEN s_acctbal < 8000 THEN concat(s_name, ' Inc.') ELSE concat(s_name, ' Corp.x') END"""


@query(
    "clean_names",
    rf"""
    WITH t AS (SELECT s_suppkey, {NAME_FORMS} AS raw FROM supplier)
    SELECT s_suppkey, raw,
      trim(regexp_replace(raw, '\b(Mr\.|Mrs\.|Ms\.|Dr\.|Inc\.|Corp\.|plc|Ltd\.)\b', '', 'gi')) AS coded,
      trim(regexp_replace(raw, '\b(Mr\.|Mrs\.|Ms\.|Dr\.|Inc\.|Corp\.|plc|Ltd\.)(\s|$)', '\2', 'gi')) AS whole
    FROM t
    """,
)
def clean_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", F.expr(NAME_FORMS).alias("raw")).select(
        "s_suppkey", "raw", clean.clean_name("raw").alias("coded"), clean.clean_name("raw", True).alias("whole")
    )


@query(
    "truncate_rich_text",
    r"""
    SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS flat,
      concat('Company: ', source, ' (', lang, '). Description: ', substring(text, 1, 1000)) AS rich,
      concat(lang, ': ', source, CASE WHEN text IS NULL THEN '' ELSE concat('. Info: ', substring(text, 1, 300)) END) AS labelled,
      concat(source, '. ', text) AS full_text
    FROM documents
    """,
)
def truncate_rich_text(spark, sf):
    docs = table(spark, sf, "documents").withColumn("no_ticker", F.lit(None).cast("string"))
    return docs.select(
        "doc_id",
        clean.flatten_lines("text").alias("flat"),
        text.company_text("source", "lang", "text").alias("rich"),
        text.labelled_text("lang", "source", "no_ticker", "text").alias("labelled"),
        text.news_full_text("source", "text", ". ").alias("full_text"),
    )


WORDING = """CASE event_type WHEN 'click' THEN 'Partnership deal' WHEN 'view' THEN 'is competitor of'
  WHEN 'error' THEN 'Dispute' WHEN 'signup' THEN 'same entity' ELSE NULL END"""
TARGET = "CASE WHEN value < 20 THEN 'City' WHEN value < 60 THEN 'Company' ELSE 'Country' END"


@query(
    "relation_classify",
    f"""
    WITH t AS (SELECT event_id, upper({WORDING}) AS w, {TARGET} AS label FROM events)
    SELECT event_id,
      CASE WHEN w LIKE '%COMPETE%' OR w LIKE '%COMPETITOR%' THEN 'COMPETES_WITH' WHEN w LIKE '%PARTNER%' THEN 'PARTNER_WITH' END AS pair_rel,
      CASE WHEN w LIKE '%COMPETE%' OR w LIKE '%COMPETITOR%' OR w LIKE '%PARTNER%' THEN 'kept'
           WHEN w LIKE '%RELATED%' OR w LIKE '%SAME%' THEN 'same_entity' ELSE 'unknown' END AS outcome,
      CASE WHEN w LIKE '%PARTNER%' THEN 'PARTNER_WITH' WHEN w LIKE '%DISPUTE%' THEN 'IN_DISPUTE_WITH'
           WHEN w LIKE '%INVEST%' THEN 'INVESTED_IN' WHEN label IN ('City', 'Country') THEN 'AFFECTS_REGION'
           ELSE 'RELATED_TO' END AS news_rel,
      coalesce(replace(w, ' ', '_'), 'RELATED_TO') AS snake
    FROM t
    """,
)
def relation_classify(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(WORDING).alias("w"), F.expr(TARGET).alias("label"))
    return rows.select(
        "event_id",
        relations.pair_relation("w").alias("pair_rel"),
        relations.pair_outcome("w").alias("outcome"),
        relations.news_relation("w", "label").alias("news_rel"),
        relations.upper_snake("w").alias("snake"),
    )


# ---------------------------------------------------------------- JSON fields


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", jsontext.parse_json("props", schemas._struct(k=schemas.LONG))["k"].alias("k"))


RESPONSE = """CASE o_orderpriority
  WHEN '1-URGENT' THEN concat('```json', chr(10), body, chr(10), '```')
  WHEN '2-HIGH' THEN concat('[', body, ', 1]')
  WHEN '3-MEDIUM' THEN concat('Here it is: ', body, ' Done.')
  WHEN '4-NOT SPECIFIED' THEN replace(body, '"', chr(39))
  ELSE concat('no answer ', chr(123)) END"""


@query(
    "json_lists_and_repair",
    """
    SELECT o_orderkey,
      o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS readable,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CAST(o_custkey AS STRING) END AS first_entity,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderstatus END AS sentiment,
      CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN o_orderstatus END AS repaired
    FROM orders
    """,
)
def json_lists_and_repair(spark, sf):
    entity, sentiment = F.col("o_custkey").cast("string"), F.col("o_orderstatus").alias("sentiment")
    # One name comes as a list or, in every other status, as a bare string.
    body = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(entity.alias("entities"), sentiment))).otherwise(
        F.to_json(F.struct(F.array(entity).alias("entities"), sentiment))
    )
    rows = table(spark, sf, "orders").withColumn("body", body).withColumn("response", F.expr(RESPONSE))
    parsed = jsontext.with_record(rows, "response", schemas.NEWS_ANALYSIS)
    unread = F.when(F.col("parsed").isNull(), F.col("response"))
    return parsed.select(
        "o_orderkey",
        F.col("parsed").isNotNull().alias("readable"),
        F.get("parsed.entities", F.lit(0)).alias("first_entity"),
        F.col("parsed.sentiment").alias("sentiment"),
        jsontext.tolerant_json(unread, schemas.NEWS_ANALYSIS)["sentiment"].alias("repaired"),
    )


@query(
    "response_quarantine",
    """
    SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
    """,
)
def response_quarantine(spark, sf):
    body = F.to_json(F.struct(F.array("o_orderstatus").alias("entities")))
    rows = table(spark, sf, "orders").withColumn("body", body).withColumn("response", F.expr(RESPONSE))
    return jsontext.split_responses(rows, "response", schemas.NEWS_ANALYSIS)[1].select("o_orderkey", "o_orderpriority")


OFFICER_JSON = """[{"name":"VARCHAR","title":"VARCHAR","age":"INTEGER"}]"""
HOLDER_JSON = """[{"Holder":"VARCHAR","pctHeld":"DOUBLE"}]"""
OFFICER_ROWS = f"""officers AS (SELECT seq, ticker, pos, o.name AS name, coalesce(o.title, '') AS title, o.age AS age FROM (
  SELECT seq, ticker, unnest(from_json(officers_json, '{OFFICER_JSON}')) AS o, generate_subscripts(from_json(officers_json, '{OFFICER_JSON}'), 1) AS pos
  FROM profiles WHERE json_valid(officers_json)) WHERE length(o.name) > 0)"""
HOLDER_ROWS = f"""holders AS (SELECT seq, ticker, h.Holder AS name, coalesce(h.pctHeld, 0.0) AS percentage FROM (
  SELECT seq, ticker, unnest(from_json(holders_json, '{HOLDER_JSON}')) AS h FROM profiles) WHERE length(h.Holder) > 0)"""


@query(
    "people_nodes",
    f"""
    WITH {PROFILE_CTE}, {OFFICER_ROWS},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC, pos DESC) AS r FROM officers)
    SELECT 'Person' AS label, name AS key, name, age, title FROM ranked WHERE r = 1
    """,
)
def people_nodes(spark, sf):
    return build.people(profiles(spark, sf))[0]


@query(
    "people_edges",
    f"""
    WITH {PROFILE_CTE}, {OFFICER_ROWS}
    SELECT DISTINCT 'Person' AS src_label, name AS src_key, 'WORKS_FOR' AS rel, 'Company' AS dst_label, ticker AS dst_key, title
    FROM officers
    """,
)
def people_edges(spark, sf):
    return build.people(profiles(spark, sf))[1]


@query(
    "holding_edges",
    f"""
    WITH {PROFILE_CTE}, {HOLDER_ROWS}
    SELECT DISTINCT 'Fund' AS src_label, name AS src_key, 'OWNS' AS rel, 'Company' AS dst_label, ticker AS dst_key, percentage
    FROM holders
    """,
)
def holding_edges(spark, sf):
    return build.holdings(profiles(spark, sf))[1]


@query(
    "holding_nodes",
    f"WITH {PROFILE_CTE}, {HOLDER_ROWS} SELECT DISTINCT 'Fund' AS label, name AS key, name FROM holders",
)
def holding_nodes(spark, sf):
    return build.holdings(profiles(spark, sf))[0]


CLEAN_SQL = r"trim(regexp_replace({0}, '\b(Mr\.|Mrs\.|Ms\.|Dr\.|Inc\.|Corp\.|plc|Ltd\.)\b', '', 'gi'))"


@query(
    "alias_dictionary",
    f"""
    WITH {PROFILE_CTE}, place AS (SELECT seq, nullif(json_extract_string(address_json, '$.city'), 'N/A') AS city,
      nullif(json_extract_string(address_json, '$.country'), 'N/A') AS country FROM profiles),
    people AS (SELECT seq, unnest(from_json(officers_json, '{OFFICER_JSON}')) AS o,
      generate_subscripts(from_json(officers_json, '{OFFICER_JSON}'), 1) AS pos FROM profiles WHERE json_valid(officers_json)),
    funds AS (SELECT seq, unnest(from_json(holders_json, '{HOLDER_JSON}')) AS h,
      generate_subscripts(from_json(holders_json, '{HOLDER_JSON}'), 1) AS pos FROM profiles),
    entries AS (
      SELECT seq, 1 AS part, 0 AS pos, name AS alias, 'Company' AS label, ticker AS key, 'ticker' AS key_field FROM profiles
      UNION ALL SELECT seq, 2, 0, ticker, 'Company', ticker, 'ticker' FROM profiles
      UNION ALL SELECT seq, 3, pos, {CLEAN_SQL.format("o.name")}, 'Person', {CLEAN_SQL.format("o.name")}, 'name' FROM people
        WHERE length({CLEAN_SQL.format("o.name")}) > 3
      UNION ALL SELECT seq, 4, pos, {CLEAN_SQL.format("h.Holder")}, 'Fund', {CLEAN_SQL.format("h.Holder")}, 'name' FROM funds
        WHERE length({CLEAN_SQL.format("h.Holder")}) > 3
      UNION ALL SELECT seq, 5, 0, city, 'City', city, 'name' FROM place WHERE city IS NOT NULL
      UNION ALL SELECT seq, 6, 0, country, 'Country', country, 'name' FROM place WHERE country IS NOT NULL)
    SELECT alias, label, key, key_field FROM (
      SELECT *, row_number() OVER (PARTITION BY alias ORDER BY seq DESC, part DESC, pos DESC) AS r FROM entries) WHERE r = 1
    """,
)
def alias_dictionary(spark, sf):
    return build.alias_table(profiles(spark, sf))


# ---------------------------------------------------------------- building


@query(
    "company_nodes",
    f"""
    WITH {PROFILE_CTE}
    SELECT 'Company' AS label, ticker AS key, name, substring(description, 1, 500) AS description, website,
      TRY_CAST(market_cap AS DOUBLE) AS market_cap,
      CASE WHEN employees = 'nan' THEN NULL ELSE TRY_CAST(employees AS DOUBLE) END AS employees,
      '{AS_OF}' AS last_updated
    FROM profiles
    """,
)
def company_nodes(spark, sf):
    return build.company_nodes(profiles(spark, sf), AS_OF).withColumn("last_updated", F.col("last_updated").cast("string"))


EDGE_COLUMNS = "src_label, src_key, rel, dst_label, dst_key"


@query(
    "hierarchy_edges",
    f"""
    WITH {SUPPLIER_CTE}
    SELECT 'Company' AS src_label, ticker AS src_key, 'BELONGS_TO' AS rel, 'Industry' AS dst_label, industry AS dst_key FROM profiles
    UNION SELECT 'Industry', industry, 'PART_OF', 'Sector', sector FROM profiles
    """,
)
def hierarchy_edges(spark, sf):
    return build.hierarchy_edges(suppliers(spark, sf), "taxonomy")


@query("hierarchy_paths", f"WITH {SUPPLIER_CTE} SELECT ticker AS company, industry, sector FROM profiles")
def hierarchy_paths(spark, sf):
    return build.company_paths(hierarchy_edges(spark, sf))


KNOWN = "nullif(nullif(sector, 'N/A'), '') AS sector, nullif(nullif(industry, 'N/A'), '') AS industry"


@query(
    "hierarchy_variants",
    f"""
    WITH {PROFILE_CTE}, t AS (SELECT ticker, {KNOWN} FROM profiles)
    SELECT 'nested' AS variant, 'Company' AS src_label, ticker AS src_key, 'OPERATES_IN_INDUSTRY' AS rel, 'Industry' AS dst_label, industry AS dst_key
      FROM t WHERE sector IS NOT NULL AND industry IS NOT NULL
    UNION SELECT 'nested', 'Industry', industry, 'PART_OF', 'Sector', sector FROM t WHERE sector IS NOT NULL AND industry IS NOT NULL
    UNION SELECT 'nested', 'Company', ticker, 'OPERATES_IN_SECTOR', 'Sector', sector FROM t WHERE sector IS NOT NULL AND industry IS NULL
    UNION SELECT 'independent', 'Company', ticker, 'OPERATES_IN_SECTOR', 'Sector', sector FROM t WHERE sector IS NOT NULL
    UNION SELECT 'independent', 'Company', ticker, 'OPERATES_IN_INDUSTRY', 'Industry', industry FROM t WHERE industry IS NOT NULL
    UNION SELECT 'independent', 'Industry', industry, 'PART_OF', 'Sector', sector FROM t WHERE sector IS NOT NULL AND industry IS NOT NULL
    """,
)
def hierarchy_variants(spark, sf):
    rows = profiles(spark, sf)
    nested = build.hierarchy_edges(rows, "nested").withColumn("variant", F.lit("nested"))
    return nested.unionByName(build.hierarchy_edges(rows, "independent").withColumn("variant", F.lit("independent")))


@query(
    "geography_chain",
    f"""
    WITH {PROFILE_CTE}, t AS (SELECT ticker, nullif(json_extract_string(address_json, '$.city'), 'N/A') AS city,
      nullif(json_extract_string(address_json, '$.state'), 'N/A') AS state,
      nullif(json_extract_string(address_json, '$.country'), 'N/A') AS country FROM profiles),
    g AS (SELECT * FROM t WHERE city IS NOT NULL)
    SELECT 'Company' AS src_label, ticker AS src_key, 'LOCATED_IN' AS rel, 'City' AS dst_label, city AS dst_key FROM g
    UNION SELECT 'City', city, 'IN_STATE', 'State', state FROM g WHERE state IS NOT NULL
    UNION SELECT 'State', state, 'IN_COUNTRY', 'Country', country FROM g WHERE state IS NOT NULL AND country IS NOT NULL
    UNION SELECT 'City', city, 'IN_COUNTRY', 'Country', country FROM g WHERE state IS NULL AND country IS NOT NULL
    """,
)
def geography_chain(spark, sf):
    return build.geography_edges(profiles(spark, sf))


@query(
    "chain_ends",
    f"""
    WITH RECURSIVE edges AS (SELECT src_label, src_key, dst_label, dst_key FROM ({query.sql["geography_chain"]})
      UNION SELECT src_label, src_key, dst_label, dst_key FROM ({query.sql["hierarchy_edges"]})),
    way AS (SELECT src_label, src_key, dst_label, dst_key, 1::BIGINT AS hops FROM edges
      UNION ALL SELECT w.src_label, w.src_key, e.dst_label, e.dst_key, w.hops + 1 FROM way w
        JOIN edges e ON e.src_label = w.dst_label AND e.src_key = w.dst_key WHERE w.dst_label NOT IN ('Sector', 'Country'))
    SELECT src_label, src_key, dst_label, dst_key, min(hops) AS hops FROM way WHERE dst_label IN ('Sector', 'Country') GROUP BY ALL
    """,
)
def chain_ends(spark, sf):
    """Every node to its sectors and countries, over chains of any length."""
    edges = geography_chain(spark, sf).unionByName(hierarchy_edges(spark, sf), allowMissingColumns=True)
    return paths.chain_ends(edges, "Sector", "Country")


def _details(spark, sf):
    parts = table(spark, sf, "part")
    empty = F.array().cast("array<string>")
    return parts.select(
        F.col("p_brand").alias("ticker"),
        clean.split_list(F.replace("p_name", F.lit(" "), F.lit(" ; "))).alias("products"),
        F.array("p_type", F.lit("")).alias("markets"),
        F.when(F.col("p_size") > 25, F.array("p_name")).alias("subsidiaries"),
        empty.alias("partners"),
        empty.alias("competitors"),
    )


@query(
    "list_relations_explode",
    """
    SELECT DISTINCT 'Company' AS src_label, p_brand AS src_key, 'PRODUCES' AS rel, 'Product' AS dst_label, unnest(string_split(p_name, ' ')) AS dst_key FROM part
    UNION SELECT 'Company', p_brand, 'SERVES_MARKET', 'Market', p_type FROM part
    UNION SELECT 'Company', p_brand, 'OWNS_SUBSIDIARY', 'Organization', p_name FROM part WHERE p_size > 25
    """,
)
def list_relations_explode(spark, sf):
    return build.list_relations(_details(spark, sf))


@query(
    "extraction_tables",
    """
    SELECT DISTINCT 'Company' AS src_label, p_brand AS src_key, rel, 'Organization' AS dst_label, name AS dst_key, evidence FROM (
      SELECT p_brand, 'PARTNER_WITH' AS rel, p_name AS name, concat('size ', CAST(p_size AS STRING)) AS evidence FROM part WHERE p_size > 25
      UNION ALL SELECT p_brand, 'PARTNER_WITH', p_name, 'No evidence provided' FROM part WHERE p_size <= 25
      UNION ALL SELECT p_brand, 'COMPETES_WITH', p_type, 'Mentioned as competitor in text' FROM part
      UNION ALL SELECT p_brand, 'COMPETES_WITH', p_name, 'Mentioned as competitor' FROM part)
    """,
)
def extraction_tables(spark, sf):
    partner = F.when(
        F.col("p_size") > 25,
        F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("evidence")))),
    ).otherwise(F.to_json(F.array(F.struct(F.col("p_name").alias("name")))))
    rival = F.concat(F.lit('["'), "p_type", F.lit('", {"name": "'), "p_name", F.lit('"}]'))
    rows = table(spark, sf, "part").select(
        "p_brand",
        jsontext.named_evidence(partner, "No evidence provided", "").alias("partners"),
        jsontext.named_evidence(rival, "Mentioned as competitor", "Mentioned as competitor in text").alias("rivals"),
    )

    def side(column, rel):
        return rows.select("p_brand", F.lit(rel).alias("rel"), F.inline(column))

    return (
        side("partners", "PARTNER_WITH").unionByName(side("rivals", "COMPETES_WITH"))
        .select(
            F.lit("Company").alias("src_label"), F.col("p_brand").alias("src_key"), "rel",
            F.lit("Organization").alias("dst_label"), F.col("name").alias("dst_key"), "evidence",
        )
        .distinct()
    )


def _same_number():
    """Takes the candidate whose number is the name's, if there is one."""

    def answer(batch):
        out = []
        for name, offered in zip(batch["name"], batch["offered"], strict=True):
            same = [c["ticker"] for c in offered if c["alias"][-9:] == name[-9:]]
            out.append('{"match_ticker": %s}' % (f'"{same[0]}"' if same else "null"))
        return out

    return answer


@query(
    "known_company_edges",
    f"""
    WITH {SUPPLIER_CTE}, dict AS (SELECT name AS alias, ticker FROM profiles),
    rows AS (SELECT 'S-' || CAST(l_suppkey AS STRING) AS src, CASE WHEN l_returnflag = 'R' THEN 'COMPETES_WITH' ELSE 'PARTNER_WITH' END AS rel,
      p_brand AS evidence, l_orderkey * 10 + l_linenumber AS seq, l_quantity,
      CASE WHEN l_linestatus = 'F' THEN 'S-' || CAST(CAST(l_quantity AS BIGINT) AS STRING) ELSE 'S-0' END AS dst
      FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT 'Company' AS src_label, src AS src_key, rel, 'Company' AS dst_label, dst AS dst_key, evidence FROM (
      SELECT *, row_number() OVER (PARTITION BY src, rel, dst ORDER BY seq DESC) AS r FROM rows JOIN dict ON dst = ticker WHERE src <> dst) WHERE r = 1
    """,
)
def known_company_edges(spark, sf):
    known = suppliers(spark, sf).select(F.col("name").alias("alias"), "ticker")
    items = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    target = F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("bigint")).otherwise(F.lit(0))
    mentions = items.select(
        F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("ticker"),
        F.when(F.col("l_returnflag") == "R", "COMPETES_WITH").otherwise("PARTNER_WITH").alias("rel"),
        # A third of the names are misspelt.
        F.concat(F.when(F.col("l_returnflag") == "A", "Supplier ").otherwise("Supplier#"), F.lpad(target.cast("string"), 9, "0")).alias("name"),
        F.col("p_brand").alias("evidence"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    # Read by several joins of the matching: without storing them, each would scan the items again.
    names = stored(mentions.select("name").distinct(), "names")
    resolved = match.decide_matches(names, known, _same_number, floor=90.0)
    return build.known_company_edges(mentions, resolved, AS_OF).drop("source", "last_updated")


# ---------------------------------------------------------------- upserts and logs


@query(
    "node_upsert_last_wins",
    """
    SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1
    """,
)
def node_upsert_last_wins(spark, sf):
    return upsert.last_write(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(
    "kept_table_changes",
    """
    WITH f AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    o AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1),
    p AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
    one AS (SELECT * FROM o UNION ALL SELECT * FROM f WHERE o_custkey NOT IN (SELECT o_custkey FROM o)),
    two AS (SELECT * FROM one WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 2000)),
    three AS (SELECT * FROM two UNION ALL SELECT * FROM p WHERE o_custkey NOT IN (SELECT o_custkey FROM two)),
    versions AS (SELECT 0 AS version, * FROM f UNION ALL SELECT 1, * FROM one UNION ALL SELECT 2, * FROM two UNION ALL SELECT 3, * FROM three)
    SELECT version, o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM versions JOIN orders USING (o_orderkey, o_custkey)
    """,
)
def kept_table_changes(spark, sf):
    """Last orders of customers as a kept table: upserts, deletes and get-or-create, and every version read back."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    kept = kept_table.build(orders.where("o_orderstatus = 'F'"), fresh_dir(spark, "kept-table"), ["o_custkey"], ["o_orderkey"])
    kept.upsert(orders.where("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'"), 1, ["o_orderkey"])
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal < 2000")
    kept.remove(gone.select(F.col("c_custkey").alias("o_custkey")), 2)
    kept.add_absent(orders.where("o_orderstatus <> 'F'"), 3, ["o_orderkey"])
    first, *later = [kept.read(version).select(F.lit(version).alias("version"), "*") for version in range(4)]
    for rows in later:
        first = first.unionByName(rows)
    return first


@query(
    "node_merge_stored",
    """
    WITH last AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r
      FROM orders WHERE o_orderstatus = 'F')
    SELECT 'Company' AS label, c_custkey AS key, coalesce(o_orderpriority, c_mktsegment) AS name
    FROM customer LEFT JOIN last ON c_custkey = o_custkey AND r = 1
    UNION ALL SELECT 'Visitor', o_custkey, arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey
    """,
)
def node_merge_stored(spark, sf):
    stored = table(spark, sf, "customer").select(
        F.lit("Company").alias("label"), F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("name")
    )
    new = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "Company").otherwise("Visitor").alias("label"), F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"),
        F.col("o_orderkey").alias("seq"),
    )
    return upsert.upsert_nodes(new, stored, ["label", "key"]).drop("seq")


def _holding_edges(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.lit("Company").alias("src_label"), F.col("l_suppkey").alias("src_key"), F.lit("PRODUCES").alias("rel"),
        F.lit("Product").alias("dst_label"), F.col("l_partkey").alias("dst_key"), F.col("l_returnflag").alias("ident"),
    )


@query("edge_upsert_with_property", "SELECT DISTINCT l_suppkey AS src_key, l_partkey AS dst_key, l_returnflag AS ident FROM lineitem")
def edge_upsert_with_property(spark, sf):
    edges = upsert.upsert_edges(_holding_edges(spark, sf), identity=[*upsert.EDGE_KEY, "ident"])
    return edges.select("src_key", "dst_key", "ident")


@query("edge_upsert", "SELECT DISTINCT l_suppkey AS src_key, l_partkey AS dst_key FROM lineitem")
def edge_upsert(spark, sf):
    return upsert.upsert_edges(_holding_edges(spark, sf).drop("ident")).select("src_key", "dst_key")


@query(
    "stub_nodes",
    """
    SELECT 'Product' AS label, p_partkey AS key, p_name AS name FROM part WHERE p_size > 25
    UNION ALL SELECT DISTINCT 'Product', l_partkey, NULL FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)
    """,
)
def stub_nodes(spark, sf):
    known = table(spark, sf, "part").where("p_size > 25").select(
        F.lit("Product").alias("label"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name")
    )
    return upsert.stub_nodes(known, _holding_edges(spark, sf), "Product")


@query(
    "key_uniqueness",
    """
    SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1
    """,
)
def key_uniqueness(spark, sf):
    days = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return upsert.key_violations(days, ["o_custkey", "day"]).withColumn("day", F.col("day").cast("string"))


@query(
    "evidence_log_append",
    """
    WITH e AS (SELECT user_id, event_type AS fact, event_id, ts < TIMESTAMP '2024-01-11' AS old FROM events),
    stored AS (SELECT user_id, fact, min(event_id) AS event_id FROM e WHERE old GROUP BY 1, 2),
    fresh AS (SELECT user_id, fact, min(event_id) AS event_id FROM e WHERE NOT old GROUP BY 1, 2)
    SELECT * FROM stored UNION ALL SELECT f.* FROM fresh f LEFT JOIN stored s USING (user_id, fact) WHERE s.event_id IS NULL
    """,
)
def evidence_log_append(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_type").alias("fact"), "event_id", "ts")
    old = F.col("ts") < F.lit("2024-01-11").cast("timestamp")
    stored = upsert.append_absent(rows.where(old).drop("ts"), None, ["user_id"], "fact", ["event_id"])
    return upsert.append_absent(rows.where(~old).drop("ts"), stored, ["user_id"], "fact", ["event_id"])


@query(
    "history_append",
    """
    SELECT user_id, event_type, count(*) AS n_entries, CAST(CAST(arg_min(ts, event_id) AS DATE) AS STRING) AS created,
      CASE WHEN count(*) > 1 THEN CAST(CAST(arg_max(ts, event_id) AS DATE) AS STRING) END AS updated
    FROM events GROUP BY 1, 2
    """,
)
def history_append(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.to_date("ts").cast("string").alias("day"))
    edge = ["user_id", "event_type"]
    # The same batch arrives twice; the second arrival adds nothing.
    log = upsert.append_events(rows.unionByName(rows), None, edge, ["event_id"])
    return upsert.log_summary(upsert.append_events(rows, log, edge, ["event_id"]), edge, "day", ["event_id"])


# ---------------------------------------------------------------- maintenance


@query(
    "optional_match",
    """
    SELECT 'Company' AS label, c_custkey AS key, c_name AS name, o_orderkey AS order_key
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'
    """,
)
def optional_match(spark, sf):
    nodes = table(spark, sf, "customer").select(
        F.lit("Company").alias("label"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    edges = table(spark, sf, "orders").select(
        F.lit("Company").alias("src_label"), F.col("o_custkey").alias("src_key"), F.col("o_orderpriority").alias("rel"),
        F.col("o_orderkey").alias("dst_key"),
    )
    return maintain.optional_match(nodes, edges, "1-URGENT", "order_key")


@query(
    "unlinked_antijoin",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
)
def unlinked_antijoin(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return maintain.unlinked(table(spark, sf, "customer").select("c_custkey", "c_name"), urgent, ["c_custkey"])


def _part_graph(spark, sf):
    nodes = table(spark, sf, "part").select(F.lit("Product").alias("label"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    companies = table(spark, sf, "supplier").select(F.lit("Company").alias("label"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    # Every row is an edge; some lead to bundles, which leaves products without one.
    target = F.when(F.expr("l_returnflag = 'R' and l_quantity > 45"), "Product").otherwise("Bundle")
    sold = table(spark, sf, "lineitem").select(
        F.lit("Company").alias("src_label"), F.col("l_suppkey").alias("src_key"), F.lit("PRODUCES").alias("rel"),
        target.alias("dst_label"), F.col("l_partkey").alias("dst_key"),
    )
    return nodes.unionByName(companies), upsert.upsert_edges(sold)


SOLD = "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45"


@query("orphan_nodes", f"SELECT 'Product' AS label, p_partkey AS key, p_name AS name FROM part WHERE p_partkey NOT IN ({SOLD})")
def orphan_nodes(spark, sf):
    return maintain.orphans(*_part_graph(spark, sf), "Product")


@query(
    "orphan_delete_counts",
    f"""
    SELECT 'Company' AS label, count(*) AS n FROM supplier
    UNION ALL SELECT 'Product', count(*) FROM part WHERE p_partkey IN ({SOLD})
    """,
)
def orphan_delete_counts(spark, sf):
    return maintain.delete_orphans(*_part_graph(spark, sf), "Product").groupBy("label").agg(F.count("*").alias("n"))


@query(
    "degrees_under_change",
    """
    WITH kept AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem
      EXCEPT SELECT l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal < 0),
    linked AS (SELECT l_partkey, count(*) AS degree FROM kept GROUP BY 1)
    SELECT p_partkey AS key, coalesce(degree, 0) AS degree FROM part LEFT JOIN linked ON p_partkey = l_partkey
    """,
)
def degrees_under_change(spark, sf):
    """Edges of parts come in two batches and those of suppliers in debt go; degrees and orphans from the changes alone."""
    made = table(spark, sf, "lineitem").select(
        F.lit("Company").alias("src_label"), F.col("l_suppkey").alias("src_key"), F.lit("PRODUCES").alias("rel"),
        F.lit("Product").alias("dst_label"), F.col("l_partkey").alias("dst_key"), (F.col("l_returnflag") == "R").alias("early"),
    )
    made = made.groupBy(*upsert.EDGE_KEY).agg(F.max("early").alias("early"))
    debt = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("src_key"))
    at = fresh_dir(spark, "degrees")
    degrees.add(at, 0, made.where("early"))
    degrees.add(at, 1, made.where("not early"), made.join(debt, "src_key", "left_semi"))
    parts = table(spark, sf, "part").select(F.lit("Product").alias("label"), F.col("p_partkey").alias("key"))
    alone = degrees.orphans(parts, at, "Product").select("key", F.lit(0).cast("long").alias("degree"))
    linked = degrees.degrees(spark, at).where("label = 'Product'").select("key", "degree")
    return alone.unionByName(linked)


@query(
    "detach_delete",
    """
    SELECT 'node' AS kind, 'Company' AS name, count(*) AS n FROM supplier
    UNION ALL SELECT 'edge', 'LOCATED_IN', count(*) FROM supplier
    UNION ALL SELECT 'edge', 'PRODUCES', count(DISTINCT (l_suppkey, l_partkey)) FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity > 45)
    """,
)
def detach_delete(spark, sf):
    nodes, edges = _part_graph(spark, sf)
    located = table(spark, sf, "supplier").select(
        F.lit("Company").alias("src_label"), F.col("s_suppkey").alias("src_key"), F.lit("LOCATED_IN").alias("rel"),
        F.lit("Country").alias("dst_label"), F.col("s_nationkey").cast("bigint").alias("dst_key"),
    )
    kept_nodes, kept_edges = maintain.detach_delete(nodes, edges.unionByName(located), "Product")
    counted = kept_nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return counted.unionByName(
        kept_edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n"))
    )


def _rated_edges(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", "COMPETES_WITH").when(F.col("lang") == "fr", "PARTNER_WITH").otherwise("OTHER").alias("rel"),
        F.when(F.col("quality") == 1, F.col("source")).alias("evidence"),
        F.when(F.col("toxic") == 1, F.array("source")).alias("evidence_log"),
        F.when(F.col("toxic") == 1, "Inference + Others").when(F.col("quality") == 1, "extracted").alias("source"),
    )


RATED = """rated AS (SELECT d.doc_id, CASE WHEN lang = 'en' THEN 'COMPETES_WITH' WHEN lang = 'fr' THEN 'PARTNER_WITH' ELSE 'OTHER' END AS rel,
  coalesce(quality, 0) = 1 AS has_text, coalesce(toxic, 0) = 1 AS has_log FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "edge_provenance",
    f"""
    WITH {RATED}, t AS (SELECT * FROM rated WHERE rel <> 'OTHER'), c AS (
      SELECT 'total' AS origin, count(*) AS n FROM t
      UNION ALL SELECT 'extracted_only', count(*) FROM t WHERE has_text AND NOT has_log
      UNION ALL SELECT 'inferred_only', count(*) FROM t WHERE has_log AND NOT has_text
      UNION ALL SELECT 'both', count(*) FROM t WHERE has_text AND has_log
      UNION ALL SELECT 'other', count(*) FROM t WHERE NOT has_text AND NOT has_log)
    SELECT origin, n, n * 100.0::DOUBLE / (SELECT count(*) FROM t) AS pct FROM c
    """,
)
def edge_provenance(spark, sf):
    rows = maintain.edge_provenance(_rated_edges(spark, sf))
    return rows.withColumn("pct", F.col("pct").cast("double"))


@query("inference_delete", f"WITH {RATED} SELECT doc_id, rel FROM rated WHERE NOT has_log")
def inference_delete(spark, sf):
    return maintain.delete_inferred(_rated_edges(spark, sf)).select("doc_id", "rel")


@query("edge_filters", f"WITH {RATED} SELECT doc_id, rel FROM rated WHERE NOT has_log OR has_text")
def edge_filters(spark, sf):
    return maintain.delete_inferred(_rated_edges(spark, sf), keep_extracted=True).select("doc_id", "rel")


@query("property_drop", "SELECT s_suppkey AS key, s_name AS name, CAST(NULL AS STRING) AS search_text FROM supplier")
def property_drop(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_name").alias("search_text"))
    return maintain.drop_properties(nodes, ["search_text"])


# ---------------------------------------------------------------- digests


INDUSTRY_DIGEST = f"""industry AS (SELECT industry AS name, sector,
  substring(string_agg(concat('- ', name, ': ', description), chr(10) ORDER BY seq), 1, 10000) AS text FROM profiles GROUP BY 1, 2)"""


def _industry_digest(spark, sf):
    rows = suppliers(spark, sf).withColumn("line", digest.member_line("name", "description"))
    return digest.digest(rows, ["industry", "sector"], ["seq"])


@query(
    "group_digest",
    f"""
    WITH {SUPPLIER_CTE}, {INDUSTRY_DIGEST}
    SELECT 'Industry' AS level, name AS grp, name AS member, text FROM industry
    UNION ALL SELECT 'Sector', sector, name, concat('- Industry ', name, ': ', text) FROM industry
    """,
)
def group_digest(spark, sf):
    industry = _industry_digest(spark, sf)
    first = industry.select(
        F.lit("Industry").alias("level"), F.col("industry").alias("grp"), F.col("industry").alias("member"), F.col("digest").alias("text")
    )
    lines = industry.select(
        F.lit("Sector").alias("level"), F.col("sector").alias("grp"), F.col("industry").alias("member"),
        digest.member_line("industry", "digest", "Industry").alias("text"),
    )
    return first.unionByName(lines)


@query(
    "sector_digest",
    f"""
    WITH {SUPPLIER_CTE}, {INDUSTRY_DIGEST}
    SELECT sector, substring(string_agg(concat('- Industry ', name, ': ', text), chr(10) ORDER BY name), 1, 100000) AS digest
    FROM industry GROUP BY 1
    """,
)
def sector_digest(spark, sf):
    lines = _industry_digest(spark, sf).withColumn("line", digest.member_line("industry", "digest", "Industry"))
    return digest.digest(lines, ["sector"], ["industry"], limit=100000)


@query(
    "digest_writeback",
    f"""
    WITH {SUPPLIER_CTE}, {INDUSTRY_DIGEST}
    SELECT 'Industry' AS label, n_name AS key, coalesce(text, 'none') AS description FROM nation LEFT JOIN industry ON n_name = name
    """,
)
def digest_writeback(spark, sf):
    nodes = table(spark, sf, "nation").select(
        F.lit("Industry").alias("label"), F.col("n_name").alias("key"), F.lit("none").alias("description")
    )
    return digest.store_digest(nodes, _industry_digest(spark, sf), "industry")


PARAGRAPHS = r"""paragraphs AS (SELECT page_id, sec_no, body FROM (
  SELECT page_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS sec_no,
    trim(regexp_replace(regexp_replace(unnest(parts), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1) AS parts FROM pages)))"""
PAGE_WORDS = ["lich", "tion", "ment"]


def _pages(spark, sf):
    """Page text as summary and content, its paragraphs as sections that are their own titles."""
    raw = texts(spark, sf, "pages").select("page_id", F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)).alias("parts"), "html")
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    sections = raw.select("page_id", F.posexplode("parts").alias("sec_no", "raw")).select(
        "page_id", "sec_no", plain(F.col("raw")).alias("body")
    )
    sections = sections.withColumn("title", F.col("body"))
    pages = raw.select(
        "page_id", plain(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("summary"),
        plain(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)).alias("content"),
    )
    return pages, sections


KEYWORD = "(lower(body) LIKE '%lich%' OR lower(body) LIKE '%tion%' OR lower(body) LIKE '%ment%')"


@query(
    "section_keywords",
    f"""
    WITH {PARAGRAPHS}, hits AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sec_no) AS r FROM paragraphs WHERE {KEYWORD} AND length(body) > 0)
    SELECT page_id, count(*) AS n_lines, string_agg(body, '|' ORDER BY sec_no) AS found FROM hits WHERE r <= 2 GROUP BY 1
    """,
)
def section_keywords(spark, sf):
    sections = _pages(spark, sf)[1].where(digest.has_word("title", PAGE_WORDS) & (F.length("body") > 0))
    return digest.top_lines(sections, ["page_id"], [F.col("sec_no")], "body", 2, "|", "found")


@query(
    "section_digest",
    rf"""
    WITH {PARAGRAPHS}, hits AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY sec_no) AS r FROM paragraphs WHERE {KEYWORD} AND length(body) > 0),
    found AS (SELECT page_id, count(*) AS n, string_agg(concat('SECTION ''', replace(replace(upper(body), 'ß', 'SS'), 'ẞ', 'SS'), ''':', chr(10),
      substring(body, 1, 1500), chr(10), chr(10)), '' ORDER BY sec_no) AS text FROM hits WHERE r <= 2 GROUP BY 1),
    plain AS (SELECT page_id,
      trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS summary,
      trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM pages)
    SELECT p.page_id, coalesce(n, 0) AS n_sections, substring(concat('SUMMARY:', chr(10), substring(summary, 1, 800), chr(10), chr(10),
      coalesce(f.text, concat('CONTENT:', chr(10), substring(content, 1, 1500)))), 1, 3500) AS digest
    FROM plain p LEFT JOIN found f ON p.page_id = f.page_id
    """,
)
def section_digest(spark, sf):
    return digest.section_digest(*_pages(spark, sf), words=PAGE_WORDS)


@query(
    "deal_news_digest",
    """
    WITH d AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title FROM documents
      WHERE lower(text) LIKE '%the%' OR lower(text) LIKE '%und%'),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM d)
    SELECT source AS company, count(*) AS n_lines, string_agg(concat('- News: ', title), chr(10) ORDER BY doc_id) AS digest
    FROM r WHERE r <= 5 GROUP BY 1
    """,
)
def deal_news_digest(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "news_id")
    news = docs.select("news_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("body"))
    return digest.deal_digest(news, docs.select("news_id", F.col("source").alias("company")), words=["the", "und"])


@query(
    "deal_news_recent",
    """
    WITH d AS (SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('purchase', 'click') AND CAST(ts AS DATE) >= DATE '2024-01-15'),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM d)
    SELECT user_id AS company, count(*) AS n_lines, string_agg(concat('- News: ', event_type), chr(10) ORDER BY event_id) AS digest
    FROM r WHERE r <= 5 GROUP BY 1
    """,
)
def deal_news_recent(spark, sf):
    rows = table(spark, sf, "events").withColumnRenamed("event_id", "news_id")
    news = rows.select("news_id", F.col("event_type").alias("title"), F.col("props").alias("body"), F.to_date("ts").alias("date"))
    companies = rows.select("news_id", F.col("user_id").alias("company"))
    return digest.deal_digest(news, companies, F.lit("2024-01-15").cast("date"), ["purchase", "click"])


@query(
    "cardinality_report",
    """
    SELECT 'Company' AS what, count(DISTINCT p_brand) AS n FROM part
    UNION ALL SELECT 'Product', count(DISTINCT w) FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)
    UNION ALL SELECT 'Market', count(DISTINCT p_type) FROM part
    UNION ALL SELECT 'Organization', count(DISTINCT p_name) FROM part WHERE p_size > 25
    """,
)
def cardinality_report(spark, sf):
    edges = build.list_relations(_details(spark, sf))
    return maintain.endpoints(edges).groupBy(F.col("label").alias("what")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- sources and sinks


@query(
    "profile_scan",
    """
    SELECT replace(concat('S.', CAST(s_suppkey AS STRING)), '.', '-') AS ticker, s_name AS name, 'Unknown' AS sector,
      CASE WHEN s_acctbal >= 3000 THEN n_name END AS industry, s_acctbal AS market_cap,
      concat('says "', n_name, '";', chr(10), 'more, text') AS description,
      '[{"name":"x","title":null,"age":3}]' AS officers_json, CAST(least(s_nationkey, 5) AS BIGINT) AS n_holders,
      concat('{"city":"N/A","state":"N/A","zip":"N/A","country":"', n_name, '"}') AS address_json
    FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
def profile_scan(spark, sf):
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    symbol = F.concat(F.lit("S."), F.col("s_suppkey").cast("string"))
    listing = rows.select(
        symbol.alias("symbol"), F.col("s_name").alias("security"), none.alias("sector"),
        F.when(F.col("s_acctbal") >= 3000, F.col("n_name")).alias("industry"),
    )
    officer = F.struct(F.lit("x").alias("name"), none.alias("title"), F.lit(3).alias("age"), F.lit(1).alias("other"))
    holders = F.slice(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.struct(i.cast("string").alias("Holder"))), 1, F.col("s_nationkey"))
    quotes = rows.select(
        clean.normalise_ticker(symbol).alias("symbol"), none.alias("short_name"), F.col("s_acctbal").alias("market_cap"),
        none.alias("employees"), none.alias("website"),
        F.concat(F.lit('says "'), "n_name", F.lit('";\nmore, text')).alias("summary"),
        F.array(officer).alias("officers"), holders.alias("holders"), none.alias("city"), none.alias("state"),
        none.alias("zip"), F.col("n_name").alias("country"),
    )
    made = profile_source.assemble_profiles(listing, quotes)
    path = fresh_dir(spark, "profiles")
    header = {ours: theirs for theirs, ours in schemas.PROFILE_COLUMNS.items()}
    made.withColumnsRenamed(header).write.options(header="true", sep=";", quote='"', escape='"').csv(path)
    read = profile_source.read_profiles(spark, path, multi_line=True)
    read = profile_source.blank_placeholders(read, ["sector", "industry", "employees", "website"])
    read = profile_source.fill_unknown(read, {"sector": "Unknown"})
    return read.select(
        "ticker", "name", "sector", "industry", clean.clean_number("market_cap").alias("market_cap"), "description",
        "officers_json", F.size(jsontext.holders("holders_json")).cast("bigint").alias("n_holders"), "address_json",
    )


@query(
    "profile_first_rows",
    "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100",
)
def profile_first_rows(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    return profile_source.first_rows(rows, 100, "c_custkey")


@query(
    "news_scan_aliases",
    f"""
    SELECT spelling, doc_id, source AS headline, text AS body, day AS date, n_categories FROM (
      SELECT 'first' AS spelling, doc_id, source, text, '2024-03-05' AS day, 0::BIGINT AS n_categories FROM documents
      UNION ALL SELECT 'second', doc_id, source, text, '{AS_OF}', 2 FROM documents)
    """,
)
def news_scan_aliases(spark, sf):
    docs = table(spark, sf, "documents")
    first = docs.select("doc_id", F.col("source").alias("headline"), "text", F.lit("Mar 5 2024").alias("Time"))
    second = docs.select(
        "doc_id", F.col("source").alias("Headlines"), F.col("text").alias("Description"), F.lit("soon").alias("date"),
        F.concat_ws(" ;; ", "lang", "source").alias("GICS_Subsectors_Mapped"),
    )

    # The second spelling comes from delimited text on storage.
    path = fresh_dir(spark, "news")
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    second.write.options(header="true", sep=";", quote='"', escape='"', **keep).csv(path)
    stored = news_source.read_news(spark, path, AS_OF, multi_line=True).withColumn("doc_id", F.col("doc_id").cast("bigint"))

    def read(got, name):
        return got.select(
            F.lit(name).alias("spelling"), "doc_id", "headline", "body", F.col("date").cast("string").alias("date"),
            F.size("categories").cast("bigint").alias("n_categories"),
        )

    return read(news_source.normalise_news(first, AS_OF), "first").unionByName(read(stored, "second"))


@query(
    "graph_roundtrip",
    f"""
    WITH {SUPPLIER_CTE}
    SELECT DISTINCT s.ticker, s.name AS company, p_name AS product FROM profiles s
    JOIN lineitem ON s.seq = l_suppkey JOIN part ON l_partkey = p_partkey
    """,
)
def graph_roundtrip(spark, sf):
    companies = suppliers(spark, sf).select(F.lit("Company").alias("label"), F.col("ticker").alias("key"), "name")
    sold = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("ticker"), F.array("p_name").alias("products"))
    )
    made = build.list_relations(sold, relations={"products": build.LIST_RELATIONS["products"]})
    hierarchy = build.hierarchy_edges(suppliers(spark, sf))
    path = fresh_dir(spark, "graph")
    nodes = companies.unionByName(build.edge_targets(made)).unionByName(build.edge_targets(hierarchy))
    # An older graph stands at the path and is replaced.
    tables.write_graph(companies.withColumn("name", F.lit("old")), hierarchy, path)
    tables.write_graph(upsert.upsert_edges(nodes, identity=["label", "key"]), made.unionByName(hierarchy), path)
    stored = maintain.with_labels(tables.read_nodes(spark, path).where("name is not null"), ["Company", "Product"])
    return maintain.produced_by(stored, tables.read_edges(spark, path))


@query(
    "distinct_merged",
    """
    SELECT l_returnflag AS flag, since, count(DISTINCT l_orderkey) AS exact, TRUE AS within_error
    FROM lineitem JOIN (VALUES ('1992-01-01'), ('1995-06-01')) v(since) ON CAST(CAST(l_shipdate AS DATE) AS VARCHAR) >= since GROUP BY 1, 2
    """,
)
def distinct_merged(spark, sf):
    """Sketches of each day, stored once and merged over days, against the exact counts."""
    lines = table(spark, sf, "lineitem").withColumn("day", F.col("l_shipdate").cast("date").cast("string"))
    path = fresh_dir(spark, "sketches")
    distinct.add(lines, F.col("l_returnflag"), F.col("day"), F.col("l_orderkey"), path, 0)

    def checked(since):
        counted = lines.where(F.col("day") >= since).groupBy(F.col("l_returnflag").alias("flag"))
        exact = counted.agg(F.count_distinct("l_orderkey").alias("exact"))
        found = distinct.count(spark, path, since).withColumnRenamed("group", "flag")
        within = F.abs(F.col("n") - F.col("exact")) <= distinct.error() * F.col("exact")
        return exact.join(found, "flag").select("flag", F.lit(since).alias("since"), "exact", within.alias("within_error"))

    return checked("1992-01-01").unionByName(checked("1995-06-01"))
