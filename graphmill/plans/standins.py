"""Domain tables derived from the driver tables, as SQL both engines read the same way.

The derivation is the input of a query, not its work: values are blanked or broken by what a
column holds, so every operator meets missing and malformed fields on whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, dealt over the shuffle partitions: cutting texts up costs more than moving them."""
    return table(spark, sf, name).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of short rows, dealt as ``texts``: a file of few bytes is one task, whatever its rows become."""
    return texts(spark, sf, name)


def derive(spark: SparkSession, sf: str, sql: str, *tables: str) -> DataFrame:
    """Run stand-in SQL over the named driver tables."""
    return spark.sql(sql, **{t: table(spark, sf, t) for t in tables})


def duck(sql: str) -> str:
    """The same SQL for the checker, whose tables are views of the same names."""
    return sql.replace("{", "").replace("}", "")


# One profile row per customer.
PROFILES = """
SELECT c_custkey AS seq,
  concat('C-', CAST(c_custkey AS STRING)) AS ticker,
  c_name AS name,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'N/A' ELSE r_name END AS sector,
  CASE WHEN c_acctbal < 500 THEN NULL WHEN c_acctbal < 1000 THEN '' ELSE n_name END AS industry,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'N/A' ELSE CAST(c_acctbal AS STRING) END AS market_cap,
  CASE WHEN c_acctbal > 9000 THEN 'nan' WHEN c_acctbal > 8000 THEN 'about 50'
       ELSE CAST(c_nationkey * 100 + 7 AS STRING) END AS employees,
  CASE WHEN c_nationkey = 4 THEN NULL ELSE concat('https://example.com/', c_name) END AS website,
  CASE WHEN c_nationkey = 5 THEN NULL
       ELSE concat(c_name, ' serves ', c_mktsegment, '. Based in ', n_name) END AS description,
  CASE WHEN c_nationkey = 3 THEN 'not json' ELSE concat(
    chr(91), chr(123), '"name": "Mr.Ray ', n_name, '", "title": "Chief Executive Officer", "age": ',
    CAST(40 + c_nationkey AS STRING), chr(125), ', ', chr(123), '"name": "Ann ', c_mktsegment, '", "title": ',
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"Director"' END, ', "age": ',
    CAST(c_custkey AS STRING), chr(125), ', ', chr(123), '"name": ',
    CASE WHEN c_acctbal > 5000 THEN '""' ELSE '"Lee plc"' END, ', "title": "Treasurer"', chr(125), chr(93)) END AS officers_json,
  concat(chr(91), chr(123), '"Holder": "Fund ', c_mktsegment, ' plc", "pctHeld": 0.25, "Shares": 10', chr(125), ', ',
    chr(123), '"Holder": ', CASE WHEN c_acctbal < 2000 THEN 'null' ELSE concat('"Trust ', n_name, '"') END,
    chr(125), chr(93)) AS holders_json,
  concat(chr(123), '"city": "', CASE WHEN c_nationkey = 7 THEN 'N/A' ELSE concat('Town ', n_name) END, '", ',
    CASE WHEN c_mktsegment = 'FURNITURE' THEN '' WHEN c_mktsegment = 'HOUSEHOLD' THEN '"state": "N/A", '
         ELSE concat('"state": "', c_mktsegment, ' state", ') END,
    '"zip": "1", "country": ',
    CASE WHEN c_nationkey = 8 THEN 'null' WHEN c_nationkey = 9 THEN '"N/A"' ELSE concat('"', r_name, '"') END,
    chr(125)) AS address_json
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    near = {t: table(spark, sf, t) for t in ("nation", "region")}
    return spark.sql(PROFILES, customer=dealt(spark, sf, "customer"), **near)


# One profile row per supplier, complete.
SUPPLIERS = """
SELECT s_suppkey AS seq, concat('S-', CAST(s_suppkey AS STRING)) AS ticker, s_name AS name,
  r_name AS sector, n_name AS industry, concat(s_name, ' of ', n_name) AS description
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    near = {t: table(spark, sf, t) for t in ("nation", "region")}
    return spark.sql(SUPPLIERS, supplier=dealt(spark, sf, "supplier"), **near)


PROFILE_CTE = f"profiles AS ({duck(PROFILES)})"
SUPPLIER_CTE = f"profiles AS ({duck(SUPPLIERS)})"

# Full part names: a dictionary whose size follows the part table.
PART_NAMES = "SELECT DISTINCT concat(p_name, ' ', p_type, ' ', p_brand) AS alias FROM {part}"

# Turns of a conversation as the entities of a news item.
TURNS = """
SELECT conv_id AS news_id, turn AS pos, role AS term, text FROM {conversations}
"""
