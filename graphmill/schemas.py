"""Fixed schemas of the input tables, model responses and graph tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STRING, LONG, DOUBLE, DATE = T.StringType(), T.LongType(), T.DoubleType(), T.DateType()
STRINGS = T.ArrayType(STRING)

# Input column name -> our column name.
PROFILE_COLUMNS = {
    "Ticker": "ticker",
    "Name": "name",
    "Sector": "sector",
    "Industry": "industry",
    "Market Cap": "market_cap",
    "Employees": "employees",
    "Website": "website",
    "Description": "description",
    "Officers_JSON": "officers_json",
    "Holders_JSON": "holders_json",
    "Address_JSON": "address_json",
}

OFFICERS = T.ArrayType(_struct(name=STRING, title=STRING, age=T.IntegerType()))
HOLDERS = T.ArrayType(_struct(Holder=STRING, pctHeld=DOUBLE))
ADDRESS = _struct(city=STRING, state=STRING, zip=STRING, country=STRING)

EVIDENCE = T.ArrayType(_struct(name=STRING, evidence=STRING))
DETAILS = _struct(
    products=STRINGS, markets=STRINGS, subsidiaries=STRINGS, partners=STRINGS, competitors=STRINGS
)
INTERACTION = _struct(source=STRING, target=STRING, relation=STRING, summary=STRING)
NEWS_ANALYSIS = _struct(entities=STRINGS, interaction=INTERACTION, sentiment=STRING)
PAIR_DECISION = _struct(
    relationships=T.ArrayType(
        _struct(type=STRING, topic=STRING, reason=STRING, evidence_used=STRING)
    )
)
CANDIDATE_MATCH = _struct(match_ticker=STRING)
ALIAS = _struct(official_name=STRING)

NODES = _struct(label=STRING, key=STRING, name=STRING)
EDGES = _struct(
    src_label=STRING, src_key=STRING, rel=STRING, dst_label=STRING, dst_key=STRING, ident=STRING
)

# Labels, in the order the builders create them.
LABELS = [
    "Company", "Sector", "Industry", "City", "State", "Country", "Person", "Fund",
    "Product", "Market", "Organization", "News",
]
