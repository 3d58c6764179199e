"""Profile rows to candidate nodes and edges.

Each builder is a projection of the profile table, so a company is read once and nothing but
the narrow candidate rows is shuffled. Node candidates carry ``seq``, the input row number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions import clean, jsontext
from graphmill.operators.upsert import EDGE_KEY, last_write

# Generators are the outer kind followed by a null test on their output: for the plain kind Spark
# adds a filter with a second copy of the generator's input, parsing every JSON text twice.


def _node(label: str, key: Column | str, **props: Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.struct(F.lit(label).alias("label"), key.alias("key"), *[v.alias(k) for k, v in props.items()])


def _edge(src_label: str, src: Column, rel: str, dst_label: str, dst: Column) -> Column:
    values = (F.lit(src_label), src, F.lit(rel), F.lit(dst_label), dst)
    return F.struct(*[v.alias(k) for k, v in zip(EDGE_KEY, values, strict=True)])


def _inline(df: DataFrame, structs: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """The non-null structs of each row, one output row per struct."""
    rows = df.select(*keep, F.explode_outer(F.array(*structs)).alias("_s")).where("_s is not null")
    return rows.select(*keep, "_s.*")


def company_nodes(profiles: DataFrame, as_of: str | None = None, description_length: int | None = 500) -> DataFrame:
    """Company nodes: cleaned numbers, leading part of the description, last row wins."""
    description = F.col("description")
    if description_length is not None:
        description = clean.prefix(description, description_length)
    candidates = profiles.select(
        F.lit("Company").alias("label"),
        F.col("ticker").alias("key"),
        "name",
        description.alias("description"),
        "website",
        clean.clean_number("market_cap").alias("market_cap"),
        clean.clean_number("employees").alias("employees"),
        F.lit(as_of).cast("date").alias("last_updated"),
        "seq",
    )
    return last_write(candidates, ["label", "key"], ["seq"]).drop("seq")


def geography_edges(profiles: DataFrame) -> DataFrame:
    """Company to city, city to state to country; without a state, city to country.

    A missing or placeholder country drops the country edges and keeps the city.
    """
    place = jsontext.address("address_json")
    located = profiles.select(
        "ticker",
        clean.blank_to_null(place["city"]).alias("city"),
        clean.blank_to_null(place["state"]).alias("state"),
        clean.blank_to_null(place["country"]).alias("country"),
    ).where("city is not null")
    ticker, city, state, country = (F.col(c) for c in ("ticker", "city", "state", "country"))
    has_state, has_country = state.isNotNull(), country.isNotNull()
    edges = [
        _edge("Company", ticker, "LOCATED_IN", "City", city),
        F.when(has_state, _edge("City", city, "IN_STATE", "State", state)),
        F.when(has_state & has_country, _edge("State", state, "IN_COUNTRY", "Country", country)),
        F.when(~has_state & has_country, _edge("City", city, "IN_COUNTRY", "Country", country)),
    ]
    return _inline(located, edges).distinct()


def hierarchy_edges(profiles: DataFrame, variant: str = "nested") -> DataFrame:
    """Edges among company, industry and sector.

    ``nested``: industry and sector known gives company-industry and industry-sector, a sector
    alone gives company-sector. ``independent``: each known level links the company by itself.
    ``taxonomy``: every row links company-industry-sector, missing levels read ``Unknown``.
    """
    if variant == "taxonomy":
        levels = profiles.select(
            "ticker",
            F.coalesce("industry", F.lit("Unknown")).alias("industry"),
            F.coalesce("sector", F.lit("Unknown")).alias("sector"),
        )
    else:
        levels = profiles.select(
            "ticker",
            clean.blank_to_null("industry").alias("industry"),
            clean.blank_to_null("sector").alias("sector"),
        )
    ticker, industry, sector = (F.col(c) for c in ("ticker", "industry", "sector"))
    has_industry, has_sector = industry.isNotNull(), sector.isNotNull()
    in_industry = _edge("Company", ticker, "OPERATES_IN_INDUSTRY", "Industry", industry)
    in_sector = _edge("Company", ticker, "OPERATES_IN_SECTOR", "Sector", sector)
    part_of = F.when(has_industry & has_sector, _edge("Industry", industry, "PART_OF", "Sector", sector))
    if variant == "nested":
        edges = [
            F.when(has_industry & has_sector, in_industry),
            part_of,
            F.when(~has_industry & has_sector, in_sector),
        ]
    elif variant == "independent":
        edges = [F.when(has_sector, in_sector), F.when(has_industry, in_industry), part_of]
    elif variant == "taxonomy":
        edges = [_edge("Company", ticker, "BELONGS_TO", "Industry", industry), part_of]
    else:
        raise ValueError(f"unknown hierarchy variant: {variant}")
    return _inline(levels, edges).distinct()


def company_paths(edges: DataFrame, company_rel: str = "BELONGS_TO") -> DataFrame:
    """Company, industry and sector by two steps along the hierarchy edges."""
    first = edges.where(F.col("rel") == company_rel).select(
        F.col("src_key").alias("company"), F.col("dst_key").alias("industry")
    )
    second = edges.where(F.col("rel") == "PART_OF").select(
        F.col("src_key").alias("industry"), F.col("dst_key").alias("sector")
    )
    return first.join(second, "industry").select("company", "industry", "sector")


def officer_rows(profiles: DataFrame) -> DataFrame:
    """One row per named officer. A null title becomes empty text and drops nobody."""
    exploded = profiles.select(
        "ticker", "seq", F.posexplode_outer(jsontext.officers("officers_json")).alias("pos", "o")
    )
    return exploded.select(
        "ticker", "seq", "pos",
        F.col("o.name").alias("name"),
        F.coalesce("o.title", F.lit("")).alias("title"),
        F.col("o.age").alias("age"),
    ).where(F.length("name") > 0)


def people(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Person nodes (same-named people merge) and works-for edges told apart by title."""
    rows = officer_rows(profiles)
    nodes = last_write(
        rows.select(F.lit("Person").alias("label"), F.col("name").alias("key"), "name", "age", "title", "seq", "pos"),
        ["label", "key"],
        ["seq", "pos"],
    ).drop("seq", "pos")
    edges = rows.select(
        F.lit("Person").alias("src_label"), F.col("name").alias("src_key"),
        F.lit("WORKS_FOR").alias("rel"), F.lit("Company").alias("dst_label"),
        F.col("ticker").alias("dst_key"), "title",
    ).dropDuplicates([*EDGE_KEY, "title"])
    return nodes, edges


def holder_rows(profiles: DataFrame) -> DataFrame:
    exploded = profiles.select(
        "ticker", "seq", F.posexplode_outer(jsontext.holders("holders_json")).alias("pos", "h")
    )
    return exploded.select(
        "ticker", "seq", "pos",
        F.col("h.Holder").alias("name"),
        F.coalesce("h.pctHeld", F.lit(0.0)).alias("percentage"),
    ).where(F.length("name") > 0)


def holdings(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fund nodes and owns edges told apart by percentage."""
    rows = holder_rows(profiles)
    nodes = rows.select(F.lit("Fund").alias("label"), F.col("name").alias("key"), "name").distinct()
    edges = rows.select(
        F.lit("Fund").alias("src_label"), F.col("name").alias("src_key"),
        F.lit("OWNS").alias("rel"), F.lit("Company").alias("dst_label"),
        F.col("ticker").alias("dst_key"), "percentage",
    ).dropDuplicates([*EDGE_KEY, "percentage"])
    return nodes, edges


# Source of extracted edges, evidence of a record without one.
EXTRACTED = "LLM Extraction (News GDELT / Wiki / Description)"
NO_EVIDENCE = "No evidence provided"

# List field of a details record -> edge type and target label.
LIST_RELATIONS = {
    "products": ("PRODUCES", "Product"),
    "markets": ("SERVES_MARKET", "Market"),
    "subsidiaries": ("OWNS_SUBSIDIARY", "Organization"),
    "partners": ("PARTNER_WITH", "Organization"),
    "competitors": ("COMPETES_WITH", "Organization"),
}


def list_relations(
    details: DataFrame, key: str = "ticker", relations: Mapping[str, tuple[str, str]] = LIST_RELATIONS
) -> DataFrame:
    """Edges to every non-empty name in the list columns named by ``relations``."""

    def named(field: str, rel: str, label: str) -> Column:
        names = F.filter(F.coalesce(F.col(field), F.array().cast("array<string>")), lambda n: F.length(n) > 0)
        return F.transform(names, lambda n: _edge("Company", F.col(key), rel, label, n))

    lists = [named(field, rel, label) for field, (rel, label) in relations.items()]
    return details.select(F.explode_outer(F.concat(*lists)).alias("_e")).where("_e is not null").select("_e.*").distinct()


def edge_targets(edges: DataFrame) -> DataFrame:
    """The nodes that edges point to, as bare nodes named by their key."""
    return edges.select(
        F.col("dst_label").alias("label"), F.col("dst_key").alias("key"), F.col("dst_key").alias("name")
    ).distinct()


def known_company_edges(mentions: DataFrame, resolved: DataFrame, as_of: str) -> DataFrame:
    """Partner and competitor edges between known companies.

    ``mentions``: ticker, rel, name, evidence, seq. ``resolved``: name, match (a ticker). Links
    of a company to itself are left out; of repeated edges the last evidence stays.
    """
    rows = (
        mentions.join(resolved.select("name", "match"), "name")
        .where(F.col("ticker") != F.col("match"))
        .select(
            F.lit("Company").alias("src_label"), F.col("ticker").alias("src_key"), "rel",
            F.lit("Company").alias("dst_label"), F.col("match").alias("dst_key"),
            F.coalesce("evidence", F.lit(NO_EVIDENCE)).alias("evidence"), "seq", "name",
        )
    )
    last = last_write(rows, EDGE_KEY, ["seq", "name"]).drop("seq", "name")
    return last.withColumn("source", F.lit(EXTRACTED)).withColumn(
        "last_updated", F.lit(as_of).cast("date")
    )


def alias_table(profiles: DataFrame) -> DataFrame:
    """Every text that names an entity: company name and ticker, officers, funds, city, country.

    Of entries with the same text the last one stays, by row and by the order above.
    """
    place = jsontext.address("address_json")
    person = F.transform(
        F.coalesce(jsontext.officers("officers_json"), F.array().cast("array<struct<name:string,title:string,age:int>>")),
        lambda o: clean.clean_name(o["name"]),
    )
    fund = F.transform(
        F.coalesce(jsontext.holders("holders_json"), F.array().cast("array<struct<Holder:string,pctHeld:double>>")),
        lambda h: clean.clean_name(h["Holder"]),
    )

    def entry(alias: Column, label: str, key: Column, field: str) -> Column:
        return F.struct(
            alias.alias("alias"), F.lit(label).alias("label"), key.alias("key"), F.lit(field).alias("key_field")
        )

    def named(names: Column, label: str) -> Column:
        return F.transform(
            F.filter(names, lambda n: F.length(n) > 3), lambda n: entry(n, label, n, "name")
        )

    city, country = clean.blank_to_null(place["city"]), clean.blank_to_null(place["country"])
    entries = F.concat(
        F.array(
            entry(F.col("name"), "Company", F.col("ticker"), "ticker"),
            entry(F.col("ticker"), "Company", F.col("ticker"), "ticker"),
        ),
        named(person, "Person"),
        named(fund, "Fund"),
        F.array(entry(city, "City", city, "name"), entry(country, "Country", country, "name")),
    )
    rows = profiles.select("seq", F.posexplode_outer(entries).alias("pos", "e")).select("seq", "pos", "e.*")
    return last_write(rows.where("alias is not null"), ["alias"], ["seq", "pos"]).drop("seq", "pos")
