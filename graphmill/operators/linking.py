"""News to graph: entities per news, mention edges, interactions, routing.

``terms`` (news_id, pos, term) meets ``resolved`` (term, label, key, name, score) on the term; the
resolved side has one row per distinct term. Everything afterwards is grouped by news and
reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions import relations, text
from graphmill.operators.upsert import EDGE_KEY, append_events, last_write, log_summary

# News identity by name: which columns make two rows the same news.
IDENTITY = {"id": ["news_id"], "headline": ["headline"], "headline_date": ["headline", "date"]}


def news_key(columns: Sequence[str]) -> Column:
    """A reproducible id from the identifying columns; nulls and their places count."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def news_nodes(news: DataFrame, identity: str | Sequence[str] = "headline_date", order: Sequence[str] = ("seq",)) -> DataFrame:
    """One node per news identity with the properties of its last row."""
    keys = IDENTITY[identity] if isinstance(identity, str) else list(identity)
    nodes = last_write(news, keys, order)
    return nodes.withColumn("news_key", news_key(keys))


def entities(terms: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct entities per news, each at the position where it was first named."""
    joined = terms.join(resolved, "term")
    return joined.groupBy("news_id", "label", "key").agg(
        F.min("pos").alias("pos"),
        F.min_by("name", F.struct("pos", "term")).alias("name"),
        F.min_by("score", F.struct("pos", "term")).alias("score"),
    )


def first_entity(found: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("label", "key"), F.struct("pos", "label", "key"))
    return found.groupBy("news_id").agg(first.alias("_e")).select("news_id", "_e.*")


def mention_edges(
    news: DataFrame, found: DataFrame, rel: str = "MENTIONS", extra: Sequence[str] = ("score",)
) -> DataFrame:
    """Edges from news nodes to the entities found in them; the best score stays."""
    rows = found.join(news.select("news_id", "news_key"), "news_id")
    best = [F.max(c).alias(c) for c in extra]
    edges = rows.select(
        F.lit("News").alias("src_label"), F.col("news_key").alias("src_key"), F.lit(rel).alias("rel"),
        F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), *extra,
    )
    return edges.groupBy(*EDGE_KEY).agg(*best) if best else edges.distinct()


def semantic_edges(terms: DataFrame, neighbours: DataFrame) -> DataFrame:
    """News to company edges with score and the term that led there, the last term winning.

    ``neighbours``: term, key, score of the nearest company above the threshold.
    """
    rows = terms.join(neighbours.select("term", "key", "score"), "term").select(
        F.lit("News").alias("src_label"), F.col("news_id").cast("string").alias("src_key"),
        F.lit("SEMANTIC_MATCH").alias("rel"), F.lit("Company").alias("dst_label"),
        F.col("key").alias("dst_key"), "score", F.col("term").alias("matched_term"), "pos",
    )
    return last_write(rows, EDGE_KEY, ["pos", "matched_term"]).drop("pos")


def industry_links(categories: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct news and industry pairs, through the industry each category was mapped to.

    ``categories``: news_id, category. ``mapping``: category, industry, one row per category.
    """
    return categories.join(mapping, "category").select("news_id", "industry").distinct()


def industry_edges(links: DataFrame) -> DataFrame:
    return links.select(
        F.lit("News").alias("src_label"), F.col("news_id").cast("string").alias("src_key"),
        F.lit("RELATES_TO_INDUSTRY").alias("rel"), F.lit("Industry").alias("dst_label"),
        F.col("industry").alias("dst_key"),
    )


def interactions(
    news: DataFrame, claims: DataFrame, resolved: DataFrame, found: DataFrame, *,
    fallback: bool = True, free_form: bool = False,
) -> DataFrame:
    """Interaction rows of news that name at least two entities.

    ``claims``: news_id, source, target, relation, summary. Endpoints are resolved by name; with
    ``fallback`` an unknown source is the first entity of the news and an unknown target the
    second, without it both must be known. Source and target must differ. ``free_form`` keeps the
    relation as written, in upper snake case, instead of mapping it to the known edge types.
    """
    by_place = Window.partitionBy("news_id").orderBy("pos", "label", "key")
    two = found.withColumn("_r", F.row_number().over(by_place)).where("_r <= 2")
    pair = two.groupBy("news_id").agg(
        F.min_by(F.struct("label", "key"), "_r").alias("_first"),
        F.max_by(F.struct("label", "key"), "_r").alias("_second"),
        F.count("*").alias("_n"),
    ).where("_n = 2")

    def side(column: str, into: str) -> DataFrame:
        return resolved.select(F.col("term").alias(column), F.struct("label", "key").alias(into))

    rows = (
        claims.join(pair, "news_id")
        .join(side("source", "_src"), "source", "left")
        .join(side("target", "_dst"), "target", "left")
    )
    if fallback:
        rows = rows.withColumn("_src", F.coalesce("_src", "_first")).withColumn(
            "_dst", F.coalesce("_dst", "_second")
        )
    rows = rows.where(F.col("_src") != F.col("_dst"))
    kind = (
        relations.upper_snake("relation")
        if free_form
        else relations.news_relation("relation", F.col("_dst.label"))
    )
    return rows.join(news, "news_id").select(
        "news_id",
        F.col("_src.label").alias("src_label"), F.col("_src.key").alias("src_key"), kind.alias("rel"),
        F.col("_dst.label").alias("dst_label"), F.col("_dst.key").alias("dst_key"),
        "date", "seq", text.log_line("date", "sentiment", "headline", "summary").alias("entry"),
    )


def interaction_edges(rows: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with first and last date, and the history as one row per edge and news."""
    log = append_events(rows, history, EDGE_KEY, ["news_id"])
    return log_summary(log, EDGE_KEY, "date", ["seq", "news_id"]), log


def route(news: DataFrame, found: DataFrame, linked: DataFrame, variant: str = "first") -> DataFrame:
    """Which mention edges are written: news_id, label, key, with the outcome per news.

    ``first``: news without an interaction mention their first entity. ``all``: they mention all
    entities. ``both``: every news mentions all its entities, interaction or not.
    """
    has_link = linked.select("news_id").distinct()
    if variant == "both":
        return found.select("news_id", "label", "key")
    open_news = found.join(has_link, "news_id", "left_anti")
    if variant == "all":
        return open_news.select("news_id", "label", "key")
    if variant == "first":
        return first_entity(open_news)
    raise ValueError(f"unknown routing: {variant}")


def outcomes(news: DataFrame, found: DataFrame, linked: DataFrame) -> DataFrame:
    """Per news: interaction, mention or skipped."""
    return (
        news.select("news_id")
        .join(linked.select("news_id").distinct().withColumn("_l", F.lit(True)), "news_id", "left")
        .join(found.select("news_id").distinct().withColumn("_f", F.lit(True)), "news_id", "left")
        .select(
            "news_id",
            F.when(F.col("_l"), "interaction").when(F.col("_f"), "mention").otherwise("skipped").alias("outcome"),
        )
    )
