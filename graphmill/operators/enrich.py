"""Candidate relations from similarity, and the edges inferred from decisions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions import relations, text
from graphmill.operators.upsert import EDGE_KEY, append_absent, log_summary
from graphmill.operators.vectors import collapse_copies, similar_pairs

# Evidence items shown per pair, source of inferred edges.
EVIDENCE_SHOWN = 10
INFERRED = "Inference + Others"


def _by_owner(pairs: DataFrame, side_a: DataFrame, side_b: DataFrame) -> DataFrame:
    return pairs.join(side_a, "rep_a").join(side_b, "rep_b").where("owner_a <> owner_b")


def owner_evidence(items: DataFrame, threshold: float, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pairs of owners whose items are alike: their count of item pairs, and the pairs to show.

    ``items``: id, vec, owner. Copies of a vector are one representative, so similarity is
    computed once per distinct vector and item pairs are counted by multiplying the number of
    copies each owner holds; the item pairs themselves are never formed. Returns (a, b,
    n_evidence) and the first ten per owner pair (a, b, rank, score, item_a, item_b), best score
    first. Ten vector pairs and ten copies per owner are enough to fill ten places, so the listing is exact.
    """
    reps, members = collapse_copies(items, ("owner",))
    alike = similar_pairs(reps, threshold, strict=strict).select(
        F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "score"
    )
    same = reps.select(F.col("id").alias("rep_a"), F.col("id").alias("rep_b"), F.lit(1.0).alias("score"))
    held = members.groupBy("rep", "owner").agg(F.count("*").alias("n"), F.min("id").alias("least"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{name}") for c in df.columns])

    # Copies of one vector meet once per owner pair, different vectors once per vector pair.
    alike, same = alike.withColumn("_same", F.lit(False)), same.withColumn("_same", F.lit(True))
    pairs = alike.unionByName(same)
    met = _by_owner(pairs, side(held, "a"), side(held, "b")).where(~F.col("_same") | (F.col("owner_a") < F.col("owner_b")))
    lower = F.col("owner_a") < F.col("owner_b")

    def of(name: str, first: str, second: str) -> Column:
        return F.when(lower, F.col(f"{name}_{first}")).otherwise(F.col(f"{name}_{second}"))

    met = met.select(
        of("owner", "a", "b").alias("a"), of("owner", "b", "a").alias("b"), "score",
        of("rep", "a", "b").alias("_ra"), of("rep", "b", "a").alias("_rb"),
        of("least", "a", "b").alias("_la"), of("least", "b", "a").alias("_lb"),
        (F.col("n_a") * F.col("n_b")).alias("_n"),
    )
    counts = met.groupBy("a", "b").agg(F.sum("_n").alias("n_evidence"))
    # A vector pair's first item pair comes before all its others, so ten vector pairs hold the ten to show.
    first = Window.partitionBy("a", "b").orderBy(F.desc("score"), "_la", "_lb")
    top = met.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= EVIDENCE_SHOWN)
    by_id = Window.partitionBy("rep", "owner").orderBy("id")
    few = members.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= EVIDENCE_SHOWN)
    few_a, few_b = (
        few.select(F.col("rep").alias(f"_r{c}"), F.col("owner").alias(c), F.col("id").alias(f"item_{c}")) for c in "ab"
    )
    shown = top.select("a", "b", "score", "_ra", "_rb").join(few_a, ["_ra", "a"]).join(few_b, ["_rb", "b"])
    best = Window.partitionBy("a", "b").orderBy(F.desc("score"), "item_a", "item_b")
    shown = shown.select("a", "b", "score", "item_a", "item_b").withColumn("rank", F.row_number().over(best))
    return counts, shown.where(F.col("rank") <= EVIDENCE_SHOWN)


def company_pairs(companies: DataFrame, threshold: float, same_group: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs of alike company descriptions: a, b, score of different vectors or of one held twice; and who holds them.

    ``companies``: id, vec, industry. All industries are compared unless ``same_group``. Companies
    with one and the same vector are held together by its lowest id; the second table (rep, id,
    industry) names the companies behind each. A vector that several companies hold is a pair with
    itself, with score 1. ``listed`` and ``counted`` give company pairs and their counts.
    """
    reps, members = collapse_copies(companies, ("industry",))
    held = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    same = held.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("score"))
    pairs = similar_pairs(reps, threshold).select("a", "b", "score")
    if same_group:
        groups = members.groupBy("rep").agg(F.collect_set("industry").alias("industries"))
        first, second = (groups.select(F.col("rep").alias(c), F.col("industries").alias(f"_{c}")) for c in "ab")
        pairs = pairs.join(first, "a").join(second, "b").where("arrays_overlap(_a, _b)").select("a", "b", "score")
    return (pairs.unionByName(same) if threshold < 1 else pairs), members


def _sides(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{c}_{name}") for c in df.columns])

    return (
        pairs.select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "score")
        .join(side(first, "a"), "rep_a").join(side(second, "b"), "rep_b")
    )


def listed(pairs: DataFrame, members: DataFrame, same_group: bool = False) -> DataFrame:
    """All pairs of companies behind ``company_pairs``: a < b, score, evidence. As many rows as there are pairs."""
    rows = _sides(pairs, members, members).where("rep_a <> rep_b or id_a < id_b")
    if same_group:
        rows = rows.where("industry_a = industry_b")
    industry = F.when(F.col("id_a") < F.col("id_b"), F.col("industry_a")).otherwise(F.col("industry_b"))
    rows = rows.select(
        F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "score", industry.alias("industry")
    )
    return rows.select("a", "b", "score", text.company_evidence("score", "industry").alias("evidence"))


def counted(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Company pairs between different industries (a < b), counted by multiplying copies, not by listing them."""
    held = members.groupBy("rep", "industry").agg(F.count("*").alias("n"))
    rows = _sides(pairs, held, held).where("industry_a <> industry_b and (rep_a <> rep_b or industry_a < industry_b)")
    return rows.groupBy(
        F.least("industry_a", "industry_b").alias("a"), F.greatest("industry_a", "industry_b").alias("b")
    ).agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_evidence"))


def combine_candidates(*counted: DataFrame) -> DataFrame:
    """Candidate pairs of several sources with their evidence counts added up."""
    rows = counted[0]
    for other in counted[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("a", "b").agg(F.sum("n_evidence").alias("n_evidence"))


def by_evidence(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy(F.desc("n_evidence"), "a", "b")


def inferred_facts(decisions: DataFrame, as_of: str) -> DataFrame:
    """Facts of verified pairs, one row each; dropped relations are left out.

    ``decisions``: a, b, type, topic, reason, evidence_used. ``fact`` identifies the fact whatever
    the day, ``entry`` is the dated record.
    """
    return decisions.withColumn("rel", relations.pair_relation("type")).where("rel is not null").select(
        F.lit("Company").alias("src_label"), F.col("a").cast("string").alias("src_key"), "rel",
        F.lit("Company").alias("dst_label"), F.col("b").cast("string").alias("dst_key"),
        text.fact_json("topic", "reason", "evidence_used").alias("fact"),
        text.fact_json("topic", "reason", "evidence_used", F.lit(as_of)).alias("entry"),
        F.lit(as_of).cast("date").alias("date"),
    )


def inferred_edges(facts: DataFrame, stored_log: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges with their dates and source, and the evidence log as one row per edge and fact."""
    log = append_absent(facts, stored_log, EDGE_KEY, "fact", ["date", "entry"])
    edges = log_summary(log, EDGE_KEY, "date", ["date", "fact"])
    return edges.withColumn("source", F.lit(INFERRED)), log
