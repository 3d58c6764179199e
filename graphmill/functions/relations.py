"""Rules that turn a free-form relation into an edge type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.functions.clean import _col

REGION_LABELS = ["City", "Country"]


def pair_relation(c: Column | str) -> Column:
    """Edge type of a verified pair; null for same-entity and unknown answers.

    The first rule that fits wins: rival, partner, same entity, unknown.
    """
    text = F.upper(F.coalesce(_col(c), F.lit("NONE")))
    return F.when(text.contains("COMPETE") | text.contains("COMPETITOR"), F.lit("COMPETES_WITH")).when(
        text.contains("PARTNER"), F.lit("PARTNER_WITH")
    )


def pair_outcome(c: Column | str) -> Column:
    """Why a pair was kept or dropped: kept, same_entity or unknown."""
    text = F.upper(F.coalesce(_col(c), F.lit("NONE")))
    return (
        F.when(pair_relation(c).isNotNull(), F.lit("kept"))
        .when(text.contains("RELATED") | text.contains("SAME"), F.lit("same_entity"))
        .otherwise(F.lit("unknown"))
    )


def news_relation(c: Column | str, target_label: Column | str) -> Column:
    """Edge type of a news interaction, from its wording and the label of its target."""
    text = F.upper(F.coalesce(_col(c), F.lit("")))
    return (
        F.when(text.contains("PARTNER"), F.lit("PARTNER_WITH"))
        .when(text.contains("DISPUTE"), F.lit("IN_DISPUTE_WITH"))
        .when(text.contains("INVEST"), F.lit("INVESTED_IN"))
        .when(_col(target_label).isin(REGION_LABELS), F.lit("AFFECTS_REGION"))
        .otherwise(F.lit("RELATED_TO"))
    )


def upper_snake(c: Column | str) -> Column:
    """Free-form relation name as data: upper case, blanks to underscores."""
    return F.upper(F.replace(F.coalesce(_col(c), F.lit("RELATED_TO")), F.lit(" "), F.lit("_")))
