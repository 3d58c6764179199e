"""Texts made from node and news columns. The wording is fixed: vectors and logs depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphmill.functions.clean import COMPANY_INFO, LABEL_INFO, VECTOR_DESCRIPTION, _col, prefix


def company_text(name: str, ticker: str, description: str, length: int = VECTOR_DESCRIPTION) -> Column:
    """Name, ticker and leading description; null when any of them is missing."""
    return F.concat(
        F.lit("Company: "), _col(name), F.lit(" ("), _col(ticker), F.lit("). Description: "),
        prefix(description, length),
    )


def company_short_text(name: str, ticker: str) -> Column:
    return F.concat(F.lit("Company: "), _col(name), F.lit(", Ticker: "), _col(ticker))


def labelled_text(label: str, name: str, ticker: str, description: str) -> Column:
    """Label and name, then ticker and description where they exist."""
    return F.concat(
        _col(label), F.lit(": "), _col(name),
        F.coalesce(F.concat(F.lit(" ("), _col(ticker), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(". Info: "), prefix(description, LABEL_INFO)), F.lit("")),
    )


def entity_text(label: str, name: str, ticker: str, description: str, title: str, company: str) -> Column:
    """Wording by label: company, person, fund, anything else."""
    label_, name_ = _col(label), _col(name)
    return (
        F.when(
            label_ == "Company",
            F.concat(
                F.lit("Company: "), name_, F.lit(" ("), _col(ticker), F.lit("). Info: "),
                F.coalesce(prefix(description, COMPANY_INFO), F.lit("")),
            ),
        )
        .when(
            label_ == "Person",
            F.concat(
                F.lit("Person: "), name_, F.lit(". Position: "),
                F.coalesce(_col(title), F.lit("Expert")), F.lit(" in "),
                F.coalesce(_col(company), F.lit("S&P 500 context")),
            ),
        )
        .when(label_ == "Fund", F.concat(F.lit("Financial Fund: "), name_, F.lit(". Institutional holder.")))
        .otherwise(F.concat(label_, F.lit(": "), name_))
    )


def industry_text(industry: str, description: str) -> Column:
    return F.concat(
        F.coalesce(_col(industry), F.lit("Unknown")), F.lit(": "), F.coalesce(_col(description), F.lit(""))
    )


def company_search_text(name: str, description: str) -> Column:
    return F.concat(F.lit("Company: "), _col(name), F.lit("\nDescription: "), _col(description))


def news_search_text(date: str, headline: str, body: str) -> Column:
    return F.concat(
        F.lit("News Date: "), _col(date).cast("string"), F.lit("\nHeadline: "), _col(headline),
        F.lit("\nContent: "), _col(body),
    )


def news_full_text(headline: str, body: str, separator: str = "\n") -> Column:
    return F.concat_ws(separator, _col(headline), _col(body))


def key_of(label: str, ticker: str, name: str) -> Column:
    """The value that identifies a node: the ticker of a company, else the name."""
    return F.when(_col(label) == "Company", _col(ticker)).otherwise(_col(name))


def key_field(label: str) -> Column:
    return F.when(_col(label) == "Company", F.lit("ticker")).otherwise(F.lit("name"))


def two_decimals(score: Column | str) -> Column:
    """Score as text with two decimals, halves to the even digit."""
    return F.bround(_col(score).cast("decimal(18,9)"), 2).cast("decimal(18,2)").cast("string")


def product_evidence(score: str, a: str, b: str) -> Column:
    return F.concat(
        F.lit("Similar products ("), two_decimals(score), F.lit("): '"), _col(a).cast("string"),
        F.lit("' vs '"), _col(b).cast("string"), F.lit("'"),
    )


def company_evidence(score: str, industry: str) -> Column:
    return F.concat(
        F.lit("High business description similarity ("), two_decimals(score), F.lit(") in sector "),
        _col(industry).cast("string"),
    )


def log_line(date: str, sentiment: str, headline: str, summary: str) -> Column:
    """One line of news history; the headline stands in for a missing summary."""
    return F.concat(
        F.lit("["), _col(date).cast("string"), F.lit("] "),
        F.coalesce(_col(sentiment), F.lit("NEUTRAL")), F.lit(": "), _col(headline), F.lit(" -> "),
        F.coalesce(_col(summary), _col(headline)),
    )


def fact_json(topic: str, reason: str, evidence: str, recorded: Column | str | None = None) -> Column:
    """A relation fact as JSON. Without ``recorded`` it is the key two runs share."""
    fields = [
        F.coalesce(_col(topic), F.lit("General")).alias("topic"),
        F.coalesce(_col(reason), F.lit("")).alias("reason"),
        F.coalesce(_col(evidence), F.lit("Vector Inference")).alias("specific_evidence"),
        F.lit("AI Inference").alias("source"),
    ]
    if recorded is not None:
        fields.append(_col(recorded).cast("string").alias("date_recorded"))
    return F.to_json(F.struct(*fields))
