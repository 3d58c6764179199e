"""News tables under any of their column spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import clean
from graphmill.sources.profiles import read_delimited

# Our column -> the spellings it may have in the input, in order of preference.
ALIASES = {
    "headline": ["headline", "Headlines"],
    "body": ["text", "Description"],
    "time": ["Time", "date"],
    "categories": ["GICS_Subsectors_Mapped"],
}


def normalise_news(raw: DataFrame, as_of: str) -> DataFrame:
    """headline, body, raw time, parsed date and category list; other columns pass through."""

    def pick(name: str) -> Column:
        present = [F.col(c) for c in ALIASES[name] if c in raw.columns]
        return F.coalesce(*present, F.lit("")) if present else F.lit("")

    used = {c for spellings in ALIASES.values() for c in spellings}
    return raw.select(
        *[c for c in raw.columns if c not in used],
        pick("headline").alias("headline"),
        pick("body").alias("body"),
        pick("time").cast("string").alias("time"),
        clean.parse_news_date(pick("time").cast("string"), as_of).alias("date"),
        clean.split_list(pick("categories")).alias("categories"),
    )


def read_news(
    spark: SparkSession, path: str, as_of: str, sep: str | None = None, multi_line: bool = False
) -> DataFrame:
    return normalise_news(read_delimited(spark, path, sep, multi_line), as_of)


def category_rows(news: DataFrame) -> DataFrame:
    """One row per news and category."""
    return news.select("news_id", F.explode("categories").alias("category")).distinct()
