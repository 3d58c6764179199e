"""Profile tables: delimited text or parquet in, cleaned columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.functions import clean, jsontext
from graphmill.schemas import PROFILE_COLUMNS

TEXT_OPTIONS = {"header": "true", "quote": '"', "escape": '"'}


def text_options(multi_line: bool) -> dict[str, str]:
    """Options of delimited text. Fields that hold line ends need ``multi_line``, and then one task reads a whole file."""
    return TEXT_OPTIONS | {"multiLine": str(multi_line).lower()}


def detect_separator(spark: SparkSession, path: str) -> str:
    """``;`` or ``,``, whichever the header line holds more of."""
    first = spark.read.text(path).first()
    header = first["value"] if first else ""
    return ";" if header.count(";") >= header.count(",") else ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited text with a header, every column a string."""
    return spark.read.options(**text_options(multi_line), sep=sep or detect_separator(spark, path)).csv(path)


def read_profiles(spark: SparkSession, path: str, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """Profile rows under our column names; columns the file lacks are null."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = read_delimited(spark, path, sep, multi_line)
    return rename_columns(raw)


def rename_columns(raw: DataFrame) -> DataFrame:
    """Known columns under our names, then any others (such as ``seq``) as they are."""
    known = [
        (F.col(f"`{source}`") if source in raw.columns else F.lit(None).cast("string")).alias(name)
        for source, name in PROFILE_COLUMNS.items()
    ]
    return raw.select(*known, *[c for c in raw.columns if c not in PROFILE_COLUMNS])


def fill_unknown(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Named columns with their null values filled."""
    return df.fillna(values)


def blank_placeholders(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: clean.blank_to_null(c) for c in columns})


def first_rows(df: DataFrame, count: int, order: str = "seq") -> DataFrame:
    return df.orderBy(order).limit(count)


def assemble_profiles(listing: DataFrame, quotes: DataFrame) -> DataFrame:
    """The profile table from an index listing and fetched quotes, one row per listed company.

    ``listing``: symbol, security, sector, industry. ``quotes``: symbol, short_name, market_cap,
    employees, website, summary, officers, holders, city, state, zip, country; a company without
    a quote keeps its listing values. Holders are cut to the first five.
    """
    missing = F.lit(clean.PLACEHOLDER)
    listed = listing.withColumn("symbol", clean.normalise_ticker("symbol"))
    return listed.join(quotes, "symbol", "left").select(
        F.col("symbol").alias("ticker"),
        F.coalesce("short_name", "security").alias("name"),
        F.coalesce("sector", missing).alias("sector"),
        F.coalesce("industry", missing).alias("industry"),
        F.coalesce(F.col("market_cap").cast("string"), missing).alias("market_cap"),
        F.coalesce(F.col("employees").cast("string"), missing).alias("employees"),
        F.coalesce("website", missing).alias("website"),
        F.coalesce("summary", F.lit("Description not found")).alias("description"),
        F.coalesce(jsontext.officers_to_json("officers"), F.lit("[]")).alias("officers_json"),
        F.coalesce(F.to_json(jsontext.first_holders("holders")), F.lit("[]")).alias("holders_json"),
        jsontext.address_to_json(F.col("city"), F.col("state"), F.col("zip"), F.col("country")).alias("address_json"),
    )
