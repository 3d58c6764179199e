"""JSON held in text columns: profile fields and model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphmill import schemas
from graphmill.functions.clean import _col, strip


def _valid(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse_json(c: Column | str, schema: T.DataType) -> Column:
    """Text to ``schema``; null when the text as a whole is not JSON."""
    text = _col(c)
    return F.when(_valid(text), F.from_json(text, schema))


def repair_quotes(c: Column | str) -> Column:
    """Single quotes become double quotes, only in text that holds no double quote."""
    text = _col(c)
    return F.when(
        text.contains("'") & ~text.contains('"'), F.replace(text, F.lit("'"), F.lit('"'))
    ).otherwise(text)


def tolerant_json(c: Column | str, schema: T.DataType) -> Column:
    return parse_json(repair_quotes(c), schema)


def officers(c: Column | str) -> Column:
    return parse_json(c, schemas.OFFICERS)


def holders(c: Column | str) -> Column:
    return parse_json(c, schemas.HOLDERS)


def address(c: Column | str) -> Column:
    return parse_json(c, schemas.ADDRESS)


def officers_to_json(c: Column | str) -> Column:
    """Keep name, title and age of each officer, whatever else the record holds."""
    kept = F.transform(
        _col(c),
        lambda o: F.struct(o["name"].alias("name"), o["title"].alias("title"), o["age"].alias("age")),
    )
    return F.to_json(kept, {"ignoreNullFields": "false"})


def first_holders(c: Column | str, count: int = 5) -> Column:
    return F.slice(_col(c), 1, count)


def address_to_json(city: Column, state: Column, zip_code: Column, country: Column) -> Column:
    parts = {"city": city, "state": state, "zip": zip_code, "country": country}
    filled = [F.coalesce(part, F.lit("N/A")).alias(name) for name, part in parts.items()]
    return F.to_json(F.struct(*filled))


def response_body(c: Column | str) -> Column:
    """The JSON part of a model response: no code fences, outermost brackets only."""
    bare = strip(F.regexp_replace(_col(c), "```(json)?", ""))
    braces = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(bare.startswith("["), bare).when(braces != "", braces).otherwise(bare)


def _loose(schema: T.StructType) -> T.StructType:
    """The schema with lists of names read as text."""
    return T.StructType(
        [T.StructField(f.name, T.StringType() if f.dataType == schemas.STRINGS else f.dataType) for f in schema]
    )


def _names(text: Column) -> Column:
    """A list of names, also where a response gives one bare name in place of a list."""
    return F.when(text.startswith("["), F.from_json(text, schemas.STRINGS)).when(F.length(text) > 0, F.array(text))


def _strict(record: Column, schema: T.StructType) -> Column:
    fields = [
        (_names(record[f.name]) if f.dataType == schemas.STRINGS else record[f.name]).alias(f.name) for f in schema
    ]
    return F.when(record.isNotNull(), F.struct(*fields))


def parse_response(c: Column | str, schema: T.StructType) -> Column:
    """A response to ``schema``, the first item of a list, or null when unreadable."""
    body = response_body(c)
    first = F.try_variant_get(F.try_parse_json(body), "$[0]", "string")
    record = F.when(body.startswith("["), first).otherwise(body)
    return _strict(F.when(_valid(body) & record.startswith("{"), F.from_json(record, _loose(schema))), schema)


def with_record(df: DataFrame, response: str, schema: T.StructType, into: str = "parsed") -> DataFrame:
    """``parse_response`` as a column, in steps so that no part is evaluated twice."""
    staged = df.withColumn("_body", response_body(response)).withColumn("_json", F.try_parse_json("_body"))
    first = F.when(F.col("_body").startswith("["), F.try_variant_get("_json", "$[0]", "string"))
    staged = staged.withColumn("_record", F.coalesce(first, "_body"))
    readable = F.col("_json").isNotNull() & F.col("_record").startswith("{")
    staged = staged.withColumn("_read", F.when(readable, F.from_json("_record", _loose(schema))))
    return staged.withColumn(into, _strict(F.col("_read"), schema)).drop("_body", "_json", "_record", "_read")


def split_responses(
    df: DataFrame, response: str, schema: T.StructType, into: str = "parsed"
) -> tuple[DataFrame, DataFrame]:
    """Readable responses with their record, and the rejected rows for a quarantine table."""
    parsed = with_record(df, response, schema, into)
    return parsed.where(F.col(into).isNotNull()), parsed.where(F.col(into).isNull()).drop(into)


def named_evidence(c: Column | str, missing: str, bare: str) -> Column:
    """A JSON list whose items are records or bare names, to ``array<struct<name,evidence>>``.

    ``missing`` fills the evidence of a record without one, ``bare`` that of a bare name.
    """
    items = F.from_json(_col(c), T.ArrayType(T.StringType()))

    def one(item: Column) -> Column:
        record = F.from_json(item, "name string, evidence string")
        is_record = item.startswith("{")
        return F.struct(
            F.when(is_record, record["name"]).otherwise(item).alias("name"),
            F.when(is_record, F.coalesce(record["evidence"], F.lit(missing)))
            .otherwise(F.lit(bare))
            .alias("evidence"),
        )

    return F.transform(items, one)
