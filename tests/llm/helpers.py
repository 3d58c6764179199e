"""Small tables with the odd rows that every operator has to bear."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], DOCS)


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
