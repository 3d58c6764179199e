"""The registered queries of the text operators."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from graphmill.llm import (
    chat,
    collocations,
    decontamination,
    language,
    license_scan,
    packing,
    periodic,
    quality_classifier,
    quality_rules,
    simhash,
    substring,
    toxicity,
    winnowing,
)
from graphmill.plans.registry import Registry

query = Registry()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    path = F.concat_ws("/", "source", "lang")
    return quality_classifier.classify(docs, labels, F.col("source"), path).drop("k1", "k2")


@query("op2_license_scan", license_scan.duckdb_sql())
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents"))


@query("op3_quality_rules", quality_rules.duckdb_sql())
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf, "documents"))


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents")).drop("ids")


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.judge(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_substring_dedup")
def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        F.col("keep.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


#: The conversation that holds the markers a template might use.
TRAP = "\\### Assistant: </turn> ok"


@query("op9_chat_format")
def op9_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    trap = [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    return chat.read_back(chat.windows(turns.unionByName(spark.createDataFrame(trap, turns.schema))))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a text, which in a tenth of the documents repeat with a period from some word on."""
    h = crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.find_runs(table(spark, sf, "documents"), change=planted)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = periodic.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_fingerprints")
def op12_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return winnowing.compared(table(spark, sf, "documents"))


@query("op13_collocations", collocations.duckdb_sql())
def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
