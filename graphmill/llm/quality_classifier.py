"""Quality by hierarchical empirical Bayes: the evidence of a document, its path and its host.

A logistic classifier on text measures, fitted on at most ``DOCS`` labelled documents of each label (a
parameter; picked in order of a hash of their id), gives every document its own evidence. Paths and hosts
gather the evidence of all their documents, known labels in place of estimates: sums and counts, reduced
before the shuffle. A host's rate is drawn to the global rate, a path's to its host's, by as many
pseudo-documents as the spread between sites tells (method of moments over all sites): sparse sites stay near
their parent, well-known ones speak for themselves. A document's posterior odds are its own odds with the global
prior replaced by its path's rate without the document itself. It is kept from ``FLOOR`` on.

Measures are built-in functions and the classifier one expression; texts are read once and not moved. Narrow
evidence is written, then joined with the table of sites, which adaptive execution splits at hot hosts.

Null text is empty. A null host or path part counts as a site of its own, named by the empty text. Labels other than
0 and 1 are none; labels that contradict each other count as 0. Without labels of both kinds all evidence is 1/2 and
all rows are kept. Repeated rows count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import write
from graphmill.llm.quality_rules import STOP_WORDS
from graphmill.llm.toxicity import logistic

DOCS, FLOOR = 10_000, 0.5
SPACE = r"\\x20\\x09-\\x0D"
#: Odds beyond this are no better known.
MOST = 6.0

MEASURES = {
    "length": "log1p(n)",
    "word_length": "if(n = 0, 0D, least(length(joined) / n, 30D))",
    "symbols": "if(n = 0, 0D, sqrt(least(regexp_count(joined, '[#*$%&|<>{}~^=_\\\\\\\\]') / n, 4D)))",
    "calls": "if(n = 0, 0D, sqrt(least(regexp_count(joined, '[!?]') / n, 4D)))",
    "capitals": "regexp_count(joined, '[A-Z]') / (length(joined) + 1)",
    "digits": "regexp_count(joined, '[0-9]') / (length(joined) + 1)",
    "stop_words": "if(n = 0, 0D, sqrt(size(filter(words, w -> lower(w) in ({stop}))) / n))",
    "fresh_words": "if(n = 0, 0D, size(array_distinct(words)) / n)",
    "fresh_windows": "if(n < 4, 1D, size(array_distinct(windows)) / (n - 2))",
    "fresh_lines": "size(array_distinct(lines)) / greatest(size(lines), 1)",
}


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns of ``carry`` and the text measures, as ``m`` (an array in the order of MEASURES)."""
    rows = docs.select(F.struct(*carry).alias("keep"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.expr(f"regexp_extract_all(text, '[^{SPACE}]+', 0)"))
    rows = rows.select(
        "keep",
        "words",
        F.expr("size(words)").alias("n"),
        F.expr("array_join(words, '')").alias("joined"),
        F.expr("""if(size(words) < 4, array(), transform(sequence(0, size(words) - 3),
            i -> xxhash64(words[i], words[i + 1], words[i + 2])))""").alias("windows"),
        F.expr(f"filter(split(text, '\\n'), l -> l rlike '[^{SPACE}]')").alias("lines"),
    )
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    made = [F.expr(e.replace("{stop}", stop)).cast("double") for e in MEASURES.values()]
    return rows.select("keep.*", F.array(*made).alias("m"))


def _picked(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and quality of the learning rows, ``most`` of each label."""
    order = (F.xxhash64("doc_id"), "doc_id")
    parts = [labels.where(F.col("quality") == q).orderBy(*order).limit(most) for q in (0, 1)]
    return parts[0].unionByName(parts[1])


def fitted(docs: DataFrame, labels: DataFrame, most: int = DOCS) -> Column | None:
    """The classifier's log odds as an expression on ``m``; None where a label is missing."""
    # Two times ``most`` rows of an id and a label.
    sample = docs.select("doc_id", "text").join(F.broadcast(_picked(labels, most)), "doc_id")
    rows = measured(sample, ["quality"]).toPandas()
    y = rows["quality"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.stack(rows["m"].to_numpy())
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - centre) / scale
    # Measures and their squares: both ends of a measure can be bad.
    w = logistic(np.column_stack([z, np.minimum(z * z, 25)]), y)
    odds = F.lit(float(w[-1]))
    k = len(MEASURES)
    for i in range(k):
        value = (F.col("m")[i] - float(centre[i])) / float(scale[i])
        odds = odds + value * float(w[i]) + F.least(value * value, F.lit(25.0)) * float(w[k + i])
    return F.greatest(F.least(odds, F.lit(MOST)), F.lit(-MOST))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, parent: str) -> float:
    """Pseudo-documents that draw a site's rate to its parent's, from the spread of all sites around their parents."""
    part = F.col(parent) * (1 - F.col(parent))
    row = sites.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col(parent), 2)).alias("spread"),
        F.sum(F.col("n") * part).alias("inner"),
    ).first()
    if not row["n"]:
        return 1.0
    inner = row["inner"] / row["n"]
    room = row["n"] - row["nn"] / row["n"]
    between = (row["spread"] - max(row["k"] - 1, 0) * inner) / room if room > 0 else 0.0
    return float(min(max(inner / between - 1, 1.0), 1e6)) if between > 0 else 1e6


def _drawn(parent: str, strength: float) -> Column:
    return (F.col("good") + strength * F.col(parent)) / (F.col("n") + strength)


def site_rates(evidence: DataFrame) -> tuple[DataFrame, float, float]:
    """host, path, their sums and posterior rates; the global rate; the pseudo-documents of a path."""
    paths = evidence.groupBy("host", "path").agg(F.sum("x").alias("good"), F.count("*").alias("n"))
    paths = paths.persist()
    total = paths.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    hosts = hosts.withColumn("parent", F.lit(rate))
    hosts = hosts.withColumn("host_rate", _drawn("parent", _strength(hosts, "parent"))).select("host", "host_rate")
    sites = paths.join(hosts, "host")
    strength = _strength(sites, "host_rate")
    sites = sites.withColumn("path_rate", _drawn("host_rate", strength))
    path = write(sites, "sites")
    paths.unpersist()
    return evidence.sparkSession.read.parquet(path), rate, strength


def classify(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, most: int = DOCS, floor: float = FLOOR
) -> DataFrame:
    """One row per document: doc_id, k1 and k2 (hashes of id and text), evidence, host_rate, path_rate, score, kept."""
    spark = docs.sparkSession
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    told = told.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    odds = fitted(docs, told, most)
    rows = docs.select(
        "doc_id",
        "text",
        F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"),
        F.xxhash64("doc_id", "text").alias("k1"),
        F.hash("text").alias("k2"),
    )
    rows = measured(rows, ["doc_id", "host", "path", "k1", "k2"])
    rows = rows.withColumn("odds", odds if odds is not None else F.lit(0.0)).drop("m")
    evidence = spark.read.parquet(write(rows.withColumn("p", 1 / (1 + F.exp(-F.col("odds")))), "evidence"))
    if odds is not None:
        evidence = evidence.join(told, "doc_id", "left")
        evidence = evidence.withColumn("x", F.coalesce(F.col("quality").cast("double"), "p")).drop("quality")
    else:
        evidence = evidence.withColumn("x", F.col("p"))
    sites, rate, strength = site_rates(evidence)
    joined = evidence.join(sites, ["host", "path"])
    # The path's rate without what the document itself adds to it.
    others = (F.col("good") - F.col("x") + strength * F.col("host_rate")) / (F.col("n") - 1 + strength)
    others = F.greatest(F.least(others, F.lit(1 - 1e-4)), F.lit(1e-4))
    odds = F.col("odds") - float(np.log(rate / (1 - rate))) + _logit(others) if odds is not None else F.lit(0.0)
    joined = joined.withColumn("score", 1 / (1 + F.exp(-odds)))
    return joined.select(
        "doc_id",
        "k1",
        "k2",
        F.col("p").alias("evidence"),
        "host_rate",
        "path_rate",
        "score",
        (F.col("score") >= floor).alias("kept"),
    )


def only_kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of the documents that ``classify`` keeps, with all their columns."""
    spark = docs.sparkSession
    out = spark.read.parquet(write(judged.where("not kept").select("k1", "k2").distinct(), "rejected"))
    key = (F.xxhash64(docs["doc_id"], docs["text"]) == out["k1"]) & (F.hash(docs["text"]) == out["k2"])
    return docs.join(out, key, "left_anti")
