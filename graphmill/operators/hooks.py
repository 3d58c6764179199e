"""Places where a model of the user's choice enters a job, and the built-in text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def embed(
    df: DataFrame,
    load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]],
    text: str = "text",
    into: str = "vec",
) -> DataFrame:
    """Add a vector column from a model that ``load`` opens once per Python worker task.

    The model sees one Arrow batch of texts at a time; nothing is gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            vectors = model(batch[text].tolist())
            yield batch.assign(**{into: [list(map(float, v)) for v in vectors]})

    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def decide(
    pairs: DataFrame, load: Callable[[], Callable[[pd.DataFrame], Sequence[str | None]]], into: str = "response"
) -> DataFrame:
    """Add the response of a decision function to each candidate row, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = load()
        for batch in batches:
            yield batch.assign(**{into: list(judge(batch))})

    return pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, T.StructField(into, T.StringType())]))


def text_vectors(df: DataFrame, text: str = "text", into: str = "vec", dimension: int = 384) -> DataFrame:
    """Unit vectors of hashed, weighted words: the default when no model is given."""
    stages = Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension),
            IDF(inputCol="_counts", outputCol="_weights"),
            Normalizer(inputCol="_weights", outputCol="_unit"),
        ]
    )
    weighted = stages.fit(df).transform(df)
    return weighted.withColumn(into, vector_to_array("_unit")).drop("_words", "_counts", "_weights", "_unit")
