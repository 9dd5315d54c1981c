"""Text -> unit vectors: a deterministic offline default, or the caller's function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import words


def _hashed_words(df: DataFrame, text: str, out: str, dims: int) -> DataFrame:
    """Add how often each of `dims` buckets is met by a text's words; no words: all zero."""
    tokens = f"_{out}_tokens"
    staged = df.withColumn(tokens, F.coalesce(words(F.col(text)), F.array().cast("array<string>")))
    return HashingTF(numFeatures=dims, inputCol=tokens, outputCol=out).transform(staged).drop(tokens)


def fit_idf(df: DataFrame, text: str, dims: int = 256) -> IDFModel:
    """Weight ln((n + 1) / (m + 1)) of each bucket that m of the n texts meet.

    Null and empty texts count in n and meet nothing; without texts nothing can be fitted
    (ValueError). One vector of `dims` counts comes from each task. The model is stored by
    `model.write().save(path)`, read by `IDFModel.load(path)`, and serves new texts as it is.
    """
    if df.isEmpty():
        raise ValueError("no texts to take frequencies from")
    staged = _hashed_words(df.select(F.col(text).alias("text")), "text", "tf", dims)
    return IDF(inputCol="tf", outputCol="weighted").fit(staged)


def embed_column(df: DataFrame, text: str, out: str = "embedding", dims: int = 256,
                 model: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None,
                 idf: IDFModel | None = None) -> DataFrame:
    """Add an ARRAY<FLOAT> vector of norm 1 for a text column.

    Default: hashed term frequencies, normalised; with `idf` (see fit_idf, which decides the
    number of dimensions) weighted by how rare they are, and all zero if every text meets
    all of a text's buckets. `model` maps batches of texts to batches of float lists and is
    loaded once per Python worker.
    """
    if model is not None:
        hook = F.pandas_udf(model, "array<float>")
        return df.withColumn(out, hook(F.col(text)))
    tf, weighted, unit = f"_{out}_tf", f"_{out}_weighted", f"_{out}_unit"
    staged = _hashed_words(df, text, tf, dims if idf is None else len(idf.docFreq))
    if idf is not None:
        staged = idf.copy().setInputCol(tf).setOutputCol(weighted).transform(staged)
    staged = Normalizer(p=2.0, inputCol=tf if idf is None else weighted, outputCol=unit).transform(staged)
    return (staged.withColumn(out, vector_to_array(F.col(unit), "float32"))
            .drop(tf, weighted, unit))
