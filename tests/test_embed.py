"""Rarity weights of hashed words, against plain sums."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import IDFModel
from pyspark.sql import functions as F

from corpusq.functions.embed import embed_column, fit_idf
from corpusq.plans.ingest import build_vectors

TEXTS = ["the bank the loan", "The bank", "the tax  audit\n", "the", "", None, "the bank", "x " * 5000]
DIMS = 64


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def plain(spark, texts, fitted_on):
    """Unit vectors from the buckets of single words and counted frequencies."""
    split = lambda t: (t or "").lower().split()
    words = sorted({w for t in [*texts, *fitted_on] for w in split(t)})
    rows = embed_column(frame(spark, words), "text", dims=DIMS).orderBy("id").collect()
    bucket = {w: int(np.argmax(r["embedding"])) for w, r in zip(words, rows, strict=True)}
    met = np.zeros(DIMS)
    for t in fitted_on:
        met[list({bucket[w] for w in split(t)})] += 1
    weight = np.array([math.log((len(fitted_on) + 1) / (m + 1)) for m in met])
    out = []
    for t in texts:
        v = np.zeros(DIMS)
        for w in split(t):
            v[bucket[w]] += 1
        v *= weight
        out.append(v / (np.linalg.norm(v) or 1))
    return np.array(out)


def vectors(df):
    return np.array([r["embedding"] for r in df.orderBy("id").collect()])


def test_weights(spark):
    got = vectors(embed_column(frame(spark), "text", idf=fit_idf(frame(spark), "text", DIMS)))
    assert np.allclose(got, plain(spark, TEXTS, TEXTS), atol=1e-6)
    assert not got[4].any() and not got[5].any()


def test_stored_weights_serve_new_texts(spark, tmp_path):
    fit_idf(frame(spark), "text", DIMS).write().save(str(tmp_path / "idf"))
    new = ["the audit of the bank", "unseen words", None]
    got = vectors(embed_column(frame(spark, new), "text", idf=IDFModel.load(str(tmp_path / "idf"))))
    assert np.allclose(got, plain(spark, new, TEXTS), atol=1e-6)


def test_word_of_every_text_weighs_nothing(spark):
    same = frame(spark, ["the", "the the"])
    assert not vectors(embed_column(same, "text", idf=fit_idf(same, "text", DIMS))).any()


def test_no_texts(spark):
    with pytest.raises(ValueError):
        fit_idf(frame(spark, []), "text")


def test_vectors_of_chunks(spark):
    chunks = frame(spark).select(F.col("id").cast("string").alias("chunk_id"), F.lit("d").alias("doc_id"),
                                 F.col("text").alias("content"))
    got = build_vectors(chunks, idf=fit_idf(chunks, "content", DIMS))
    assert got.columns == ["chunk_id", "doc_id", "embedding", "norm"]
    for r in got.collect():
        assert len(r["embedding"]) == DIMS and min(abs(r["norm"] - 1), abs(r["norm"])) < 1e-5
