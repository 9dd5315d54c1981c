"""Rank fusion and re-ranking of short candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.text import words
from corpusq.operators.topk import SCORE_DIGITS, rank_per_query


def fuse(lexical: DataFrame, dense: DataFrame, queries: DataFrame,
         weight: float = fv.BM25_WEIGHT) -> DataFrame:
    """Weighted reciprocal-rank fusion of two ranked lists, cut to each query's top_k."""
    def votes(ranked: DataFrame, w: float) -> DataFrame:
        return ranked.select("query_id", "chunk_id", "doc_id",
                             (F.lit(float(w)) / (fv.RRF_CONSTANT + F.col("rank"))).alias("vote"))

    scored = (votes(lexical, weight).unionByName(votes(dense, 1.0 - weight))
              .groupBy("query_id", "chunk_id", "doc_id")
              .agg(F.round(F.sum("vote"), SCORE_DIGITS).alias("score")))
    # at most two lists of top_k rows per query: no key can be hot here
    wanted = scored.join(queries.select("query_id", "top_k"), "query_id")
    return rank_per_query(wanted, None, F.col("top_k")).drop("top_k")


def overlap_scores(candidates: DataFrame) -> DataFrame:
    """Default scorer: share of the question's distinct words found in the chunk.

    `candidates`: query_id, chunk_id, question, content.
    """
    asked = F.array_distinct(words(F.col("question")))
    shared = F.size(F.array_intersect(asked, words(F.col("content"))))
    return candidates.select(
        "query_id", "chunk_id",
        F.round(shared / F.greatest(F.size(asked), F.lit(1)), SCORE_DIGITS).alias("score"))


def rerank(candidates: DataFrame, scores: DataFrame, top_n: int = fv.RERANK_TOP_N) -> DataFrame:
    """Re-order each query's candidates by a score table and keep top_n.

    A candidate without a score counts 0; equal scores keep the order they came in.
    """
    given = scores.select("query_id", "chunk_id", F.col("score").alias("_new"))
    joined = (candidates.withColumnRenamed("rank", "_before").drop("score")
              .join(given, ["query_id", "chunk_id"], "left")
              .withColumn("score", F.coalesce("_new", F.lit(0.0))).drop("_new"))
    return rank_per_query(
        joined, top_n,
        order=[F.desc("score"), F.asc("_before"), F.asc("chunk_id")]).drop("_before")
