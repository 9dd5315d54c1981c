"""Nearest chunks by vector: exact, scoped by filtering before or after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.operators.batch_topk import BLOCK_BYTES, batch_topk
from corpusq.operators.scope import Scopes
from corpusq.operators.skew import lookup_join
from corpusq.operators.topk import rank_per_query


def query_columns(queries: DataFrame, factor: int = 1, scoped: bool = False) -> DataFrame:
    return queries.select(
        "query_id", (F.col("top_k") * factor).cast("int").alias("fetch_k"),
        F.col("vector").cast("array<double>").alias("vector"), *(["scope_id"] if scoped else []))


def vector_topk(queries: DataFrame, vectors: DataFrame, metric: str = "cosine",
                scopes: Scopes | None = None, mode: str = "pre",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Best chunks per query: (query_id, chunk_id, doc_id, score, rank).

    `queries`: query_id, vector, top_k and, with `scopes`, scope_id. `vectors`: chunk_id,
    doc_id, embedding. Each query gets as many hits as its top_k says. Mode 'pre' searches
    inside the scope; 'post' searches everything for 5 x top_k, filters, and may therefore
    return fewer than top_k.
    """
    items = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "doc_id", "embedding")
    options = {"metric": metric}
    if scopes is None:
        return batch_topk(query_columns(queries), items, options, None, block_bytes)
    if mode == "pre":
        return batch_topk(query_columns(queries, scoped=True), items, options, scopes.docs,
                          block_bytes)
    found = batch_topk(query_columns(queries, fv.POST_FILTER_OVERFETCH), items, options, None,
                       block_bytes)
    return post_filter(found, queries, scopes)


def post_filter(found: DataFrame, queries: DataFrame, scopes: Scopes) -> DataFrame:
    """Keep the hits inside each query's scope and rank them again."""
    wanted = found.drop("rank").join(queries.select("query_id", "top_k", "scope_id"), "query_id")
    free = wanted.where(F.col("scope_id").isNull())
    inside = lookup_join(wanted.where(F.col("scope_id").isNotNull()), scopes.docs,
                         ["scope_id", "doc_id"], spread="chunk_id", how="left_semi")
    return rank_per_query(free.unionByName(inside), None, F.col("top_k")).drop("top_k", "scope_id")


def nearest(vectors: DataFrame, vector: list[float], k: int = fv.DEFAULT_TOP_K) -> DataFrame:
    """Top k of one query vector, all in the JVM. A zero vector is at cosine 0 to all."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    x = F.col("embedding").cast("array<double>")
    dot = F.aggregate(F.zip_with(x, q, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    size = sum(v * v for v in vector) ** 0.5
    score = F.round(F.coalesce(F.try_divide(dot, norm * F.lit(size)), F.lit(0.0)), 6)
    return (vectors.where(F.col("embedding").isNotNull())
            .select("chunk_id", "doc_id", score.alias("score"))
            .orderBy(F.desc("score"), "chunk_id").limit(k))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true hits that were found, per query."""
    hits = found.select("query_id", "chunk_id").withColumn("_hit", F.lit(1))
    return (truth.select("query_id", "chunk_id").join(hits, ["query_id", "chunk_id"], "left")
            .groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall")))
