"""Ranking and cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCORE_DIGITS = 6


def top_k(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """Best k rows of one list (per-task heaps, then one merge of k rows each)."""
    return scored.orderBy(F.desc("score"), F.asc(key)).limit(k)


def rank_per_query(scored: DataFrame, max_k: int | None, k: Column | None = None,
                   order: list[Column] | None = None) -> DataFrame:
    """Add rank 1..k per query and keep the first k.

    A constant bound lets Spark cut every task's groups before the shuffle; `k` may differ
    per row and is never cut by more than a bound that all rows are known to keep.
    """
    order = order or [F.desc("score"), F.asc("chunk_id")]
    ranked = scored.withColumn("rank", F.row_number().over(
        W.partitionBy("query_id").orderBy(*order)))
    if max_k is not None:
        ranked = ranked.where(F.col("rank") <= max_k)
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def newest_per_key(df: DataFrame, keys: list[str], n: int,
                   order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """Newest n rows of each key; groups are cut to n in every task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return (df.withColumn("_newest", F.row_number().over(w))
            .where(F.col("_newest") <= n).drop("_newest"))
