"""Packing into batches by length: optimal buckets, then batches under a token budget.

The histogram of all lengths is one aggregate. Its bins are exact up to a few hundred tokens
and then as fine as 1/128 of the length, so it has at most some thousand entries whatever the
input. A dynamic program over it chooses the bucket boundaries with the least padding.
Documents of a bucket are dealt into shards of bounded size by a hash of their id, and each
shard fills batches of `budget // boundary` documents, each padded to the boundary.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.session import cut_lineage

BUCKETS = 8
BUDGET = 8192
SHARD_ROWS = 1000
FINE = 128          # bins per doubling of the length


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null."""
    plain = F.translate(text, "\t\n\x0b\x0c\r", " " * 5)
    return F.coalesce(F.size(F.array_remove(F.split(plain, " "), "")), F.lit(0)).cast("bigint")


def bin_top(length: Column, fine: int = FINE) -> Column:
    """Upper end of a length's histogram bin: the length rounded up to a multiple of the
    power of two that leaves `fine` to 2 * `fine` steps."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(
        F.greatest(length, F.lit(1)) + F.lit(0.5)) - np.log2(fine)))).cast("bigint")
    return (F.ceil(length / step) * step).cast("bigint")


def boundaries(tops: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket boundaries with the least padding: best[j] is the least padded size of the
    first j bins; a bucket over bins i..j-1 is padded to tops[j-1]. Of equal splits the one
    with the smallest i is taken; no more buckets are made than lower the padding."""
    n = len(tops)
    before = np.concatenate([[0], np.cumsum(counts)])
    best = np.concatenate([[0], tops * before[1:]]).astype(np.int64)
    splits = [np.zeros(n + 1, np.int64)]
    for _ in range(min(buckets, n) - 1):
        now, split = best.copy(), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + tops[j - 1] * (before[j] - before[:j])
            split[j] = int(np.argmin(cost))
            now[j] = cost[split[j]]
        splits.append(split)
        best = now
    out, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        out.append(int(tops[j - 1]))
        j = int(split[j])
    return sorted(out)


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id",
         buckets: int = BUCKETS, budget: int = BUDGET,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, n_tokens, bucket (its boundary), batch, slot (from 1), padding; one row per
    input row with tokens.

    `length` gives the tokens of a row, by default the words of `text`. A row without tokens
    (null, empty or blank text) has nothing to train on: bucket 0, batch, slot null. A
    document longer than the budget is a batch of its own, whole. Null ids come first inside
    their shard; repeated ids and rows stay separate entries. An empty table gives no rows.
    """
    size = word_count(F.col("text")) if length is None else length
    sized = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(
        size, F.lit(0)).cast("bigint").alias("n_tokens")))   # texts are read once
    binned = sized.withColumn("top", bin_top(F.col("n_tokens")))
    bins = (binned.where("n_tokens > 0").groupBy("top").agg(F.count(F.lit(1)).alias("c"))
            .orderBy("top").toPandas())
    tops, counts = bins["top"].to_numpy(np.int64), bins["c"].to_numpy(np.int64)
    bounds = boundaries(tops, counts, buckets) if len(tops) else []
    held = np.histogram(tops, [0, *[b + 1 for b in bounds]], weights=counts)[0] if bounds else []
    bucket, shards = F.lit(0), F.lit(1)
    for bound, rows in sorted(zip(bounds, held, strict=True), reverse=True):
        fits = (F.col("n_tokens") > 0) & (F.col("top") <= bound)
        bucket = F.when(fits, F.lit(bound)).otherwise(bucket)
        shards = F.when(fits, F.lit(max(1, -(-int(rows) // shard_rows)))).otherwise(shards)
    deal = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
                                    .cast("binary")), 1, 8), 16, 10).cast("bigint")
    placed = binned.select("doc_id", "n_tokens", bucket.cast("bigint").alias("bucket"),
                           (deal % shards).alias("shard"))
    inside = Window.partitionBy("bucket", "shard").orderBy(
        F.col("doc_id").asc_nulls_first(), "n_tokens")
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket"), F.lit(1))))
    full = placed.where("bucket > 0").withColumn("i", F.row_number().over(inside) - 1).select(
        "doc_id", "n_tokens", "bucket",
        F.concat_ws("-", "bucket", "shard", F.floor(F.col("i") / room).cast("string")
                    ).alias("batch"),
        (F.col("i") % room + 1).cast("bigint").alias("slot"),
        (F.col("bucket") - F.col("n_tokens")).alias("padding"))
    none = placed.where("bucket = 0").select(
        "doc_id", "n_tokens", "bucket", F.lit(None).cast("string").alias("batch"),
        F.lit(None).cast("bigint").alias("slot"), F.lit(0).cast("bigint").alias("padding"))
    return full.union(none)
