"""Top-k items for a table of queries, in successive blocks of queries of bounded size.

For every block each task scores its own items in place against the block's queries and keeps
k per query, so only k rows per query and task are shuffled; items and scored pairs never
leave a task. A block is bounded by its bytes, vectors and hits together, whatever the number
of queries; only one block's vectors are on the driver at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.operators.scoring import make_block
from corpusq.operators.topk import rank_per_query
from corpusq.session import keep

BLOCK_BYTES = 64 * 1024 * 1024   # vectors and held hits of one block of queries
HIT_BYTES = 200                  # one hit held for a query
TASKS = 4                        # tasks for each core, of all blocks together
OUT_DDL = "query_id string, fetch_k int, chunk_id string, doc_id string, score double"


def scoped_items(items: DataFrame, scope_docs: DataFrame | None, all_scoped: bool) -> DataFrame:
    """Items + the list of scopes that may see them; unseen items go when no query is
    unrestricted. Whether the list is broadcast is left to Spark, by its size."""
    if scope_docs is None:
        return items
    allowed = scope_docs.groupBy("doc_id").agg(F.collect_set("scope_id").alias("scopes"))
    return items.join(allowed, "doc_id", "inner" if all_scoped else "left")


def block_count(queries: DataFrame, block_bytes: int) -> tuple[int, int]:
    """Number of blocks the queries need, and the largest number of hits asked for."""
    row = queries.agg(F.count(F.lit(1)).alias("n"), F.max("fetch_k").alias("k"),
                      F.sum("fetch_k").alias("hits"), F.max(F.size("vector")).alias("dims")).first()
    if not row["n"]:
        return 0, 0
    size = row["n"] * row["dims"] * 8 + row["hits"] * HIT_BYTES
    return max(1, math.ceil(size / block_bytes)), row["k"]


def batch_topk(queries: DataFrame, items: DataFrame | Callable[[pa.Table], DataFrame],
               options: dict, scope_docs: DataFrame | None = None,
               block_bytes: int = BLOCK_BYTES, counted: Accumulator | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank).

    `queries`: query_id, fetch_k, vector, optional scope_id (NULL = unrestricted), optional
    `floor` (a score that all wanted hits are known to reach) and optional `block` (0, 1, ...;
    dealt by a hash of the query otherwise). `items`: chunk_id, doc_id, embedding and, unless
    `scope_docs` gives them, `scopes`; or a function from a block's queries to its items.
    `counted` is raised by the pairs whose cosine is taken in double precision.
    """
    spark = queries.sparkSession
    if "block" in queries.columns:
        top = queries.agg(F.max("block").alias("b"), F.max("fetch_k").alias("k")).first()
        blocks, max_k = (top["b"] + 1, top["k"]) if top["b"] is not None else (0, 0)
        dealt = queries
    else:
        blocks, max_k = block_count(queries, block_bytes)
        dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))))
        dealt = keep(dealt, "block") if blocks > 1 else dealt
    # every task returns k hits a query: the more blocks, the fewer tasks for each
    tasks = math.ceil(TASKS * max(spark.sparkContext.defaultParallelism, 8) / max(blocks, 1))
    parts = []
    for b in range(blocks):
        asked = dealt.where(F.col("block") == b).drop("block").toArrow()
        if not asked.num_rows:
            continue
        own = items(asked) if callable(items) else items
        all_scoped = "scope_id" in asked.column_names and asked["scope_id"].null_count == 0
        own = scoped_items(own, scope_docs, all_scoped)
        parts.append(_one_block(spark, asked, own.coalesce(tasks) if blocks > 1 else own, options, counted))
    if not parts:
        return spark.createDataFrame([], OUT_DDL + ", rank int").drop("fetch_k")
    # the tasks' lists are already cut to each query's k, so the k best of their union
    # follow from a rank bound that travels with the hit
    best = reduce(DataFrame.union, parts)
    return rank_per_query(best, max_k, F.col("fetch_k")).drop("fetch_k")


def _one_block(spark, asked: pa.Table, items: DataFrame, options: dict,
               counted: Accumulator | None) -> DataFrame:
    # Spark's own broadcast, so that tasks on one machine share the copy
    shared = spark.sparkContext.broadcast(to_bytes(asked))

    def run(batches):
        block = make_block(from_bytes(shared.value), options)
        for batch in batches:
            block.add(batch)
        if counted is not None:
            counted.add(block.scorer.exact_pairs)
        yield block.result()

    return items.mapInArrow(run, OUT_DDL)


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(data)).read_all()
