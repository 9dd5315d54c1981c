"""Approximate search over a stored index: vectors in cells, queries probe a few cells
(inverted file; Jegou, Douze & Schmid 2011)."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.operators.batch_topk import BLOCK_BYTES, HIT_BYTES, batch_topk
from corpusq.operators.scope import Scopes
from corpusq.operators.vector import post_filter, query_columns, vector_topk
from corpusq.session import keep
from corpusq import fixed_values as fv

MAX_CELLS = 4096   # size bound of the centroid table and of the list of probed cells


@dataclass(frozen=True)
class CellIndex:
    """`rows`: chunk_id, doc_id, embedding, cell. `probes`: cells a query looks into, by default
    three quarters of all: vectors need not have clusters, and what lies in an unprobed cell is
    missed. See `operators.quantised` for a bound on that."""

    rows: DataFrame
    model: KMeansModel
    probes: int | None = None

    @property
    def looked_into(self) -> int:
        return self.probes or max(1, self.model.getK() * 3 // 4)


def _unit(vectors: DataFrame) -> DataFrame:
    wide = vectors.where(F.col("embedding").isNotNull()).withColumn(
        "_raw", array_to_vector(F.col("embedding").cast("array<double>")))
    return Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(wide).drop("_raw")


def train_cells(vectors: DataFrame, cells: int = 256, seed: int = 42, rounds: int = 10
                ) -> KMeansModel:
    """Cell centres of unit vectors."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be 1..{MAX_CELLS}")
    unit = keep(_unit(vectors).select("_unit"))      # read once per round
    return KMeans(k=cells, seed=seed, maxIter=rounds, featuresCol="_unit",
                  predictionCol="cell").fit(unit)


def cell_index(vectors: DataFrame, model: KMeansModel) -> DataFrame:
    """Vectors + their cell, one copy each; a narrow projection, no shuffle."""
    return model.transform(_unit(vectors)).select("chunk_id", "doc_id", "embedding", "cell")


def save_cells(index: DataFrame, path: str, files_per_cell: int = 4) -> None:
    """Partition by cell; the vectors of a large cell are spread over several files."""
    deal = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_cell))
    index.repartition("cell", deal).write.mode("overwrite").partitionBy("cell").parquet(path)


def probed_cells(queries: DataFrame, index: CellIndex) -> DataFrame:
    """(query_id, scope_id): the cells each query looks into, nearest centres first."""
    centres = queries.sparkSession.createDataFrame(
        [(str(i), str(i), [float(x) for x in c])
         for i, c in enumerate(index.model.clusterCenters())],
        "chunk_id string, doc_id string, embedding array<double>")
    near = vector_topk(queries.select("query_id", "vector", F.lit(index.looked_into).alias("top_k")),
                       centres)
    return near.select("query_id", F.col("chunk_id").alias("scope_id"))


def asked_by_query(queries: DataFrame, probed: DataFrame, block_bytes: int) -> DataFrame:
    """Queries (query_columns) + the list of `cells` they look into and their block: a query is
    sent and holds its hits once, however many cells it probes. Queries with a cell in common
    are asked together where they can be."""
    lists = probed.groupBy("query_id").agg(
        F.collect_list(F.col("scope_id").cast("smallint")).alias("cells"), F.min("scope_id").alias("scope_id"))
    return keep(blocks_by_cell(keep(queries.join(lists, "query_id")), block_bytes).drop("scope_id"), "block")


def blocks_by_cell(asked: DataFrame, block_bytes: int) -> DataFrame:
    """Queries + the block that asks them. Blocks hold whole cells where they can, so that a
    block reads few cells; the queries of a very popular cell are dealt over several blocks."""
    per_cell = asked.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("fetch_k").alias("hits"),
        F.max(F.size("vector")).alias("dims")).orderBy("scope_id").collect()  # <= MAX_CELLS
    first, many, block, filled = {}, {}, 0, 0
    for r in per_cell:
        size = r["n"] * r["dims"] * 8 + r["hits"] * HIT_BYTES
        if filled and filled + size > block_bytes:
            block, filled = block + 1, 0
        first[r["scope_id"]], many[r["scope_id"]] = block, max(1, -(-size // block_bytes))
        block, filled = block + many[r["scope_id"]] - 1, filled + size % block_bytes
    if not first:
        return asked.withColumn("block", F.lit(0))
    places = asked.sparkSession.createDataFrame(
        [(c, first[c], many[c]) for c in first], "scope_id string, _first int, _many int")
    return asked.join(F.broadcast(places), "scope_id").withColumn(
        "block", (F.col("_first") + F.pmod(F.xxhash64("query_id"), F.col("_many"))).cast("int")
    ).drop("_first", "_many")


def cells_of(block: pa.Table) -> list[int]:
    return pc.unique(pc.list_flatten(block["cells"])).to_pylist()


def cell_topk(queries: DataFrame, index: CellIndex, metric: str = "cosine",
              scopes: Scopes | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Best chunks of the nearest cells of each query, scored exactly.

    Only the probed cells are read from a saved index. A query is sent once with its cells;
    a vector lies in one cell, so no hit comes twice. No row is grouped by cell, hence a
    dominant cell is many tasks' work. With `scopes` five times top_k are fetched and those
    outside dropped, so that fewer than top_k may remain.
    """
    factor = 1 if scopes is None else fv.POST_FILTER_OVERFETCH
    wide = query_columns(queries, factor)
    asked = asked_by_query(wide, probed_cells(queries, index), block_bytes)

    def items(block: pa.Table) -> DataFrame:
        return index.rows.where(F.col("cell").isin(cells_of(block))).select(
            "chunk_id", "doc_id", "embedding", "cell")

    found = batch_topk(asked, items, {"metric": metric})
    return found if scopes is None else post_filter(found, queries, scopes)
