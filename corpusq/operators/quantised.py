"""Cosine search over codes: product-quantised residuals, bounded errors and bounded probing.

A unit vector is kept as the number of its cell (nearest of some hundred centres), for each of
its PARTS stretches the number of the codeword nearest to what the centre leaves over (Jegou,
Douze & Schmid 2011), and one byte a dimension for what the codewords leave (Jegou, Tavenard,
Douze & Amsaleg 2011). The length of what is left then bounds how far a score by code is off:
a vector, which lies beside its code, is scored exactly if that bound reaches the query's k-th
score, and only then. A query first looks into its nearest cells. A cell's members lie within
its radius of the centre, so their cosine is at most query * centre + radius: in a second round
the query looks into the cells where that reaches its k-th exact score, and into no others.
Nothing is cut by a count, hence nothing is missed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.operators.batch_topk import BLOCK_BYTES, batch_topk
from corpusq.operators.cells import MAX_CELLS, blocks_by_cell, cells_of
from corpusq.operators.scope import Scopes
from corpusq.operators.topk import rank_per_query
from corpusq.operators.vector import post_filter, query_columns
from corpusq.session import keep

# Vectors, chosen by a hash of their id, that centres and codewords are fitted on.
SAMPLE = 20_000
CELLS = 256
PARTS = 16
CODES = 256
PROBES = 16             # cells of the first round
ROUNDED = 2e-6          # scores are rounded to six digits


@dataclass(frozen=True)
class Codebooks:
    """`centres` (cells, dims), `radii` (cells), `words` (parts, codes, dims of a part), `step`
    of the byte that a dimension has for what the words leave."""

    centres: np.ndarray
    radii: np.ndarray
    words: np.ndarray
    step: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes, distance from the centre and from what the codes say, of unit vectors."""
        cell = nearest(x, self.centres)
        left = x - self.centres[cell]
        codes = np.stack([nearest(p, w) for p, w in zip(
            np.split(left, len(self.words), axis=1), self.words, strict=True)], 1)
        rest = left - self._of_words(codes)
        fine = np.clip(np.rint(rest / self.step), -128, 127) + 128
        codes = np.concatenate([codes, fine], axis=1).astype(np.uint8)
        off = x - self.decode(cell, codes)
        return cell, codes, np.sqrt((left * left).sum(1)), np.sqrt((off * off).sum(1))

    def decode(self, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        parts = len(self.words)
        fine = (codes[:, parts:].astype(np.float64) - 128) * self.step
        return self.centres[cell] + self._of_words(codes[:, :parts]) + fine

    def _of_words(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], axis=1)


@dataclass(frozen=True)
class QuantisedIndex:
    """`rows`: chunk_id, doc_id, cell, codes, off (what the code leaves), embedding."""

    rows: DataFrame
    books: Codebooks


def units(column: pa.Array) -> np.ndarray:
    """Vectors of length 1, one a row; a zero vector stays as it is."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)).argmin(1)


def k_means(x: np.ndarray, k: int, rounds: int, dice: np.random.Generator) -> np.ndarray:
    """Centres of a bounded sample; an empty cell keeps its centre."""
    centres = x[dice.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        cell = nearest(x, centres)
        size = np.bincount(cell, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, x)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


def fit(vectors: DataFrame, cells: int = CELLS, parts: int = PARTS, codes: int = CODES,
        sample: int = SAMPLE, rounds: int = 8, seed: int = 42) -> Codebooks:
    """Centres and codewords from at most `sample` vectors; radii are not known yet."""
    if not (1 <= cells <= MAX_CELLS and 1 <= codes <= 256):
        raise ValueError(f"cells must be 1..{MAX_CELLS}, codes 1..256")
    rows = (vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
            .orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).toArrow())
    if not rows.num_rows:
        raise ValueError("there is no vector to fit on")
    x, dice = units(rows["embedding"]), np.random.default_rng(seed)
    if x.shape[1] % parts:
        raise ValueError(f"dimensions must be a multiple of {parts} parts")
    centres = k_means(x, min(cells, len(x)), rounds, dice)
    left = x - centres[nearest(x, centres)]
    words = np.stack([k_means(p, min(codes, len(x)), rounds, dice)
                      for p in np.split(left, parts, axis=1)])
    rest = [p - w[nearest(p, w)] for p, w in zip(np.split(left, parts, axis=1), words, strict=True)]
    # what few dimensions have more of, counts as left by the code
    step = np.maximum(np.quantile(np.abs(np.concatenate(rest, axis=1)), 0.9999) / 127, 1e-9)
    return Codebooks(centres, np.zeros(len(centres)), words, np.asarray(step))


def quantise(vectors: DataFrame, books: Codebooks) -> QuantisedIndex:
    """All vectors with their codes; one pass, no shuffle, cells side by side within a task.
    Radii come from every vector."""
    def work(batches):
        for batch in batches:
            cell, codes, far, off = books.encode(units(batch["embedding"]))
            yield pa.RecordBatch.from_arrays(
                [batch["chunk_id"], batch["doc_id"], batch["embedding"], pa.array(cell, pa.int32()),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(off)],
                ["chunk_id", "doc_id", "embedding", "cell", "codes", "far", "off"])

    given = vectors.where(F.col("embedding").isNotNull()).select("chunk_id", "doc_id", "embedding")
    kind = given.schema["embedding"].dataType.simpleString()
    coded = keep(given.mapInArrow(
        work, f"chunk_id string, doc_id string, embedding {kind}, cell int, codes binary, "
              "far double, off double").sortWithinPartitions("cell"))
    radii = np.zeros(len(books.centres))
    for r in coded.groupBy("cell").agg(F.max("far").alias("far")).collect():   # <= MAX_CELLS
        radii[r["cell"]] = r["far"]
    return QuantisedIndex(coded.drop("far"), Codebooks(books.centres, radii, books.words, books.step))


def save_quantised(index: QuantisedIndex, path: str, files_per_cell: int = 4) -> None:
    """Vectors and codes by cell, and the books as rows of a short table."""
    deal = F.pmod(F.xxhash64("chunk_id"), F.lit(files_per_cell))
    index.rows.repartition("cell", deal).write.mode("overwrite").partitionBy("cell").parquet(
        f"{path}/codes")
    books = [(name, list(array.shape), array.ravel().tolist()) for name, array in
             (("centres", index.books.centres), ("radii", index.books.radii),
              ("words", index.books.words), ("step", index.books.step))]
    index.rows.sparkSession.createDataFrame(
        books, "name string, shape array<int>, value array<double>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/books")


def load_quantised(spark: SparkSession, path: str) -> QuantisedIndex:
    books = {r["name"]: np.array(r["value"]).reshape(r["shape"])
             for r in spark.read.parquet(f"{path}/books").collect()}
    return QuantisedIndex(spark.read.parquet(f"{path}/codes"), Codebooks(**books))


def _looked_into(vectors: pa.Array, books: Codebooks, first: int, kth: pa.Array | None
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Whether a query looks into a cell: the `first` nearest or, with `kth`, the others where a
    vector may score kth at least (a null one rules nothing out); and its nearest cell."""
    near = units(vectors) @ books.centres.T
    order = np.argsort(-near, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    if kth is None:
        return place < first, order[:, 0]
    least = np.nan_to_num(kth.to_numpy(zero_copy_only=False).astype(np.float64), nan=-2.0)
    return (place >= first) & (near + books.radii >= least[:, None] - ROUNDED), order[:, 0]


def probes(queries: DataFrame, books: Codebooks, first: int, kth: DataFrame | None = None
           ) -> DataFrame:
    """(query_id, scope_id): cells a query looks into, as strings. Without `kth` (query_id,
    kth) the `first` nearest, with it the others where a vector may reach kth; a null kth rules
    nothing out."""
    bounded = kth is not None

    def work(batches):
        for batch in batches:
            on, _ = _looked_into(batch["vector"], books, first, batch["kth"] if bounded else None)
            row, cell = np.nonzero(on)
            yield pa.RecordBatch.from_arrays(
                [batch["query_id"].take(pa.array(row)), pa.array(cell.astype(str))],
                ["query_id", "scope_id"])

    asked = queries.select("query_id", "vector")
    if bounded:
        asked = asked.join(kth, "query_id", "left")
    return asked.mapInArrow(work, "query_id string, scope_id string")


def _asked(wide: DataFrame, books: Codebooks, first: int, bounded: bool, block_bytes: int
           ) -> DataFrame:
    """Queries (query_columns and, for the second round, their floor) with the list of `cells`
    they look into and their block; those with a nearest cell in common are asked together."""
    def work(batches):
        for batch in batches:
            on, near = _looked_into(batch["vector"], books, first, batch["floor"] if bounded else None)
            ends = np.concatenate([[0], on.sum(1).cumsum()])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                             pa.array(np.nonzero(on)[1], pa.int16()))
            out = pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(near.astype(str))],
                                             [*batch.schema.names, "cells", "scope_id"])
            yield out.filter(pa.array(on.any(1)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.schema)
    listed = keep(wide.mapInArrow(work, f"{kinds}, cells array<smallint>, scope_id string"))
    return keep(blocks_by_cell(listed, block_bytes).drop("scope_id"), "block")


def quantised_topk(queries: DataFrame, index: QuantisedIndex, scopes: Scopes | None = None,
                   first: int = PROBES, block_bytes: int = BLOCK_BYTES,
                   counted: Accumulator | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank): the best chunks by cosine, with exact scores.

    The same rows as exact search: a cell is left out only if none of its members, and a vector
    only if it itself, cannot be among a query's best. With `scopes` five times top_k are fetched
    and those outside dropped, so that fewer than top_k may remain. `counted` is raised by the
    pairs scored exactly.
    """
    factor = 1 if scopes is None else fv.POST_FILTER_OVERFETCH
    wanted = keep(query_columns(queries, factor))

    def items(block: pa.Table) -> DataFrame:
        return index.rows.where(F.col("cell").isin(cells_of(block))).select(
            "chunk_id", "doc_id", "cell", "codes", "off", "embedding")

    def searched(wide: DataFrame, bounded: bool) -> DataFrame:
        return batch_topk(_asked(wide, index.books, first, bounded, block_bytes), items,
                          {"metric": "cosine", "decode": index.books.decode}, counted=counted)

    near = keep(searched(wanted, False).drop("rank"))
    kth = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor"))
    bounded = wanted.join(kth, "query_id", "left").withColumn(
        "floor", F.when(F.col("n") == F.col("fetch_k"), F.col("floor"))).drop("n")
    every = near.union(searched(bounded, True).drop("rank")).join(
        wanted.select("query_id", "fetch_k"), "query_id")
    found = rank_per_query(every, None, F.col("fetch_k")).drop("fetch_k")
    return found if scopes is None else post_filter(found, queries, scopes)
