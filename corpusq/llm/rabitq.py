"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is normalised, rotated by a fixed random rotation and kept as the signs of its
components, packed into bytes, with one correction scalar: the inner product of the unit
vector and its code. A query's inner product with the code, read from tables over the packed
bytes and divided by the scalar, estimates the cosine; the error is bounded with high
probability. Only vectors whose upper bound reaches the k-th best score so far are compared
exactly, on the original vectors in double precision.

Every vector is indexed and every code is compared with every query of the stated set, in
blocks of queries of bounded size. Vectors are never moved: a task keeps k hits per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpusq.llm.vectors import matrix, vector_rows

BLOCK_BYTES = 16 << 20      # vectors of the queries that one pass over the codes serves
TILE = 512                  # queries scored together
SAMPLE = 4096               # vectors that give every query its first threshold
CONFIDENCE = 2.4            # half-width of the error bound in standard deviations
PAIRS = 100_000             # pairs compared exactly at a time


def rotation(size: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(20240229).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs, and the inner product of each unit vector with its code."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn.T
    fit = np.abs(turned).sum(1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), fit


def code(vector: Column) -> Column:
    """struct<code: binary, fit: double> of a vector column."""
    @F.arrow_udf("struct<code: binary, fit: double>")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turns: dict[int, np.ndarray] = {}
        for rows in batches:
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            packed: list = [None] * len(rows)
            fits = np.zeros(len(rows))
            for size in np.unique(sizes).tolist():
                turn = turns.setdefault(size, rotation(size))
                at = np.flatnonzero(sizes == size)
                bits, fits[at] = encode(matrix(rows.take(pa.array(at))), turn)
                for i, b in zip(at.tolist(), bits, strict=True):
                    packed[i] = b.tobytes()
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(fits)],
                                             names=["code", "fit"])
    return codes(vector)


def build_index(rows: DataFrame, id_col: str = "vec_id",
                vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, code, fit) of every vector that takes part."""
    return vector_rows(rows, id_col, vector_col).withColumn("_c", code(F.col("vector"))).select(
        "vec_id", "vector", "_c.code", "_c.fit")


class Search:
    """The best k of a stream of vectors for a block of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.size = np.linalg.norm(queries, axis=1)
        turned = (queries / self.size[:, None]) @ rotation(queries.shape[1]).T
        width = -(-queries.shape[1] // 8)
        padded = np.zeros((len(queries), width * 8))
        padded[:, :queries.shape[1]] = turned
        self.parts = (padded / np.sqrt(queries.shape[1])).reshape(len(queries), width, 8)
        self.signs = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) * 2.0 - 1
        self.floor = floor                    # a score that k vectors are known to reach
        self.best = np.zeros((0, 3))          # query position, vec_id, score
        self.best_id = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray,
            fit: np.ndarray) -> None:
        error = CONFIDENCE * np.sqrt(np.maximum(1 - fit ** 2, 0) / max(
            vectors.shape[1] - 1, 1)) / fit
        size = np.linalg.norm(vectors, axis=1)
        for first in range(0, len(self.ids), TILE):
            tile = slice(first, first + TILE)
            parts = self.parts[tile]
            guess = np.zeros((len(ids), len(parts)))
            for b in range(codes.shape[1]):
                guess += (self.signs @ parts[:, b].T)[codes[:, b]]
            guess /= fit[:, None]
            near = guess + error[:, None] >= self.floor[tile] - 1e-9
            near &= ids[:, None] != self.ids[tile]
            item, query = np.nonzero(near)
            query = query + first
            found = []
            for i in range(0, len(item), PAIRS):
                a, b = item[i:i + PAIRS], query[i:i + PAIRS]
                score = (vectors[a] * self.queries[b]).sum(1) / (size[a] * self.size[b])
                on = score >= self.floor[b]
                found.append((b[on], ids[a[on]], score[on]))
            if found:
                self._keep(*[np.concatenate(c) for c in zip(*found, strict=True)])

    def _keep(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        query = np.concatenate([self.best[:, 0].astype(np.int64), query])
        ids = np.concatenate([self.best_id, ids])
        score = np.concatenate([self.best[:, 2], score])
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        on = place < self.k
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])
        self.best = np.column_stack([query[on], np.zeros(on.sum()), score[on]])
        self.best_id = ids[on]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.best[:, 0].astype(np.int64)], self.best_id, self.best[:, 2]


def first_floor(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray,
                sample: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score among sampled vectors: a bound that loses no result."""
    floor = np.full(len(ids), -np.inf)
    if len(sample_ids) <= k:
        return floor
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    for first in range(0, len(ids), TILE):
        q = queries[first:first + TILE]
        score = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ unit.T
        score[ids[first:first + TILE, None] == sample_ids] = -np.inf
        floor[first:first + TILE] = np.partition(score, -k, axis=1)[:, -k] - 1e-9
    return floor


def _block_hits(index: DataFrame, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray,
                k: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(ids, queries, floor.copy(), k)
        for batch in batches:
            if batch.num_rows:
                codes = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8)
                search.add(batch["vec_id"].to_numpy(), matrix(batch["vector"]),
                           codes.reshape(batch.num_rows, -1), batch["fit"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in search.hits()],
                                         ["query_id", "vec_id", "score"])
    same = index.where(F.size("vector") == queries.shape[1])
    return same.mapInArrow(scan, "query_id bigint, vec_id bigint, score double")


def ann_search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
               vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES,
               sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine for every query row.

    A query is not its own neighbour: rows with its id are left out. Ties go to the smaller
    vec_id. Vectors that are null, empty, zero or not finite, and rows without id, take no
    part; neither do vectors of another length than the query's. With fewer candidates than k
    all are returned; an empty table or query set gives no rows. Rows repeating an id are
    candidates each by itself; a query id is answered once (for its smallest vector). Other
    columns are not looked at.
    """
    spark = rows.sparkSession
    index = build_index(rows, id_col, vector_col)
    asked = vector_rows(queries, id_col, vector_col).groupBy("vec_id").agg(
        F.min("vector").alias("vector"))
    shape = asked.groupBy(F.size("vector").alias("n")).count().collect()
    parts = []
    for n, count in shape:
        blocks = max(1, -(-count * n * 8 // block_bytes))
        first = vector_rows(rows, id_col, vector_col).where(F.size("vector") == n).orderBy(
            F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
        for b in range(blocks):
            block = asked.where((F.size("vector") == n) & (F.pmod(
                F.xxhash64("vec_id"), F.lit(blocks)) == b)).orderBy("vec_id").toArrow()
            if not block.num_rows:
                continue
            ids = block["vec_id"].to_numpy()
            vectors = matrix(block["vector"].combine_chunks())
            floor = first_floor(ids, vectors, first["vec_id"].to_numpy(),
                                matrix(first["vector"].combine_chunks()), k)
            parts.append(_block_hits(index, ids, vectors, floor, k))
    if not parts:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
