"""Arrow-batch scoring inside tasks: score a batch of items, keep the best per query.

Small helpers only. Spark partitions the items, hands over Arrow batches and merges the
per-task lists; nothing here sees more than one batch of items and one block of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 1_000_000  # scores held at once
PAIRS = 50_000     # pairs of vectors held at once
OUT_SCHEMA = pa.schema([("query_id", pa.string()), ("fetch_k", pa.int32()),
                        ("chunk_id", pa.string()), ("doc_id", pa.string()),
                        ("score", pa.float64())])
DIGITS = 6


def _matrix(column: pa.Array) -> np.ndarray:
    """List column -> float64 matrix (one row per list)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if n and flat.size % n:
        raise ValueError("vectors of one column must have the same length")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


class DenseScorer:
    """Cosine, dot product or negative Euclidean distance.

    Cosines are bounded in single precision; only pairs whose bound reaches the query's floor
    are scored in double precision. With `decode` the bounds come from the items' codes: `off`
    is the length of what a code leaves of its unit vector, so no cosine is further off.
    """

    def __init__(self, queries: pa.Table, metric: str, decode=None):
        self.metric, self.decode = metric, decode
        self.exact_pairs = 0
        self.q = _matrix(queries["vector"])
        if metric == "cosine":
            self.q = _unit(self.q)
            # an item's bound is one more dimension, at which every query has a one
            self.wide = np.c_[self.q, np.ones(len(self.q))].astype(np.float32)

    def load(self, batch) -> None:
        self.x = _matrix(batch["embedding"])
        if self.metric != "cosine":
            return
        self.x = near = _unit(self.x)
        off = np.full(len(near), (near.shape[1] + 8) * 2.4e-7)   # single precision is off by less
        if self.decode is not None:
            codes = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8)
            near = self.decode(np.asarray(batch["cell"]), codes.reshape(batch.num_rows, -1))
            off += np.asarray(batch["off"])
        self.near = np.c_[near, off].astype(np.float32)

    def scores(self, qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Scores, for cosine upper bounds of them."""
        if self.metric == "cosine":
            return self.wide[qs] @ self.near[rows].T
        q, x = self.q[qs], self.x[rows]
        s = q @ x.T
        if self.metric == "l2":
            square = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * s
            s = -np.sqrt(np.maximum(square, 0.0))
        return s

    def slack(self, rows: np.ndarray) -> np.ndarray | None:
        """How much the scores of items may be too high; None where they are exact."""
        return 2.0 * self.near[rows, -1] if self.metric == "cosine" else None

    def exact(self, qs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines of pairs."""
        self.exact_pairs += len(qs)
        parts = [np.einsum("ij,ij->i", self.q[qs[a:a + PAIRS]], self.x[rows[a:a + PAIRS]])
                 for a in range(0, len(qs), PAIRS)]
        return np.concatenate(parts) if parts else np.zeros(0)


class Best:
    """Best `fetch` items per query seen so far, score descending then id ascending. What is
    below `floor` is known not to be wanted."""

    def __init__(self, fetch: np.ndarray, floor: np.ndarray | None = None):
        self.fetch = fetch
        self.floor = np.full(len(fetch), -np.inf) if floor is None else floor
        self.limit = max(200_000, 2 * int(fetch.sum()))
        self.parts, self.held = [], 0
        # best scores of the queries that want no more than a few times the mean
        self.width = min(int(fetch.max(initial=1)), 1 + 4 * int(fetch.mean())) if len(fetch) else 1
        self.top = np.full((len(fetch), self.width), -np.inf)

    def add(self, qs, rows, scorer, chunk_ids, doc_ids) -> None:
        # only what reaches the floor is scored exactly; rows with much above it are cut to their k
        scores, slack = scorer.scores(qs, rows), scorer.slack(rows)
        n, k = len(rows), int(self.fetch[qs].max())
        floor = self.floor[qs]
        least = (floor - 10.0 ** -DIGITS).astype(scores.dtype)
        at = np.flatnonzero(scores >= least[:, None])
        i = at // n
        full = np.flatnonzero(np.bincount(i, minlength=len(qs)) > 4 * k)
        if len(full):
            low = scores[full] if slack is None else scores[full] - slack
            kth = np.round(np.partition(low, n - k, axis=1)[:, n - k].astype(np.float64), DIGITS)
            floor[full] = np.maximum(floor[full], kth)
            self.floor[qs[full]] = floor[full]       # k of this batch reach it, and k >= fetch
            least = (floor - 10.0 ** -DIGITS).astype(scores.dtype)
            at = at[scores.ravel()[at] >= least[i]]
            i = at // n
        j = at - i * n
        s = scores.ravel()[at] if slack is None else scorer.exact(qs[i], rows[j])
        s = np.round(s, DIGITS) + 0.0
        fine = (s >= floor[i]) & (s > -np.inf)
        i, j, s = i[fine], j[fine], s[fine]
        fine = s >= self._raised(qs, i, s)[i]
        i, j, s = i[fine], j[fine], s[fine]
        if not len(i):
            return
        self.parts.append((qs[i], s, chunk_ids[rows[j]], doc_ids[rows[j]]))
        self.held += len(i)
        if self.held > self.limit:
            self.prune()

    def _raised(self, qs, i, s) -> np.ndarray:
        """Floors of `qs` after scores `s` of their places `i` (ascending) have come."""
        of, start, many = np.unique(i, return_index=True, return_counts=True)
        step = max(1, CELLS // (self.width + int(many.max(initial=0))))
        for a in range(0, len(of), step):
            q, n = qs[of[a:a + step]], many[a:a + step]
            new = np.full((len(q), n.max()), -np.inf)
            new[np.repeat(np.arange(len(q)), n),
                np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)] = s[start[a]:start[a] + n.sum()]
            best = np.sort(np.concatenate([self.top[q], new], axis=1), axis=1)[:, -self.width:]
            self.top[q] = best
            known = self.fetch[q] <= self.width
            kth = best[known, self.width - self.fetch[q[known]]]
            self.floor[q[known]] = np.maximum(self.floor[q[known]], kth)
        return self.floor[qs]

    def prune(self) -> None:
        if not self.parts:
            return
        q, s, c, d = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((-s, q))
        same = (q[order][1:] == q[order][:-1]) & (s[order][1:] == s[order][:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):
            t = order[tied]
            order[tied] = t[np.lexsort((c[t].astype(str), -s[t], q[t]))]
        q, s, c, d = q[order], s[order], c[order], d[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.fetch[q]
        last = place == self.fetch[q] - 1
        self.floor[q[last]] = s[last]
        self.parts = [(q[keep], s[keep], c[keep], d[keep])]
        self.held = int(keep.sum())

    def table(self, query_ids: pa.Array) -> pa.RecordBatch:
        self.prune()
        if not self.parts:
            return pa.RecordBatch.from_pylist([], schema=OUT_SCHEMA)
        q, s, c, d = self.parts[0]
        return pa.record_batch(
            [query_ids.take(pa.array(q)), pa.array(self.fetch[q].astype(np.int32)),
             pa.array(c.tolist(), pa.string()), pa.array(d.tolist(), pa.string()),
             pa.array(s)], schema=OUT_SCHEMA)


class Block:
    """One block of queries and their scopes, or the cells (`cells`) that each looks into."""

    def __init__(self, queries: pa.Table, scorer):
        self.ids = queries["query_id"].combine_chunks()
        self.scorer = scorer
        floor = None
        if "floor" in queries.column_names:
            floor = np.nan_to_num(queries["floor"].to_numpy().astype(np.float64), nan=-np.inf)
        self.best = Best(np.asarray(queries["fetch_k"], dtype=np.int64), floor)
        self.of_cell = None
        if "cells" in queries.column_names:
            cells = queries["cells"].combine_chunks()
            of = np.repeat(np.arange(len(cells)), np.asarray(pc.list_value_length(cells)))
            cells = np.asarray(cells.flatten())
            of, cells = of[order := np.argsort(cells, kind="stable")], cells[order]
            names, starts = np.unique(cells, return_index=True)
            self.of_cell = dict(zip(names.tolist(), np.split(of, starts[1:]), strict=True)) if len(of) else {}
        scope = queries["scope_id"].combine_chunks() if "scope_id" in queries.column_names \
            else pa.nulls(len(self.ids), pa.string())
        self.scopes = pc.unique(scope.drop_null())
        code = pc.index_in(scope, value_set=self.scopes) if len(self.scopes) else None
        code = np.full(len(self.ids), -1) if code is None else np.asarray(pc.fill_null(code, -1))
        self.free = np.flatnonzero(code < 0)
        self.of_scope = {c: np.flatnonzero(code == c) for c in range(len(self.scopes))}

    def add(self, batch) -> None:
        n = batch.num_rows
        if n == 0 or len(self.ids) == 0:
            return
        self.scorer.load(batch)
        chunk_ids, doc_ids = [batch[c].to_numpy(zero_copy_only=False) for c in ("chunk_id", "doc_id")]
        if self.of_cell is not None:
            cell = np.asarray(batch["cell"])
            for c in np.unique(cell).tolist():
                self._score(self.of_cell.get(c, []), np.flatnonzero(cell == c), chunk_ids, doc_ids)
            return
        self._score(self.free, np.arange(n), chunk_ids, doc_ids)
        if len(self.scopes):
            allowed = batch["scopes"]
            if isinstance(allowed, pa.ChunkedArray):
                allowed = allowed.combine_chunks()
            sizes = np.asarray(pc.fill_null(pc.list_value_length(allowed), 0))
            rows = np.repeat(np.arange(n), sizes)
            code = np.asarray(pc.fill_null(
                pc.index_in(allowed.flatten(), value_set=self.scopes), -1))
            order = np.argsort(code, kind="stable")
            code, rows = code[order], rows[order]
            for c in np.unique(code[code >= 0]):
                a, b = np.searchsorted(code, [c, c + 1])
                self._score(self.of_scope[c], rows[a:b], chunk_ids, doc_ids)

    def _score(self, qs, rows, chunk_ids, doc_ids) -> None:
        if not len(qs) or not len(rows):
            return
        step = max(1, CELLS // len(rows))
        for a in range(0, len(qs), step):
            part = qs[a:a + step]
            self.best.add(part, rows, self.scorer, chunk_ids, doc_ids)

    def result(self) -> pa.RecordBatch:
        return self.best.table(self.ids)


def make_block(queries: pa.Table, options: dict) -> Block:
    return Block(queries, DenseScorer(queries, **options))
