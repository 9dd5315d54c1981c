"""Text columns inside Arrow functions: rows are worked on in slices of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and offsets of each. A null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive rows of at most `limit` bytes together; a longer text comes alone."""
    _, at = utf8(texts)
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(texts))
        yield texts.slice(start, stop - start)
        start = stop


def by_slice(texts: pa.Array, work, kind: pa.DataType) -> pa.Array:
    """`work` on each slice; its results (Arrow arrays of type `kind`) put together."""
    done = [work(part) for part in slices(texts)]
    return pa.concat_arrays([d.cast(kind) for d in done]) if done else pa.array([], kind)


def char_positions(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte position (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
