"""Word shingles of texts as 64-bit hashes, computed on byte arrays.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A text with fewer words than the
shingle width has its whole word sequence as its only shingle, a text without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq.llm.arrow_text import slices, utf8

WIDTH = 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def constants(name: int, n: int) -> np.ndarray:
    """`n` fixed odd 64-bit numbers."""
    seed = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(mix(seed) + np.uint64(name)) | np.uint64(1)


BYTE_VALUES = constants(1, 256)
PLACES = constants(2, 64)
BASE = constants(3, 1)[0]
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of the text it stands in."""
    return word_spans(data, at)[:2]


def word_spans(data: np.ndarray, at: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, the number of its text, and its first byte and end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    edge = np.zeros(n + 1, bool)              # text borders part words
    edge[at] = True
    inside = ~BLANK[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[data]] * powers(BASE, n), out=total[1:])
    value = (total[ends] - total[starts]) * powers(BASE_INVERSE, n)[starts]
    return mix(value), np.searchsorted(at, starts, "right") - 1, starts, ends


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, ascending, one text after the other; and offsets."""
    data, at = utf8(texts)
    word, row = words(data, at)
    many = len(word) - width + 1
    value, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if many > 0:
        value = np.zeros(many, np.uint64)
        for k in range(width):
            value += word[k:k + many] * PLACES[k]
        whole = row[:many] == row[width - 1:]
        value, owner = mix(value[whole]), row[:many][whole]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width))
    if len(short):
        sums = np.zeros(len(short), np.uint64)
        size = np.diff(first)[short]
        for k in range(width - 1):
            has = size > k
            sums[has] += word[first[short[has]] + k] * PLACES[k]
        sums = mix(sums + size.astype(np.uint64) * PLACES[-1])
        value, owner = np.concatenate([value, sums]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def shingle_set(text: Column, width: int = WIDTH) -> Column:
    """array<bigint> of distinct shingle hashes, ascending as unsigned numbers; [] for a null
    text or one without words."""
    @F.arrow_udf("array<bigint>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            done = []
            for part in slices(texts):
                value, at = shingle_sets(part, width)
                done.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()),
                                                     pa.array(value.view(np.int64))))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int64()))
    return sets(text)
