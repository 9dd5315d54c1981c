"""Text -> overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq import fixed_values as fv


def _pieces(text: str, start: int, end: int, mark: str) -> list[tuple[int, int]]:
    """Spans between occurrences of `mark`; a mark opens the span that follows it."""
    if mark == "":
        return [(i, i + 1) for i in range(start, end)]
    cuts, at = [start], text.find(mark, start, end)
    while at != -1:
        if at > start:
            cuts.append(at)
        at = text.find(mark, at + len(mark), end)
    cuts.append(end)
    return list(zip(cuts, cuts[1:]))


def _pack(spans: list[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Join neighbouring spans up to `size`, re-using at most `overlap` of the tail."""
    first = 0
    for i, (_, end) in enumerate(spans):
        if end - spans[first][0] <= size:
            continue
        # span i no longer fits: close the window, then slide its start
        closed = spans[i - 1][1]
        if i > first:
            yield spans[first][0], closed
        while first < i and (closed - spans[first][0] > overlap
                             or end - spans[first][0] > size):
            first += 1
    if spans:
        yield spans[first][0], spans[-1][1]


def _windows(start: int, end: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """What _pack makes of single characters."""
    while end - start > size:
        yield start, start + size
        start += size - overlap
    yield start, end


def split_spans(text: str, size: int, overlap: int,
                marks: list[str] = fv.CHUNK_SEPARATORS) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text, white space at their edges removed.

    The coarsest mark that occurs splits the text; pieces below `size` are packed
    together, longer ones are split by the finer marks.
    """
    out: list[tuple[int, int]] = []

    def cut(start: int, end: int, level: int) -> None:
        while marks[level] and text.find(marks[level], start, end) == -1:
            level += 1
        if not marks[level] and overlap < size > 1:
            out.extend(_windows(start, end, size, overlap))
            return
        run: list[tuple[int, int]] = []
        for a, b in _pieces(text, start, end, marks[level]):
            if b - a < size:
                run.append((a, b))
                continue
            out.extend(_pack(run, size, overlap))
            run = []
            if marks[level]:
                cut(a, b, level + 1)
            else:
                out.append((a, b))
        out.extend(_pack(run, size, overlap))

    if text:
        cut(0, len(text), 0)
    kept = []
    for a, b in out:
        body = text[a:b]
        lead = len(body) - len(body.lstrip())
        a, b = a + lead, a + len(body.rstrip())
        if a < b:
            kept.append((a, b))
    return kept


CHUNK_TYPE = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("content", T.StringType())]))


def chunk_recursive(text: Column, size: int = fv.CHUNK_SIZE,
                    overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Array of (start, content). Sequential inside one text, hence an Arrow function."""

    @F.pandas_udf(CHUNK_TYPE)
    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else
            [{"start": a, "content": t[a:b]} for a, b in split_spans(t, size, overlap)]
            for t in texts])

    return split(text)


def chunk_pages_recursive(pages: Column, size: int = fv.CHUNK_SIZE,
                          overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """The same for an array of page texts: an array of chunks for each page."""

    @F.pandas_udf(T.ArrayType(CHUNK_TYPE))
    def split(docs: pd.Series) -> pd.Series:
        return pd.Series([
            None if doc is None else
            [[] if t is None else
             [{"start": a, "content": t[a:b]} for a, b in split_spans(t, size, overlap)]
             for t in doc]
            for doc in docs])

    return split(pages)


def chunk_fixed(text: Column, size: int = fv.CHUNK_SIZE,
                overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """Array of (start, content) windows of `size` advancing by `size - overlap`."""
    last = F.greatest(F.length(text) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    windows = F.transform(starts, lambda i: F.struct(
        i.alias("start"), text.substr(i + 1, F.lit(size)).alias("content")))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast(CHUNK_TYPE))


def split_pages(text: Column, pattern: str = r"\n[ \t]*\n") -> Column:
    """Pages of a text column; a blank line ends a page by default."""
    return F.split(text, pattern)


def explode_pages(df: DataFrame, pages: str = "pages") -> DataFrame:
    """One row per page with its 0-based number; a document without pages keeps
    one row whose `page` is NULL."""
    rest = [c for c in df.columns if c != pages]
    return df.select(*rest, F.posexplode_outer(pages).alias("page", "content"))


def explode_chunks(df: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row per chunk of one-page documents; the index is the array position."""
    rest = [c for c in df.columns if c != chunks]
    return (df.select(*rest, F.posexplode(chunks).alias("chunk_index", "_c"))
            .select(*rest, "chunk_index", F.col("_c.content").alias("content")))


def number_across_pages(df: DataFrame, pages_of_chunks: str) -> DataFrame:
    """ARRAY (pages) of ARRAY (chunks) -> rows numbered over the whole document.

    A document's chunks sit in one row, so flattening numbers them without a shuffle.
    """
    rest = [c for c in df.columns if c != pages_of_chunks]
    tagged = F.flatten(F.transform(
        F.col(pages_of_chunks),
        lambda chunks, page: F.transform(chunks, lambda c: F.struct(
            page.alias("page"), c["content"].alias("content")))))
    return (df.select(*rest, F.posexplode(tagged).alias("chunk_index", "_c"))
            .select(*rest, "chunk_index", "_c.page", "_c.content"))
