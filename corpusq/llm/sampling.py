"""Bounded samples of rows, chosen by a hash of their id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_texts(docs: DataFrame, id_col: str, text_col: str, rows: int,
                 chars: int) -> list[str]:
    """At most `rows` texts, at most `chars` characters of each, for fitting a model.

    The ids are chosen first, from the id column alone; only their texts are read.
    """
    named = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    ids = [r[0] for r in named.select(F.col(id_col)).orderBy(
        F.xxhash64(F.col(id_col)), F.col(id_col)).limit(rows).collect()]
    if not ids:
        return []
    found = named.where(F.col(id_col).isin(ids)).groupBy(F.col(id_col)).agg(
        F.min(F.substring(F.col(text_col), 1, chars)))
    return [r[1] for r in sorted(map(tuple, found.collect()))]
