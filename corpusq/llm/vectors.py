"""Vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, only finite components, not zero."""
    return (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    ) & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def vector_rows(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id bigint, vector array<double>) of the rows that take part."""
    return rows.select(F.col(id_col).cast("bigint").alias("vec_id"),
                       F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("vector")), F.lit(False)))
