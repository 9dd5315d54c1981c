"""Registration of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.checks.derived import Tables
from corpusq.session import apply_runtime_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT and fractions as DOUBLE, like the SQL side."""
    casts = {T.IntegerType: "bigint", T.ShortType: "bigint", T.FloatType: "double"}
    return df.select(*[
        F.col(f.name).cast(casts[type(f.dataType)]).alias(f.name)
        if type(f.dataType) in casts else F.col(f.name) for f in df.schema])


def check(name: str, oracle: str | None = None):
    """Register `fn(tables) -> DataFrame`, optionally with its SQL."""
    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            apply_runtime_conf(spark)
            return _plain(fn(Tables(spark, folder)))
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_rewrite(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(by)}, 'g')"
    return expr


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"
