"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, on: list[str], hot_rows: int,
             counts: DataFrame | None = None) -> DataFrame:
    """Keys with at least `hot_rows` rows and the number of salts each gets.

    The count is combined map-side, so a hot key costs one row per task here. `counts`
    (keys, n) is used when the caller has it already.
    """
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= hot_rows).select(
        *on, F.ceil(F.col("n") / F.lit(hot_rows)).cast("int").alias("_salts"))


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], spread: str,
                how: str = "left", hot_rows: int | None = None,
                counts: DataFrame | None = None) -> DataFrame:
    """Join many rows to a table with few rows per key.

    By default this is a plain join: AQE broadcasts a short look-up and splits the rows of a
    key that fill a partition. With `hot_rows` the rows of a key with that many are dealt
    over salts by a hash of `spread`, which a repeated task computes again, and the look-up
    rows of that key are copied once per salt; every other key has the single salt 0. Rows
    with a NULL key cannot match, so they are dealt out as well. That form is for callers
    that group by the key afterwards, where a split by AQE would cost another shuffle.
    """
    if hot_rows is None:
        return rows.join(lookup, on, how)
    hot = hot_keys(rows, on, hot_rows, counts)
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    deal = F.xxhash64(F.col(spread))
    salted = rows.join(hot, on, "left").withColumn(
        "_salt",
        F.when(no_key, -1 - F.pmod(deal, F.lit(1024)))
        .when(F.col("_salts").isNotNull(), F.pmod(deal, F.col("_salts").cast("bigint")))
        .otherwise(F.lit(0)).cast("int")).drop("_salts")
    copied = lookup.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted.join(copied, [*on, "_salt"], how).drop("_salt")
