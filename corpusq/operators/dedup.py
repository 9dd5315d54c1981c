"""Exact duplicates: by owner and content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.operators.skew import lookup_join


def _relevant(registry: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Registry rows that share a key with the batch; of a large registry only they are
    grouped. A short list of keys is broadcast by its size."""
    return registry.where(F.col("file_hash").isNotNull()).join(
        incoming.select(*keys).distinct(), keys, "left_semi")


def dedup_decisions(incoming: DataFrame, registry: DataFrame, isolated: bool = True,
                    hot_rows: int | None = None) -> DataFrame:
    """Incoming (doc_id, filename, user_id, file_hash, uploaded_at) + error_code 409 and
    existing_filename for copies.

    A copy is content the same owner (any owner without isolation) already stored, or
    that came earlier in this batch (uploaded_at, then doc_id). The first holder of each
    hash is a map-side combined minimum, never a sorted group; the look-up back is
    salted because one hash may be very frequent. Only narrow columns travel.
    """
    keys = ["user_id", "file_hash"] if isolated else ["file_hash"]
    own = [c for c in ("upload_id",) if c in incoming.columns]
    narrow = incoming.select(*own, "doc_id", "filename", "user_id", "file_hash", "uploaded_at")
    holder = ["uploaded_at", "doc_id", "filename"]
    known = _relevant(registry, narrow, keys)
    holders = (
        known.select(*keys, F.lit(0).alias("batch"), *holder)
        .unionByName(narrow.select(*keys, F.lit(1).alias("batch"), *holder))
        .groupBy(*keys)
        .agg(F.min(F.struct("batch", *holder)).alias("first_holder"),
             F.sum("batch").alias("n")))
    found = lookup_join(narrow, holders.drop("n"), keys, spread="doc_id", how="left",
                        hot_rows=hot_rows, counts=holders.select(*keys, "n"))
    is_copy = (F.col("first_holder.batch") == 0) | (F.col("first_holder.doc_id") != F.col("doc_id"))
    return found.select(
        *narrow.columns,
        F.when(is_copy, F.lit(fv.DUPLICATE)).alias("error_code"),
        F.when(is_copy, F.col("first_holder.filename")).alias("existing_filename"))


def first_copies(docs: DataFrame, isolated: bool = True) -> DataFrame:
    """The copy of each (owner, hash) that wins inside one batch."""
    keys = ["user_id", "file_hash"] if isolated else ["file_hash"]
    return (docs.groupBy(*keys)
            .agg(F.min(F.struct("uploaded_at", "doc_id", "filename")).alias("_first"),
                 F.count(F.lit(1)).alias("copies"))
            .select(*keys, "_first.doc_id", "_first.filename", "copies"))


def duplicate_probe(requests: DataFrame, registry: DataFrame, isolated: bool = True,
                    hot_rows: int | None = None) -> DataFrame:
    """Requests whose content is already registered, with the name it is stored under."""
    keys = ["user_id", "file_hash"] if isolated else ["file_hash"]
    holders = (_relevant(registry, requests, keys).groupBy(*keys)
               .agg(F.min(F.struct("uploaded_at", "doc_id", "filename")).alias("_h"))
               .select(*keys, F.col("_h.filename").alias("existing_filename")))
    return lookup_join(requests, holders, keys, spread="doc_id", how="inner",
                       hot_rows=hot_rows).withColumn("error_code", F.lit(fv.DUPLICATE))
