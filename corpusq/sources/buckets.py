"""Tables that change a few rows at a time: copy on write by bucket of a key.

A table lies in folders, one for each bucket of its key, and is never written over. A version is
a short table that names the folder of every bucket. A change reads the buckets of the keys it
touches, writes these anew beside the old ones and adds a version that names the new folders
instead; what is not touched is neither read nor written. A reader keeps the version it began
with. A version is there once its marker is: a change that fails half way leaves unnamed
folders and the table as it was.

One writer at a time is expected, as with the registry of a single service: a version number
that exists already is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusq.operators import mutations
from corpusq.sources.tables import _fs, bucket_of

BUCKETS = 256           # also the bound of a version's rows
FILES_PER_BUCKET = 4    # a bucket's rows are spread over several files by their other key


@dataclass(frozen=True)
class BucketTable:
    """One version of a table, pinned. `folders` maps buckets that hold rows to their folder."""

    spark: SparkSession
    root: str
    schema: T.StructType
    key: str
    buckets: int
    version: int
    folders: dict[int, str]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = sorted(self.folders if buckets is None else set(buckets) & set(self.folders))
        paths = [self.folders[b] for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def buckets_of(self, keys: DataFrame) -> list[int]:
        """Buckets that rows with these keys lie in: at most as many as the table has."""
        found = keys.select(bucket_of(F.col(self.key), self.buckets).alias("b")).where(
            "b is not null").distinct()
        return sorted(r["b"] for r in found.collect())

    def change(self, keys: DataFrame, by: Callable[[DataFrame], DataFrame]) -> BucketTable:
        """The next version: `by` makes new rows from the rows of the buckets of `keys`, and may
        touch none but these keys' rows. Nothing is written where there are no keys."""
        touched = self.buckets_of(keys)
        if not touched:
            return self
        return _write(self, by(self.rows(touched)).select(*self.schema.names), touched)

    def upsert(self, fresh: DataFrame) -> BucketTable:
        """Rows of the given keys are replaced by the given rows."""
        keys = fresh.select(self.key).distinct()
        return self.change(fresh, lambda held: held.join(keys, self.key, "left_anti").select(
            *self.schema.names).unionByName(fresh.select(*self.schema.names)))

    def insert_if_absent(self, fresh: DataFrame, key: str | None = None) -> BucketTable:
        """Rows whose `key` (by default the table's) is not there yet are added."""
        return self.change(fresh, lambda held: mutations.insert_if_absent(
            held, fresh, key or self.key))

    def delete(self, keys: DataFrame) -> BucketTable:
        """Rows of the given keys go."""
        return self.change(keys, lambda held: mutations.delete_documents(keys, held)[0]
                           if self.key == "doc_id" else
                           held.join(keys.select(self.key).distinct(), self.key, "left_anti"))


def create(df: DataFrame, root: str, key: str = "doc_id", buckets: int = BUCKETS) -> BucketTable:
    """Write a table's first version. A row without key cannot be found again and is an error."""
    empty = BucketTable(df.sparkSession, root, df.schema, key, buckets, -1, {})
    return _write(empty, df, list(range(buckets)))


def load(spark: SparkSession, root: str, version: int | None = None) -> BucketTable:
    """The newest version, or a given one."""
    fs, jvm = _fs(spark, root)
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    known = {}
    if fs.exists(base):
        for s in fs.listStatus(base):
            path = s.getPath().toString()
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
                known[int(path.rsplit("-", 1)[1])] = path
    chosen = max(known, default=None) if version is None else version
    if chosen not in known:
        raise FileNotFoundError(f"no version {'' if version is None else version} under {root}")
    rows = spark.read.parquet(known[chosen]).collect()          # one for each bucket, and one
    head = next(r for r in rows if r["bucket"] == -1)
    key, buckets, schema = head["folder"].split("\n", 2)
    return BucketTable(spark, root, T.StructType.fromJson(json.loads(schema)), key,
                       int(buckets), chosen,
                       {r["bucket"]: r["folder"] for r in rows if r["bucket"] >= 0})


def _write(old: BucketTable, rows: DataFrame, touched: list[int]) -> BucketTable:
    place = bucket_of(F.col(old.key), old.buckets)
    placed = rows.withColumn("_bucket", F.when(F.col(old.key).isNotNull(), place).otherwise(
        F.raise_error(F.lit(f"a row without {old.key}"))))
    others = [c for c in rows.columns if c != old.key and not isinstance(
        rows.schema[c].dataType, T.MapType)]
    deal = F.pmod(F.xxhash64(*others), F.lit(FILES_PER_BUCKET)) if others else F.lit(0)
    folder = f"{old.root}/data/{uuid.uuid4().hex}"
    placed.repartition("_bucket", deal).write.partitionBy("_bucket").parquet(folder)
    fs, jvm = _fs(old.spark, folder)
    written = [s.getPath().toString() for s in fs.listStatus(
        jvm.org.apache.hadoop.fs.Path(folder)) if s.isDirectory()]
    fresh = {int(p.rsplit("=", 1)[1]): p for p in written}
    strange = set(fresh) - set(touched)
    if strange:
        raise ValueError(f"the change moved rows into buckets it does not touch: {sorted(strange)}")
    gone = set(touched)
    folders = {b: p for b, p in old.folders.items() if b not in gone} | fresh
    version = old.version + 1
    head = (-1, f"{old.key}\n{old.buckets}\n{old.schema.json()}")
    old.spark.createDataFrame([head, *sorted(folders.items())], "bucket int, folder string"
                              ).coalesce(1).write.mode("error").parquet(
        f"{old.root}/versions/v-{version:08d}")
    return BucketTable(old.spark, old.root, old.schema, old.key, old.buckets, version, folders)


def replace_collections(collections: BucketTable, registry: DataFrame, updates: DataFrame
                        ) -> BucketTable:
    """New membership lists (doc_id, collections) for documents that exist."""
    return collections.change(updates, lambda held: mutations.replace_collections(
        held, registry, updates))


def merge_metadata(chunks: BucketTable, updates: DataFrame) -> BucketTable:
    """Merge (doc_id, updates MAP) into `extra` of the chunks of a document."""
    return chunks.change(updates, lambda held: mutations.merge_metadata(held, updates))


def drop_old_folders(table: BucketTable, keep_versions: int = 2) -> int:
    """Delete the folders that none of the newest versions names; returns how many went.
    Readers of older versions must be done."""
    fs, jvm = _fs(table.spark, table.root)
    path = jvm.org.apache.hadoop.fs.Path
    newest = range(max(0, table.version - keep_versions + 1), table.version + 1)
    named = {f for v in newest for f in load(table.spark, table.root, v).folders.values()}
    gone = 0
    for write in fs.listStatus(path(f"{table.root}/data")):
        for s in fs.listStatus(write.getPath()):
            if s.isDirectory() and s.getPath().toString() not in named:
                gone += fs.delete(s.getPath(), True)
    for v in range(newest[0]):
        fs.delete(path(f"{table.root}/versions/v-{v:08d}"), True)
    return gone
