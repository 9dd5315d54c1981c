"""Tables in and out: versions, the search index, the legacy JSON registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.text import capitalize_name
from corpusq.schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet",
               **options: str) -> DataFrame:
    """One of the five tables with its declared schema. Any Spark source will do; a JDBC
    source is given by fmt='jdbc' and its options (path is then ignored)."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "jdbc":
        return reader.load().select(*TABLES[name].names)
    return reader.schema(TABLES[name]).load(path)


def write_table(df: DataFrame, name: str, path: str, fmt: str = "parquet",
                mode: str = "overwrite", **options: str) -> None:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name]]
    writer = df.select(*columns).write.format(fmt).mode(mode).options(**options)
    writer.save() if fmt == "jdbc" else writer.save(path)


# --- versions ------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def save_version(tables: dict[str, DataFrame], root: str, version: int) -> str:
    """Write all tables into a new version folder; a marker file makes it current.

    Readers see either the old version or the whole new one.
    """
    folder = f"{root}/version={version:08d}"
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    fs, jvm = _fs(spark, folder)
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/_COMMITTED"), True).close()
    return folder


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, jvm = _fs(spark, root)
    base = jvm.org.apache.hadoop.fs.Path(root)
    if not fs.exists(base):
        return None
    done = [s.getPath().toString() for s in fs.listStatus(base)
            if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath().toString() + "/_COMMITTED"))]
    return max(done, default=None)


def load_version(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    folder = current_version(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no committed version under {root}")
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


# --- search index ----------------------------------------------------------------------

def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def save_index(tables: dict[str, DataFrame], path: str, buckets: int = 64,
               files_per_bucket: int = 4) -> None:
    """Persist index tables by bucket of doc_id (of `term` for posting tables).

    A bucket is spread over several files by the other key, so one dominant document or
    term does not end up in one writer.
    """
    for name, df in tables.items():
        key = "doc_id" if "doc_id" in df.columns else "term"
        other = "chunk_id" if "chunk_id" in df.columns else key
        placed = df.withColumn("bucket", bucket_of(F.col(key), buckets))
        deal = F.pmod(F.xxhash64(other), F.lit(files_per_bucket))
        (placed.repartition("bucket", deal).write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{path}/{name}"))


def load_index(spark: SparkSession, path: str, name: str,
               keys: list[str] | None = None, buckets: int = 64) -> DataFrame:
    """Reopen an index table; with `keys` only their buckets are read."""
    df = spark.read.parquet(f"{path}/{name}")
    if keys is not None:
        key = "doc_id" if "doc_id" in df.columns else "term"
        wanted = F.array_distinct(F.transform(
            F.array(*[F.lit(k) for k in keys]), lambda k: bucket_of(k, buckets)))
        numbers = spark.range(1).select(wanted.alias("b")).first()["b"]
        df = df.where(F.col("bucket").isin(numbers) & F.col(key).isin(keys))
    return df.drop("bucket")


def save_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """A table of the warehouse, hashed and sorted by `keys` when written: joins and groups on
    them then take it where it lies. Returns it as read back."""
    (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


# --- legacy registry -----------------------------------------------------------------------

_LEGACY_USERS = "users map<string, struct<display_name: string>>"
_LEGACY_DOCUMENTS = (
    "documents map<string, struct<filename: string, file_type: string, chunk_count: int, "
    "collection: string, collections: array<string>, user_id: string, file_hash: string>>")


def import_legacy_registry(spark: SparkSession, users_json: str | None,
                           documents_json: str | None, users: DataFrame,
                           registry: DataFrame, collections: DataFrame,
                           imported_at: Column) -> dict[str, DataFrame]:
    """Merge JSON registries (`{"users": {id: ...}}`, `{"documents": {id: ...}}`) into the
    tables. Ids already present stay as they are; absent owners are created."""
    at = imported_at.cast("timestamp")
    if users_json:
        listed = (spark.read.schema(_LEGACY_USERS).json(users_json, multiLine=True)
                  .select(F.explode("users").alias("user_id", "u"))
                  .select("user_id", F.coalesce("u.display_name", capitalize_name(
                      F.col("user_id"))).alias("display_name")))
    else:
        listed = spark.range(1).select(
            F.lit(fv.DEFAULT_USER).alias("user_id"),
            capitalize_name(F.lit(fv.DEFAULT_USER)).alias("display_name"))
    out_users = listed
    out_registry, out_collections = registry, collections
    if documents_json:
        docs = (spark.read.schema(_LEGACY_DOCUMENTS).json(documents_json, multiLine=True)
                .select(F.explode("documents").alias("doc_id", "d")).select("doc_id", "d.*"))
        fresh = docs.join(registry.select("doc_id"), "doc_id", "left_anti").select(
            "doc_id",
            F.coalesce("filename", F.lit("unknown")).alias("filename"),
            F.coalesce("file_type", F.lit(".pdf")).alias("file_type"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
            F.coalesce("user_id", F.lit(fv.DEFAULT_USER)).alias("user_id"),
            "file_hash", at.alias("uploaded_at"),
            F.coalesce(
                F.when(F.size("collections") > 0, F.col("collections")),
                F.when(F.length("collection") > 0, F.array("collection")),
                F.array(F.lit(fv.DEFAULT_COLLECTION))).alias("names"))
        out_registry = registry.unionByName(fresh.select(*registry.columns))
        out_collections = collections.unionByName(fresh.select(
            "doc_id", F.explode(F.array_distinct("names")).alias("collection")))
        owners = (fresh.select("user_id").distinct()
                  .join(listed.select("user_id"), "user_id", "left_anti")
                  .select("user_id", capitalize_name(F.col("user_id")).alias("display_name")))
        out_users = listed.unionByName(owners)
    added = out_users.join(users.select("user_id"), "user_id", "left_anti").select(
        "user_id", "display_name", at.alias("created_at"))
    return {"users": users.unionByName(added), "registry": out_registry,
            "document_collections": out_collections}
