"""Registry reads: lists, look-ups, counts, consistency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.taxonomy import PRIMARIES
from corpusq.functions.text import capitalize_name, iso_timestamp
from corpusq.operators.skew import lookup_join


def owner_filter(df: DataFrame, user_id: str | None, isolated: bool = True) -> DataFrame:
    """Rows of one owner when isolation is on; all rows otherwise."""
    if not isolated or user_id is None:
        return df
    return df.where(F.col("user_id") == user_id)


def collection_lists(collections: DataFrame) -> DataFrame:
    """One sorted list of collections per document."""
    return collections.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("collection")).alias("collections"))


def list_documents(registry: DataFrame, collections: DataFrame,
                   user_id: str | None = None, isolated: bool = True) -> DataFrame:
    """Documents with their collections; a document without any gets an empty list."""
    docs = owner_filter(registry, user_id, isolated)
    return (docs.join(collection_lists(collections), "doc_id", "left")
            .withColumn("collections", F.coalesce(
                "collections", F.array().cast("array<string>")))
            .withColumn("uploaded_at", iso_timestamp(F.col("uploaded_at"))))


def list_by_collection(registry: DataFrame, collections: DataFrame, collection: str,
                       user_id: str | None = None, isolated: bool = True) -> DataFrame:
    """Documents of one collection, each once, with their full list."""
    members = collections.where(F.col("collection") == collection).select("doc_id")
    docs = registry.join(members, "doc_id", "left_semi")
    mine = collections.join(members, "doc_id", "left_semi")
    return list_documents(docs, mine, user_id, isolated)


def collections_of_users(registry: DataFrame, collections: DataFrame) -> DataFrame:
    """Distinct (user_id, collection), for all owners in one job."""
    return (registry.select("doc_id", "user_id").join(collections, "doc_id")
            .select("user_id", "collection").distinct())


def list_collections(registry: DataFrame, collections: DataFrame,
                     user_id: str | None = None, isolated: bool = True) -> DataFrame:
    """Distinct collection names by code point, of one owner or of all."""
    if user_id is None or not isolated:
        names = collections.select("collection")
    else:
        docs = owner_filter(registry, user_id).select("doc_id")
        names = collections.join(docs, "doc_id", "left_semi").select("collection")
    return names.distinct().orderBy("collection")


def known_collections(collections: DataFrame, with_taxonomy: bool = False) -> DataFrame:
    """Existing collection names, optionally with the primary categories."""
    names = collections.select("collection").distinct()
    if with_taxonomy:
        spark = collections.sparkSession
        primaries = spark.createDataFrame([(p,) for p in PRIMARIES], "collection string")
        names = names.union(primaries).distinct()
    return names.orderBy("collection")


def documents_by_id(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested ids with their document, error 404 for unknown ones.

    One id may be asked for very often, hence the salted look-up.
    """
    found = registry.withColumn("_found", F.lit(True))
    return (lookup_join(requests, found, ["doc_id"], spread=requests.columns[0])
            .withColumn("error_code", F.when(F.col("_found").isNull(), F.lit(fv.NOT_FOUND)))
            .drop("_found"))


def without_chunks(doc_ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """404 for documents that have no stored chunk."""
    return (doc_ids.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti")
            .withColumn("error_code", F.lit(fv.NOT_FOUND)))


# --- counts -----------------------------------------------------------------------

def document_count(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count(F.lit(1)).alias("document_count"))


def user_exists(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requested user ids with the outcome of the existence test."""
    known = users.select("user_id", F.lit(True).alias("_known"))
    return (requests.select("user_id").distinct().join(known, "user_id", "left")
            .select("user_id", F.coalesce("_known", F.lit(False)).alias("user_exists")))


def chunk_counts(registry: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per registered document, 0 for none."""
    counts = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    return (registry.select("doc_id").join(counts, "doc_id", "left")
            .select("doc_id", F.coalesce("chunk_count", F.lit(0)).cast("bigint")
                    .alias("chunk_count")))


def collection_facets(collections: DataFrame) -> DataFrame:
    """Documents per collection. (doc_id, collection) is the key of the table, so
    removing repeats first keeps this a counting job for a dominant collection."""
    return (collections.select("doc_id", "collection").distinct()
            .groupBy("collection").agg(F.count(F.lit(1)).alias("documents")))


def store_inventory(chunks: DataFrame) -> DataFrame:
    per_doc = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
                       F.count(F.lit(1)).alias("documents"))


# --- users ------------------------------------------------------------------------

def list_users(users: DataFrame) -> DataFrame:
    return users.select("user_id", "display_name",
                        iso_timestamp(F.col("created_at")).alias("created_at"))


def current_user(header: Column, default: str = fv.DEFAULT_USER) -> Column:
    """The user named in a request; the default for none or an empty name."""
    return F.coalesce(F.nullif(header, F.lit("")), F.lit(default))


def new_users(ids: DataFrame, users: DataFrame, created_at: Column) -> DataFrame:
    """Users to create on first sight, display name derived from the id."""
    return (ids.select("user_id").where(F.col("user_id").isNotNull()).distinct()
            .join(users.select("user_id"), "user_id", "left_anti")
            .select("user_id", capitalize_name(F.col("user_id")).alias("display_name"),
                    created_at.cast("timestamp").alias("created_at")))


# --- consistency ------------------------------------------------------------------

def orphans(child: DataFrame, parent: DataFrame, key: str, relation: str) -> DataFrame:
    """Child keys without a parent row, with the number of rows concerned.

    Keys are counted before the anti join, so a dominant key is one row there.
    """
    return (child.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("rows"))
            .join(parent.select(key), key, "left_anti")
            .select(F.lit(relation).alias("relation"),
                    F.col(key).cast("string").alias("orphan_key"), "rows"))


def orphan_check(users: DataFrame, registry: DataFrame, collections: DataFrame,
                 sessions: DataFrame | None = None,
                 messages: DataFrame | None = None) -> DataFrame:
    """Every foreign-key violation between the five tables."""
    out = orphans(registry, users, "user_id", "registry.user_id").unionByName(
        orphans(collections, registry, "doc_id", "document_collections.doc_id"))
    if sessions is not None:
        out = out.unionByName(orphans(sessions, users, "user_id", "chat_sessions.user_id"))
        if messages is not None:
            out = out.unionByName(
                orphans(messages, sessions, "session_id", "chat_messages.session_id"))
    return out
