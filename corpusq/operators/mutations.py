"""Table changes as functions from tables to new tables; the caller writes a version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.operators.registry import new_users
from corpusq.operators.skew import lookup_join


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Table + the rows whose key it does not hold yet."""
    fresh = rows.join(table.select(key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def create_users(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests to create users explicitly: 409 where the id is taken."""
    taken = users.select("user_id", F.lit(fv.DUPLICATE).alias("error_code"))
    return requests.join(taken, "user_id", "left")


def ensure_users(users: DataFrame, ids: DataFrame, created_at) -> DataFrame:
    """Users + those seen for the first time."""
    return users.unionByName(new_users(ids, users, created_at).select(*users.columns))


def _membership(rows: DataFrame) -> DataFrame:
    names = F.coalesce(F.when(F.size("collections") > 0, F.col("collections")),
                       F.array(F.lit(fv.DEFAULT_COLLECTION)))
    return rows.select("doc_id", F.explode(F.array_distinct(names)).alias("collection"))


def add_documents(registry: DataFrame, collections: DataFrame, rows: DataFrame
                  ) -> tuple[DataFrame, DataFrame]:
    """Append documents (with a `collections` list) and their memberships."""
    fresh = rows.join(registry.select("doc_id"), "doc_id", "left_anti")
    return (registry.unionByName(fresh.select(*registry.columns)),
            collections.unionByName(_membership(fresh)))


def add_chunks(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Append chunks; chunks already stored are left alone, so a retry adds nothing."""
    return insert_if_absent(chunks, rows, "chunk_id")


def check_targets(requests: DataFrame, registry: DataFrame, isolated: bool = True) -> DataFrame:
    """Requests (doc_id[, user_id]) + 404 for unknown ids, and, under isolation, for
    documents the requester does not own."""
    owners = registry.select("doc_id", F.col("user_id").alias("_owner"))
    found = requests.join(owners, "doc_id", "left")
    bad = F.col("_owner").isNull()
    if isolated and "user_id" in requests.columns:
        bad = bad | (F.col("_owner") != F.col("user_id"))
    return found.withColumn("error_code", F.when(bad, F.lit(fv.NOT_FOUND))).drop("_owner")


def delete_documents(doc_ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """Remove documents from every given table that has a doc_id."""
    gone = doc_ids.select("doc_id").distinct()
    return [
        # one document may hold a large share of the chunks
        (lookup_join(t, gone, ["doc_id"], spread="chunk_id", how="left_anti")
         if "chunk_id" in t.columns else t.join(gone, "doc_id", "left_anti")).select(*t.columns)
        for t in tables]


def replace_collections(collections: DataFrame, registry: DataFrame, updates: DataFrame
                        ) -> DataFrame:
    """New membership lists (doc_id, collections) for documents that exist.

    One update per document is expected; empty lists are rejected upstream.
    """
    known = updates.join(registry.select("doc_id"), "doc_id", "left_semi")
    kept = collections.join(known.select("doc_id"), "doc_id", "left_anti")
    return kept.unionByName(_membership(known))


def merge_metadata(chunks: DataFrame, updates: DataFrame) -> DataFrame:
    """Merge (doc_id, updates MAP) into `extra` of all chunks of a document; new keys win."""
    merged = lookup_join(chunks, updates, ["doc_id"], spread="chunk_id")
    old = F.coalesce(F.col("extra"), F.create_map().cast("map<string,string>"))
    new = F.coalesce(F.col("updates"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return merged.withColumn("extra", F.map_concat(kept, new)).select(*chunks.columns)


def delete_users(gone: DataFrame, users: DataFrame, registry: DataFrame,
                 collections: DataFrame, chunks: DataFrame, sessions: DataFrame
                 ) -> dict[str, DataFrame]:
    """Remove users; their documents cascade, their sessions lose the owner."""
    ids = gone.select("user_id").distinct()
    doc_ids = lookup_join(registry.select("doc_id", "user_id"), ids, ["user_id"],
                          spread="doc_id", how="left_semi").select("doc_id")
    registry2, collections2, chunks2 = delete_documents(doc_ids, registry, collections, chunks)
    flagged = lookup_join(sessions, ids.withColumn("_gone", F.lit(True)), ["user_id"],
                          spread="session_id")
    return {
        "users": users.join(ids, "user_id", "left_anti"),
        "registry": registry2,
        "document_collections": collections2,
        "chunks": chunks2,
        "chat_sessions": flagged.withColumn(
            "user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))
        ).select(*sessions.columns),
    }
