"""Which documents each query may search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.config import EngineConfig
from corpusq.operators.registry import current_user
from corpusq.operators.skew import lookup_join
from corpusq.session import keep

@dataclass(frozen=True)
class Scopes:
    """`queries`: queries + scope_id (NULL = unrestricted). `docs`: (scope_id, doc_id).

    Queries with the same owner, collection and id list share a scope. Without id lists
    a document is then in one scope per owner and one per (owner, collection), so the
    table is as long as the registry plus its memberships plus the ids asked for -
    never queries times documents.
    """

    queries: DataFrame
    docs: DataFrame
    all_scoped: bool = False   # no query is unrestricted

    def kept(self) -> Scopes:
        """The same with `docs` computed once; every search reads it."""
        return replace(self, docs=keep(self.docs))


def name_scopes(queries: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Queries + scope parts and id. An empty id list or collection name counts as absent;
    under isolation a query without a user is the default user's."""
    ids = F.array_sort(F.array_distinct(F.col("doc_ids")))
    out = queries.withColumns({
        "_owner": current_user(F.col("user_id"), config.default_user) if config.isolated
        else F.lit(None).cast("string"),
        "_collection": F.nullif(F.col("collection"), F.lit("")),
        "_ids": F.when(F.size("doc_ids") > 0, ids),
    })
    parts = F.to_json(F.struct("_owner", "_collection", "_ids"), {"ignoreNullFields": "false"})
    free = F.col("_owner").isNull() & F.col("_collection").isNull() & F.col("_ids").isNull()
    return out.withColumn(
        "scope_id", F.when(~free, F.substring(F.sha2(parts.cast("binary"), 256), 1, 32)))


def resolve_scope(queries: DataFrame, registry: DataFrame, collections: DataFrame,
                  config: EngineConfig = EngineConfig()) -> Scopes:
    """Owner, collection and requested ids intersect; what is absent does not restrict.

    A scope that comes out empty allows nothing.
    """
    named = name_scopes(queries, config)
    scopes = (named.where(F.col("scope_id").isNotNull())
              .select("scope_id", "_owner", "_collection", "_ids")
              .dropDuplicates(["scope_id"]))
    # only what some question asks for takes part in the joins below
    owned = registry.select("doc_id", F.col("user_id").alias("_owner"))
    member = collections.select("doc_id", F.col("collection").alias("_collection")).join(
        scopes.select("_collection").distinct(), "_collection", "left_semi")
    if config.isolated:
        owned = owned.join(scopes.select("_owner").distinct(), "_owner", "left_semi")

    by_ids = scopes.where(F.col("_ids").isNotNull()).select(
        "scope_id", "_owner", "_collection", F.explode("_ids").alias("doc_id"))
    by_name = scopes.where(F.col("_ids").isNull() & F.col("_collection").isNotNull())
    if config.isolated:
        held = owned.withColumnRenamed("_owner", "_holder")
        by_ids = (lookup_join(by_ids, held, ["doc_id"], spread="scope_id", how="inner")
                  .where(F.col("_holder") == F.col("_owner")))
        owned_member = member.join(owned, "doc_id")
        named_docs = lookup_join(owned_member, by_name.select("scope_id", "_owner", "_collection"),
                                 ["_owner", "_collection"], spread="doc_id", how="inner")
        by_owner = scopes.where(F.col("_ids").isNull() & F.col("_collection").isNull())
        owner_docs = lookup_join(owned, by_owner.select("scope_id", "_owner"), ["_owner"],
                                 spread="doc_id", how="inner").select("scope_id", "doc_id")
    else:
        named_docs = lookup_join(member, by_name.select("scope_id", "_collection"),
                                 ["_collection"], spread="doc_id", how="inner")
        owner_docs = None
    any_name = by_ids.where(F.col("_collection").isNull())
    in_name = lookup_join(by_ids.where(F.col("_collection").isNotNull()), member,
                          ["doc_id", "_collection"], spread="scope_id", how="left_semi")
    docs = (any_name.select("scope_id", "doc_id")
            .union(in_name.select("scope_id", "doc_id"))
            .union(named_docs.select("scope_id", "doc_id")))
    if owner_docs is not None:
        docs = docs.union(owner_docs)
    return Scopes(named.drop("_owner", "_collection", "_ids"), docs, config.isolated)


def scope_sizes(scopes: Scopes) -> DataFrame:
    """Documents each query may see; -1 for an unrestricted query."""
    sizes = scopes.docs.groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
    found = lookup_join(scopes.queries.select("query_id", "scope_id"), sizes,
                        ["scope_id"], spread="query_id")
    return found.select("query_id", F.when(F.col("scope_id").isNull(), F.lit(-1)).otherwise(
        F.coalesce("n", F.lit(0))).cast("bigint").alias("visible_documents"))
