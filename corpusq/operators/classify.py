"""Documents -> collection labels from the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.taxonomy import suggest_labels, taxonomy_tokens
from corpusq.functions.text import collections_csv, parse_label_reply
from corpusq.operators import mutations
from corpusq.operators.registry import without_chunks
from corpusq.operators.skew import lookup_join


def classification_excerpt(chunks: DataFrame) -> DataFrame:
    """(doc_id, excerpt): the first three chunks joined and cut. The filter on the chunk
    number bounds each group before anything is grouped."""
    head = chunks.where(F.col("chunk_index") < fv.EXCERPT_CHUNKS)
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    text = F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n")
    return head.groupBy("doc_id").agg(F.substring(text, 1, fv.EXCERPT_CHARS).alias("excerpt"))


def classify_documents(chunks: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """(doc_id, labels). Word overlap with the taxonomy by default; a table of classifier
    replies (doc_id, reply) takes its place where given."""
    excerpts = classification_excerpt(chunks)
    scored = (excerpts.withColumn("_tokens", taxonomy_tokens(F.col("excerpt")))
              .select("doc_id", suggest_labels(F.col("_tokens")).alias("labels")))
    if replies is None:
        return scored
    parsed = replies.select("doc_id", parse_label_reply(F.col("reply")).alias("_reply"))
    return (scored.join(parsed, "doc_id", "left")
            .select("doc_id", F.coalesce("_reply", "labels").alias("labels")))


def reclassify(requests: DataFrame, registry: DataFrame, collections: DataFrame,
               chunks: DataFrame, replies: DataFrame | None = None, isolated: bool = True
               ) -> dict[str, DataFrame]:
    """Label requested documents again from their stored chunks.

    Unknown documents, foreign ones and those without chunks are returned as errors.
    """
    checked = mutations.check_targets(requests, registry, isolated)
    good = checked.where(F.col("error_code").isNull()).select("doc_id").distinct()
    labels = classify_documents(
        lookup_join(chunks, good, ["doc_id"], spread="chunk_id", how="left_semi"), replies)
    updates = labels.select("doc_id", F.col("labels").alias("collections"))
    csv = labels.select("doc_id", F.create_map(
        F.lit("collections_csv"), collections_csv(F.col("labels"))).alias("updates"))
    return {
        "labels": labels,
        "document_collections": mutations.replace_collections(collections, registry, updates),
        "chunks": mutations.merge_metadata(chunks, csv),
        "errors": checked.where(F.col("error_code").isNotNull()).select("doc_id", "error_code")
        .unionByName(without_chunks(good, chunks).select("doc_id", "error_code")),
    }
