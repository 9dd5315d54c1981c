"""Uploads -> registry, memberships, chunks and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusq.config import EngineConfig
from corpusq.functions import chunking, validate
from corpusq.functions.embed import embed_column
from corpusq.functions.taxonomy import suggest_labels, taxonomy_tokens
from corpusq.functions.text import (chunk_id, collections_csv, content_hash, derived_doc_id,
                                    file_suffix, parse_collections, resolve_collections,
                                    upload_message)
from corpusq import fixed_values as fv
from corpusq.operators.dedup import dedup_decisions
from corpusq.session import cut_lineage


def tag_chunks(docs: DataFrame) -> DataFrame:
    """Documents with `chunks` (per page) -> chunk rows with ids, file and collections."""
    rows = chunking.number_across_pages(docs, "chunks")
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id", "chunk_index",
        F.when(F.col("paged"), F.col("page")).alias("page"),
        F.col("filename").alias("source_file"), "content", "collections",
        F.create_map(F.lit("collections_csv"), collections_csv(F.col("collections"))).alias("extra"))


def _first_chunks(chunks):
    """Excerpt of a document whose chunks are still in one row."""
    head = F.slice(F.transform(F.flatten(chunks), lambda c: c["content"]), 1, fv.EXCERPT_CHUNKS)
    return F.substring(F.array_join(head, "\n\n"), 1, fv.EXCERPT_CHARS)


def ingest(uploads: DataFrame, registry: DataFrame, config: EngineConfig = EngineConfig(),
           splitter: str = "recursive", id_length: int = 32, materialise: bool = True,
           hot_rows: int | None = None) -> dict[str, DataFrame]:
    """One batch of uploads.

    `uploads`: upload_id (unique), filename, user_id, pages ARRAY<STRING>, paged BOOLEAN,
    content_hash STRING, n_bytes, collections_raw STRING, auto_suggest BOOLEAN,
    uploaded_at. Returns registry, document_collections, chunks (new rows only), rejects
    and responses. Ids derive from the upload, so a re-run gives the same rows.

    Every upload is in the registry or in the rejects. Uploads nobody could read (NULL
    pages) are rejected, and so is one whose derived id is taken by an earlier upload of the
    batch or by the registry. `id_length` 12 gives ids as imported registries have them.

    Only ids and hashes go through the duplicate search; the texts meet its outcome in one
    anti join on upload_id and never group by hash. `materialise` checkpoints the ids and
    hashes, read by each step of that search, and the split documents, which feed three
    outputs; without it the texts are read and hashed again for each.
    """
    checked = validate.check_uploads(
        uploads.withColumn("doc_id", derived_doc_id(
            F.col("user_id"), F.col("upload_id"), F.col("content_hash"), length=id_length)),
        config).withColumn("error_code", F.coalesce("error_code", F.when(
            F.col("pages").isNull(), F.lit(fv.UNSUPPORTED_TYPE))))
    narrow = checked.select("upload_id", "doc_id", "filename", "user_id", "uploaded_at", "error_code",
                            F.col("content_hash").alias("file_hash"))
    if materialise:
        narrow = cut_lineage(narrow)
    invalid = narrow.where(F.col("error_code").isNotNull())
    decided = dedup_decisions(validate.accepted(narrow), registry, config.isolated, hot_rows)
    copies = decided.where(F.col("error_code").isNotNull()).unionByName(
        _taken_ids(decided.where(F.col("error_code").isNull()), registry))
    if materialise:
        copies = cut_lineage(copies)
    rejects = (invalid.withColumn("existing_filename", F.lit(None).cast("string"))
               .select("doc_id", "filename", "user_id", "error_code", "existing_filename")
               .unionByName(copies.select("doc_id", "filename", "user_id", "error_code",
                                          "existing_filename")))
    good = validate.accepted(checked).join(copies.select("upload_id"), "upload_id", "left_anti")

    split = good.withColumn("chunks", _split_pages(F.col("pages"), config, splitter)).drop("pages")
    split = split.withColumn("suggested", F.when(
        F.col("auto_suggest"), suggest_labels(taxonomy_tokens(_first_chunks(F.col("chunks"))))))
    manual = parse_collections(F.col("collections_raw"))
    split = split.withColumn("suggested", F.when(
        F.coalesce(F.size(manual), F.lit(0)) == 0, F.col("suggested")))
    split = split.withColumns({
        "collections": resolve_collections(manual, F.col("auto_suggest"), F.col("suggested")),
        "chunk_count": F.size(F.flatten("chunks")),
        "file_type": file_suffix(F.col("filename")),
        "file_hash": F.col("content_hash"),
    })
    if materialise:
        split = cut_lineage(split)
    return {
        "registry": split.select("doc_id", "filename", "file_type", "chunk_count", "user_id",
                                 "file_hash", "uploaded_at"),
        "document_collections": split.select("doc_id", F.explode("collections").alias("collection")),
        "chunks": tag_chunks(split),
        "rejects": rejects,
        "responses": split.select("doc_id", "filename", "chunk_count", "collections",
                                  F.col("suggested").alias("suggested_collections"), "user_id",
                                  upload_message(F.col("suggested")).alias("message")),
    }


def _taken_ids(placed: DataFrame, registry: DataFrame) -> DataFrame:
    """Uploads whose id another document already has: stored, or earlier in the batch."""
    owner = registry.select("doc_id", F.col("filename").alias("_stored"))
    first = W.partitionBy("doc_id").orderBy("uploaded_at", "upload_id")
    seen = placed.join(owner, "doc_id", "left").withColumns({
        "_n": F.row_number().over(first), "_head": F.first("filename").over(first)})
    return seen.where((F.col("_n") > 1) | F.col("_stored").isNotNull()).select(
        *[c for c in placed.columns if c not in ("error_code", "existing_filename")],
        F.lit(fv.DUPLICATE).alias("error_code"),
        F.coalesce("_stored", "_head").alias("existing_filename"))


def _split_pages(pages, config: EngineConfig, splitter: str):
    if splitter == "fixed":
        return F.transform(pages, lambda p: chunking.chunk_fixed(
            p, config.chunk_size, config.chunk_overlap))
    return chunking.chunk_pages_recursive(pages, config.chunk_size, config.chunk_overlap)


def uploads_from_files(files: DataFrame, user_id: str | None = None) -> DataFrame:
    """Scanned files with extracted `pages` as uploads of one user or of a user_id column."""
    owner = F.lit(user_id) if user_id is not None else F.col("user_id")
    raw = F.col("collections_raw") if "collections_raw" in files.columns \
        else F.lit(None).cast("string")
    auto = F.col("auto_suggest") if "auto_suggest" in files.columns else F.lit(False)
    return files.select(
        F.col("path").alias("upload_id"), "filename", owner.alias("user_id"),
        "pages", F.coalesce(F.size("pages") > 1, F.lit(False)).alias("paged"),
        content_hash(F.col("content")).alias("content_hash"), "n_bytes",
        raw.alias("collections_raw"), auto.alias("auto_suggest"),
        F.col("modified_at").alias("uploaded_at"))


def build_vectors(chunks: DataFrame, dims: int = 256, model=None, idf=None) -> DataFrame:
    """(chunk_id, doc_id, embedding, norm) of chunks; see embed_column for `model` and `idf`."""
    embedded = embed_column(chunks.select("chunk_id", "doc_id", "content"), "content",
                            dims=dims, model=model, idf=idf)
    square = F.aggregate("embedding", F.lit(0.0),
                         lambda s, x: s + x.cast("double") * x.cast("double"))
    return embedded.select("chunk_id", "doc_id", "embedding", F.sqrt(square).alias("norm"))
