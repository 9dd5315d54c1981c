"""Files, stored tables, the legacy registry, caller-supplied functions, and invariants of
the sequential splitter and the vectors."""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.checks.base import check, quote, sql_list
from corpusq.checks.derived import sql
from corpusq.checks.relational import REGISTRY, ingest, uploads_of
from corpusq.checks.retrieval import _PASSAGE_CTES, _PRE, _store
from corpusq.checks.textual import _CLASSIFY_WITH, planted_chunks
from corpusq.config import EngineConfig
from corpusq.functions import chunking
from corpusq.functions.embed import embed_column
from corpusq.functions.taxonomy import taxonomy_table
from corpusq.functions.text import words
from corpusq.operators import classify
from corpusq.operators.lexical import postings, sharing_chunks
from corpusq.plans.ingest import build_vectors
from corpusq.plans.retrieve import retrieve
from corpusq.session import shared_folder
from corpusq.sources import files, tables


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/corpusq-{uuid.uuid4().hex}"


# --- files --------------------------------------------------------------------------------

def _landed(t) -> list[str]:
    """Documents written as one text file each, named by id."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt"))
    line = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    return files.land_files(t.documents.select(name.alias("name"), line.cast("binary").alias("content")), _folder(t))


def _file_doc(path="path"):
    return F.nullif(F.regexp_extract(path, r"/(-?[0-9]+)\.txt$", 1), F.lit(""))


@check("s1_scan_files", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, '.txt' AS file_type, strlen(text) + 1 AS n_bytes
    FROM documents""")
def _(t):
    return files.scan_files(t.spark, _landed(t), content=False).select(_file_doc().alias("doc_id"), "file_type", "n_bytes")


@check("s2_load_text", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text || chr(10)) AS hash FROM documents")
def _(t):
    return files.load_text(t.spark, _landed(t)).select(_file_doc().alias("doc_id"), F.sha2(
        F.col("content").cast("binary"), 256).alias("hash"))


def _stored_files(t):
    """Stored bytes as a file scan gives them; the suffix follows the language."""
    kind = (F.when(F.col("lang") == "en", F.lit(".txt")).when(F.col("lang") == "de", F.lit(".pages"))
            .when(F.col("lang") == "fr", F.lit(".md")).otherwise(F.lit(".pdf")))
    path = F.concat(F.lit("/in/"), F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("_"), "source", kind)
    return t.documents.select(
        F.md5(F.col("doc_id").cast("string").cast("binary")).alias("doc_id"), "source", path.alias("path"),
        kind.alias("file_type"), F.col("text").cast("binary").alias("content"))


@check("s9_attach_payload", """SELECT md5(CAST(d.doc_id AS VARCHAR)) AS doc_id, CASE WHEN d.source = 'src1' THEN sha256(d.text) END AS hash,
    CASE WHEN d.source = 'src1' THEN NULL ELSE 404 END AS error_code FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    """One owner asks for every labelled document and gets the bytes of the own ones."""
    stored = _stored_files(t)
    registry = stored.select("doc_id", F.col("source").alias("filename"), F.col("source").alias("user_id"))
    asked = t.labels.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("doc_id"), F.lit("src1").alias("user_id"))
    return files.attach_payload(stored, registry, asked).select(
        "doc_id", F.sha2("content", 256).alias("hash"), "error_code")


@check("e2_extract_text", """SELECT md5(CAST(doc_id AS VARCHAR)) AS doc_id, CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 1
    WHEN 'de' THEN len(string_split(text, chr(10))) END AS pages FROM documents""")
def _(t):
    """A caller's parser makes a page of every line; nobody reads the other types."""
    read = files.extract_text(_stored_files(t), {".pages": lambda data: data.decode().split("\n")})
    return read.select("doc_id", F.when(F.col("pages").isNotNull(), F.size("pages")).alias("pages"))


@check("s10_ingest_unreadable", """SELECT CASE WHEN lang = 'es' THEN 400 END AS error_code, count(*) AS uploads FROM (
    SELECT lang, row_number() OVER (PARTITION BY source, CASE WHEN lang = 'es' THEN CAST(doc_id AS VARCHAR) ELSE sha256(text) END
    ORDER BY doc_id) AS r FROM documents) WHERE r = 1 GROUP BY 1""")
def _(t):
    """Documents nobody can read are rejected; with the copies, all uploads are accounted for."""
    up = uploads_of(t.documents, t.day0).withColumns({
        "n_bytes": F.lit(1), "filename": F.concat("upload_id", F.lit(".txt"))}).join(
        t.documents.select(F.col("doc_id").cast("string").alias("upload_id"), "lang"), "upload_id")
    up = up.withColumn("pages", F.when(F.col("lang") != "es", F.col("pages"))).drop("lang")
    out = ingest(up, t.spark.createDataFrame([], REGISTRY), splitter="recursive")
    none = F.lit(None).cast("int")
    return out["registry"].select(none.alias("error_code")).union(
        out["rejects"].where("error_code = 400").select("error_code")).groupBy("error_code").agg(
        F.count(F.lit(1)).alias("uploads"))


# --- stored tables ---------------------------------------------------------------------------

@check("s6_import_legacy_registry", """SELECT 'b' || CAST(item_id AS VARCHAR) AS doc_id, 'src' || CAST(item_id % 20 AS VARCHAR) AS user_id,
    'Src' || CAST(item_id % 20 AS VARCHAR) AS display_name, unnest(CASE item_id % 3 WHEN 0 THEN ['x', 'y'] WHEN 1 THEN ['single']
    ELSE ['other'] END) AS collection FROM benchmark""")
def _(t):
    """The benchmark items as the documents of legacy JSON registries."""
    folder = _folder(t)
    i = F.col("item_id")
    entry = F.struct(
        F.concat(F.lit("b"), i.cast("string")).alias("key"), F.struct(
            F.concat(F.lit("f"), i.cast("string")).alias("filename"),
            F.concat(F.lit("src"), (i % 20).cast("string")).alias("user_id"),
            F.when(i % 3 == 0, F.array(F.lit("x"), F.lit("y"), F.lit("x"))).alias("collections"),
            F.when(i % 3 == 1, F.lit("single")).alias("collection")).alias("value"))
    # one registry of some hundred entries for each bucket of items
    buckets = 1 + t.benchmark.count() // 500
    t.benchmark.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(buckets)).alias("bucket")).agg(
        F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("documents"))).alias("value")
    ).write.partitionBy("bucket").text(folder)
    empty = {n: t.spark.createDataFrame([], s) for n, s in tables.TABLES.items()}
    out = tables.import_legacy_registry(t.spark, None, folder, empty["users"], empty["registry"],
                                        empty["document_collections"], t.day0)
    return out["registry"].join(out["users"], "user_id").join(out["document_collections"], "doc_id").select(
        "doc_id", "user_id", "display_name", "collection")


@check("s7_saved_chunks", sql("SELECT chunk_id, doc_id, sha256(content) AS hash FROM chunks", "chunks"))
def _(t):
    folder = _folder(t)
    tables.save_index({"chunks": t.chunks.select("chunk_id", "doc_id", "content")}, folder, buckets=16)
    return tables.load_index(t.spark, folder, "chunks").select(
        "chunk_id", "doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


@check("s7_search_saved_postings", sql("""SELECT query_id, count(*) AS chunks FROM (SELECT DISTINCT query_id, chunk_id
    FROM (SELECT query_id, unnest(string_split_regex(lower(question), '\\s+')) AS term FROM scoped_queries)
    JOIN (SELECT chunk_id, unnest(string_split_regex(lower(content), '\\s+')) AS term FROM chunks) USING (term)
    WHERE term <> '') GROUP BY 1""", "chunks", "scoped_queries"))
def _(t):
    """All chunks that share a word with a question, from the asked words' buckets of a saved index."""
    folder = _folder(t)
    tables.save_index({"postings": postings(t.chunks)}, folder)
    return sharing_chunks(t.scoped_queries, tables.load_index(t.spark, folder, "postings"))


@check("s8_registry_io", sql("SELECT doc_id, filename, file_type, user_id, file_hash FROM registry", "registry"))
def _(t):
    folder = _folder(t)
    tables.write_table(t.registry, "registry", folder, "orc")
    return tables.read_table(t.spark, "registry", folder, "orc").select(
        "doc_id", "filename", "file_type", "user_id", "file_hash")


# --- taxonomy -------------------------------------------------------------------------------

_TAXONOMY = ", ".join(f"({quote(p)}, {quote(d)}, {sql_list(leaves)})" for p, d, leaves in fv.TAXONOMY)


@check("p14_taxonomy_table", _CLASSIFY_WITH + f""", tax(p, d, leaves) AS (VALUES {_TAXONOMY}), leaf AS (
    SELECT p AS primary_name, d AS domain, unnest(leaves) AS sub_domain FROM tax)
    SELECT primary_name, domain, sub_domain, count(l.doc_id) AS documents FROM leaf
    LEFT JOIN labels_of l ON list_contains(string_split(l.labels, '|'), domain) GROUP BY ALL""")
def _(t):
    """Every sub-domain with the number of documents labelled with its domain."""
    labels = classify.classify_documents(planted_chunks(t)).select("doc_id", F.explode("labels").alias("domain"))
    counts = labels.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return (taxonomy_table(t.spark).join(counts, "domain", "left")
            .groupBy("primary_name", "domain", "sub_domain").agg(F.sum(F.coalesce("n", F.lit(0))).alias("documents")))


# --- splitter and vectors ---------------------------------------------------------------------

@check("c1_chunk_invariants", sql("""SELECT doc_id, true AS fits, true AS in_order, true AS overlap_is_short,
    true AS nothing_lost FROM docs""", "docs"))
def _(t):
    """Pieces of at most 1000 characters, in order, overlapping by at most 200; all between
    two pieces is blank."""
    docs = t.docs.select("doc_id", "text", chunking.chunk_recursive(F.col("text")).alias("c"))
    end = lambda x: x["start"] + F.length(x["content"])
    pairs = F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c"), F.lit(1))),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    between = lambda a, b: F.trim(F.regexp_replace(F.col("text").substr(
        a + 1, F.greatest(b - a, F.lit(0))), r"[\s\p{Z}]", "")) == ""
    tail = F.when(F.size("c") > 0, between(end(F.element_at("c", -1)), F.length("text"))).otherwise(
        between(F.lit(0), F.length("text")))
    head = F.when(F.size("c") > 0, between(F.lit(0), F.get("c", F.lit(0))["start"])).otherwise(F.lit(True))
    return docs.select(
        "doc_id", F.forall("c", lambda x: F.length(x["content"]) <= 1000).alias("fits"),
        F.forall(pairs, lambda p: p["a"]["start"] < p["b"]["start"]).alias("in_order"),
        F.forall(pairs, lambda p: end(p["a"]) - p["b"]["start"] <= 200).alias("overlap_is_short"),
        (head & tail & F.forall(pairs, lambda p: between(end(p["a"]), p["b"]["start"]))).alias("nothing_lost"))


@check("c1_chunk_without_separators", sql("""SELECT doc_id, p AS start, substr(body, CAST(p + 1 AS BIGINT), 1000) AS content FROM (
    SELECT doc_id, body, unnest(range(0, greatest(length(body) - 200 - 1, 0) + 1, 800)) AS p FROM (
    SELECT doc_id, regexp_replace(text, '[\\s.]', '', 'g') AS body FROM docs) WHERE length(body) > 0)""", "docs"))
def _(t):
    """Without separators the recursive splitter is the fixed one."""
    body = F.regexp_replace("text", r"[\s.]", "")
    docs = t.docs.select("doc_id", chunking.chunk_recursive(body).alias("chunks"))
    return docs.select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.start", "c.content")


@check("e1_vector_invariants", sql("""SELECT sha256(text) AS hash, count(*) AS copies, 1 AS vectors, CASE WHEN regexp_matches(text, '\\S')
    THEN 1::DOUBLE ELSE 0::DOUBLE END AS norm, true AS few FROM docs GROUP BY text""", "docs"))
def _(t):
    """Equal texts have one vector of norm 1, with no more components than distinct words."""
    v = embed_column(t.docs.select("text"), "text")
    used = F.size(F.filter("embedding", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return v.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("hash")).agg(
        F.count(F.lit(1)).alias("copies"), F.count_distinct(F.xxhash64("embedding")).alias("vectors"),
        F.round(F.max(norm), 4).alias("norm"), F.every(used <= F.size(F.array_distinct(words(F.col("text"))))).alias("few"))


def _length_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda s: [float(len(s)), 1.0])


@check("e3_embedding_hook", sql("SELECT chunk_id, CAST(length(content) AS DOUBLE) AS first, 1::DOUBLE AS second FROM chunks", "chunks"))
def _(t):
    """A caller's model in place of hashed words."""
    return build_vectors(t.chunks, model=_length_model).select(
        "chunk_id", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(1)).alias("second"))


@check("e5_reply_table", _CLASSIFY_WITH + """ SELECT l.doc_id, CASE WHEN g.doc_id IS NOT NULL THEN 'tax|banking' ELSE l.labels END AS labels
    FROM labels_of l LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) g ON CAST(g.doc_id AS VARCHAR) = l.doc_id""")
def _(t):
    """Replies of a classifier take the place of word overlap where there are some."""
    replies = t.labels.where("quality = 1").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit('["tax", "banking"]').alias("reply")).distinct()
    return classify.classify_documents(planted_chunks(t), replies).select(
        "doc_id", F.array_join("labels", "|").alias("labels"))


@check("e5_score_table", sql("""SELECT query_id, chunk_id, score, r AS rank FROM (SELECT query_id, chunk_id, s AS score, row_number() OVER (
    PARTITION BY query_id ORDER BY s DESC, rank, chunk_id) AS r FROM (SELECT *, (CAST(split_part(chunk_id, '_', 1) AS BIGINT) % 7) / 8.0 AS s FROM vec3))
    WHERE r <= 4""", *_PASSAGE_CTES, vec3=_PRE.replace("r <= top_k", "r <= 3 * top_k")))
def _(t):
    """A table of scores re-ranks the candidates."""
    plain = retrieve(t.passage_queries, _store(t), EngineConfig(max_top_k=60, rerank_enabled=True, rerank_top_n=60))
    score = (F.substring_index("chunk_id", "_", 1).cast("bigint") % 7) / F.lit(8.0)
    scores = plain.select("query_id", "chunk_id", score.alias("score"))
    return retrieve(t.passage_queries, _store(t), EngineConfig(rerank_enabled=True), scores).select(
        "query_id", "chunk_id", "score", "rank")
