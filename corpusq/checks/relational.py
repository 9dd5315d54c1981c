"""Registry, memberships, users, scopes, mutations, duplicates, ingestion."""

import uuid

from pyspark.sql import functions as F

from corpusq.checks.base import check, sql_list
from corpusq.checks.derived import sql
from corpusq.config import EngineConfig
from corpusq.functions.taxonomy import PRIMARIES
from corpusq.operators import dedup, mutations, registry as reg
from corpusq.operators.scope import resolve_scope, scope_sizes
from corpusq.plans.ingest import ingest
from corpusq.schemas import REGISTRY
from corpusq.session import shared_folder
from corpusq.sources import buckets

_ISO = "strftime(TIMESTAMP '2024-01-01' + to_seconds(CAST(uploaded_second AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"
_LISTS = "SELECT doc_id, string_agg(collection, '|' ORDER BY collection) AS names FROM collections GROUP BY doc_id"


def _flat(df):
    return df.withColumn("collections", F.array_join("collections", "|"))


_DOC_COLS = ["doc_id", "filename", "file_type", "user_id", "file_hash", "uploaded_at", "collections"]
_LIST_SQL = f"""SELECT r.doc_id, filename, file_type, user_id, file_hash, {_ISO} AS uploaded_at,
    coalesce(names, '') AS collections FROM registry r LEFT JOIN lists l ON l.doc_id = r.doc_id"""


# --- reads ---------------------------------------------------------------------------

@check("j1_list_documents", sql(_LIST_SQL, "registry", "collections", lists=_LISTS))
def _(t):
    return _flat(reg.list_documents(t.registry, t.collections)).select(*_DOC_COLS)


@check("f9_list_own_documents", sql(_LIST_SQL + " WHERE user_id = 'src3'", "registry", "collections", lists=_LISTS))
def _(t):
    return _flat(reg.list_documents(t.registry, t.collections, "src3")).select(*_DOC_COLS)


@check("j2_list_by_collection", sql(_LIST_SQL + """ WHERE r.doc_id IN (SELECT doc_id FROM collections
    WHERE collection = 'quality')""", "registry", "collections", lists=_LISTS))
def _(t):
    return _flat(reg.list_by_collection(t.registry, t.collections, "quality")).select(*_DOC_COLS)


@check("j3_collections_of_users", sql("""SELECT DISTINCT user_id, collection FROM registry r
    JOIN collections c ON c.doc_id = r.doc_id""", "registry", "collections"))
def _(t):
    return reg.collections_of_users(t.registry, t.collections)


@check("k7_list_collections", sql("""SELECT DISTINCT collection FROM registry r
    JOIN collections c ON c.doc_id = r.doc_id WHERE user_id = 'src5' ORDER BY 1""", "registry", "collections"))
def _(t):
    return reg.list_collections(t.registry, t.collections, "src5")


@check("u2_known_collections", sql(f"""SELECT collection FROM collections UNION SELECT unnest({sql_list(PRIMARIES)})""",
                                   "collections"))
def _(t):
    return reg.known_collections(t.collections, with_taxonomy=True)


@check("f10_u3_documents_in_list", sql("""SELECT doc_id, filename FROM registry WHERE doc_id IN
    (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""", "registry"))
def _(t):
    ids = t.labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    return t.registry.select("doc_id", "filename").join(ids, "doc_id", "left_semi")


@check("f11_documents_by_id", sql("""SELECT l.doc_id AS request, coalesce(filename, '') AS filename,
    CASE WHEN filename IS NULL THEN 404 ELSE 0 END AS error_code FROM labels l
    LEFT JOIN registry r ON r.doc_id = CAST(l.doc_id * 2 AS VARCHAR)""", "registry"))
def _(t):
    asked = t.labels.select(F.col("doc_id").alias("request"),
                            (F.col("doc_id") * 2).cast("string").alias("doc_id"))
    return reg.documents_by_id(asked, t.registry).select(
        "request", F.coalesce("filename", F.lit("")).alias("filename"),
        F.coalesce("error_code", F.lit(0)).alias("error_code"))


@check("f13_without_chunks", sql("""SELECT CAST(l.doc_id * 2 AS VARCHAR) AS doc_id, 404 AS error_code FROM labels l
    WHERE CAST(l.doc_id * 2 AS VARCHAR) NOT IN (SELECT doc_id FROM chunks)""", "chunks"))
def _(t):
    asked = t.labels.select((F.col("doc_id") * 2).cast("string").alias("doc_id"))
    return reg.without_chunks(asked, t.chunks)


@check("a1_document_count", "SELECT count(*) AS document_count FROM documents")
def _(t):
    return reg.document_count(t.registry)


@check("a2_user_exists", sql("""SELECT DISTINCT 'src' || CAST(e.user_id AS VARCHAR) AS user_id,
    'src' || CAST(e.user_id AS VARCHAR) IN (SELECT user_id FROM users) AS user_exists FROM events e""", "users"))
def _(t):
    asked = t.events.select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("user_id"))
    return reg.user_exists(asked, t.users)


@check("a3_list_total", sql("SELECT user_id, count(*) AS total FROM registry GROUP BY 1", "registry"))
def _(t):
    return reg.list_documents(t.registry, t.collections).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"))


@check("a4_chunk_counts", sql("""SELECT r.doc_id, count(chunk_id) AS chunk_count FROM registry r
    LEFT JOIN chunks c ON c.doc_id = r.doc_id GROUP BY 1""", "registry", "chunks"))
def _(t):
    return reg.chunk_counts(t.registry, t.chunks)


@check("a5_collection_facets", sql("""SELECT collection, count(DISTINCT doc_id) AS documents FROM collections
    GROUP BY 1""", "collections"))
def _(t):
    return reg.collection_facets(t.collections)


@check("a9_store_inventory", sql("SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM chunks", "chunks"))
def _(t):
    return reg.store_inventory(t.chunks)


@check("m6_list_users", sql("""SELECT user_id, display_name, '2024-01-01T00:00:00.000000+00:00' AS created_at
    FROM users""", "users"))
def _(t):
    return reg.list_users(t.users)


@check("m6_current_user", """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'admin' WHEN turn % 2 = 0 THEN 'admin'
    ELSE role END AS user_id FROM conversations""")
def _(t):
    header = F.when(F.col("role") == "system", F.lit("")).when(F.col("turn") % 2 == 1, F.col("role"))
    return t.conversations.select("conv_id", "turn", reg.current_user(header).alias("user_id"))


@check("j9_orphan_check", sql("""SELECT 'registry.user_id' AS relation, user_id AS orphan_key, count(*) AS rows
    FROM registry WHERE user_id NOT IN (SELECT user_id FROM some_users) GROUP BY 2 UNION ALL
    SELECT 'document_collections.doc_id', CAST(doc_id * 2 AS VARCHAR), count(*) FROM labels
    WHERE CAST(doc_id * 2 AS VARCHAR) NOT IN (SELECT doc_id FROM registry) GROUP BY 2 UNION ALL
    SELECT 'chat_sessions.user_id', user_id, count(*) FROM chat_sessions WHERE user_id NOT IN
    (SELECT user_id FROM some_users) GROUP BY 2 UNION ALL
    SELECT 'chat_messages.session_id', session_id, count(*) FROM log WHERE session_id NOT IN
    (SELECT session_id FROM chat_sessions) GROUP BY 2""", "registry", "chat_sessions", "log",
    some_users="SELECT DISTINCT source AS user_id FROM documents WHERE lang = 'fr' AND n_chars > 2500"))
def _(t):
    users = t.documents.where("lang = 'fr' AND n_chars > 2500").select(F.col("source").alias("user_id")).distinct()
    memberships = t.labels.select((F.col("doc_id") * 2).cast("string").alias("doc_id"))
    return reg.orphan_check(users, t.registry, memberships, t.chat_sessions, t.log)


# --- scopes ---------------------------------------------------------------------------

_SCOPE_PARTS = """SELECT *, substr(sha256(CAST(to_json({{'_owner': CAST({owner} AS VARCHAR), '_collection': collection,
    '_ids': list_sort(list_distinct(doc_ids))}}) AS VARCHAR)), 1, 32) AS sid FROM scoped_queries"""
_SCOPED = """SELECT DISTINCT q.sid AS scope_id, r.doc_id FROM named q JOIN registry r ON r.user_id = q.user_id
    WHERE (q.collection IS NULL OR EXISTS (SELECT 1 FROM collections c WHERE c.doc_id = r.doc_id
    AND c.collection = q.collection)) AND (q.doc_ids IS NULL OR list_contains(q.doc_ids, r.doc_id))"""
_OPEN = """SELECT DISTINCT q.sid AS scope_id, r.doc_id FROM named q JOIN {universe} r ON TRUE
    WHERE NOT (q.collection IS NULL AND q.doc_ids IS NULL)
    AND (q.collection IS NULL OR EXISTS (SELECT 1 FROM collections c WHERE c.doc_id = r.doc_id
    AND c.collection = q.collection)) AND (q.doc_ids IS NULL OR list_contains(q.doc_ids, r.doc_id))""".format(
    universe="(SELECT doc_id FROM registry UNION SELECT unnest(doc_ids) FROM scoped_queries WHERE collection IS NULL)")
_OPEN_SQL = dict(named=_SCOPE_PARTS.format(owner="NULL"))
_CLOSED_SQL = dict(named=_SCOPE_PARTS.format(owner="user_id"))


@check("j4_resolve_scope", sql(_SCOPED, "registry", "collections", "scoped_queries", **_CLOSED_SQL))
def _(t):
    return resolve_scope(t.scoped_queries, t.registry, t.collections).docs


@check("j4_resolve_scope_open", sql(_OPEN, "registry", "collections", "scoped_queries", **_OPEN_SQL))
def _(t):
    return resolve_scope(t.scoped_queries, t.registry, t.collections, EngineConfig(isolation="none")).docs


@check("j4_scope_sizes", sql("""SELECT q.query_id, count(s.doc_id) AS visible_documents FROM named q
    LEFT JOIN scoped s ON s.scope_id = q.sid GROUP BY 1""", "registry", "collections", "scoped_queries",
    **_CLOSED_SQL, scoped=_SCOPED))
def _(t):
    return scope_sizes(resolve_scope(t.scoped_queries, t.registry, t.collections))


# --- duplicates -------------------------------------------------------------------------

def _split_registry(t):
    """Labelled documents are stored already, the others come in."""
    labelled = t.labels.select(F.col("doc_id").cast("string").alias("doc_id"))
    return (t.registry.join(labelled, "doc_id", "left_anti"),
            t.registry.join(labelled, "doc_id", "left_semi"))


_INCOMING = "SELECT * FROM registry WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"
_STORED = "SELECT * FROM registry WHERE doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"


def _dedup_sql(key: str) -> str:
    return sql(f"""SELECT doc_id, CASE WHEN known IS NOT NULL OR r > 1 THEN 409 ELSE 0 END AS error_code,
        CASE WHEN known IS NOT NULL THEN known WHEN r > 1 THEN head ELSE '' END AS existing_filename FROM (
        SELECT i.doc_id, first_known.filename AS known,
        row_number() OVER w AS r, first_value(i.filename) OVER w AS head FROM incoming i
        LEFT JOIN first_known USING ({key}) WINDOW w AS (PARTITION BY {', '.join('i.' + k.strip() for k in key.split(','))}
        ORDER BY i.uploaded_second, i.doc_id))""", "registry", incoming=_INCOMING, stored=_STORED,
        first_known=f"SELECT {key}, arg_min(filename, uploaded_second) AS filename FROM stored GROUP BY {key}")


def _decisions(t, isolated):
    incoming, stored = _split_registry(t)
    return dedup.dedup_decisions(incoming, stored, isolated).select(
        "doc_id", F.coalesce("error_code", F.lit(0)).alias("error_code"),
        F.coalesce("existing_filename", F.lit("")).alias("existing_filename"))


@check("d1_dedup_exact", _dedup_sql("user_id, file_hash"))
def _(t):
    return _decisions(t, True)


@check("d1_dedup_exact_all_owners", _dedup_sql("file_hash"))
def _(t):
    return _decisions(t, False)


@check("j7_duplicate_probe", sql("""SELECT i.doc_id, s.filename AS existing_filename FROM incoming i JOIN (
    SELECT file_hash, arg_min(filename, uploaded_second) AS filename FROM stored GROUP BY 1) s USING (file_hash)""",
    "registry", incoming=_INCOMING, stored=_STORED))
def _(t):
    incoming, stored = _split_registry(t)
    return dedup.duplicate_probe(incoming.select("doc_id", "file_hash"), stored, isolated=False).select(
        "doc_id", "existing_filename")


@check("w4_first_copies", sql("""SELECT file_hash, arg_min(doc_id, uploaded_second) AS doc_id,
    arg_min(filename, uploaded_second) AS filename, count(*) AS copies FROM registry GROUP BY 1""", "registry"))
def _(t):
    return dedup.first_copies(t.registry, isolated=False).select("file_hash", "doc_id", "filename", "copies")


# --- ingestion ----------------------------------------------------------------------------

def uploads_of(documents, day0):
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"),
                    F.when(F.col("lang") == "de", F.lit(".exe")).otherwise(F.lit(".txt")))
    return documents.select(
        F.col("doc_id").cast("string").alias("upload_id"), name.alias("filename"),
        F.col("source").alias("user_id"), F.array("text").alias("pages"), F.lit(False).alias("paged"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
        (F.col("n_chars") * 1000).alias("n_bytes"),
        F.when(F.col("lang") == "fr", F.concat(F.lit(" fr ,, "), "source", F.lit(",fr"))).alias("collections_raw"),
        F.lit(False).alias("auto_suggest"),
        F.timestamp_seconds(F.unix_seconds(day0) + F.col("doc_id")).alias("uploaded_at"))


_UPLOADS = """SELECT doc_id, source, lang, text, substr(sha256(length(source) || ':' || source || '|' ||
    length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR) || '|64:' || sha256(text)), 1, 32) AS id, source || '_' || CAST(doc_id AS VARCHAR) || CASE lang WHEN 'de' THEN '.exe' ELSE '.txt' END
    AS filename, CASE WHEN lang = 'de' THEN 400 WHEN n_chars * 1000 > 52428800 THEN 413 ELSE 0 END AS code FROM documents"""
_PLACED = """SELECT *, row_number() OVER w AS r, first_value(filename) OVER w AS head FROM uploads WHERE code = 0
    WINDOW w AS (PARTITION BY source, sha256(text) ORDER BY doc_id)"""


def _ingested(t):
    return ingest(uploads_of(t.documents, t.day0), t.spark.createDataFrame([], REGISTRY), splitter="fixed")


@check("s10_ingest_registry", sql("""SELECT id AS doc_id, filename, '.txt' AS file_type, source AS user_id,
    sha256(text) AS file_hash, CASE WHEN length(text) = 0 THEN 0 ELSE
    len(range(0, greatest(length(text) - 201, 0) + 1, 800)) END AS chunk_count FROM placed WHERE r = 1""",
    uploads=_UPLOADS, placed=_PLACED))
def _(t):
    return _ingested(t)["registry"].drop("uploaded_at")


@check("s10_ingest_collections", sql("""SELECT id AS doc_id, unnest(CASE lang WHEN 'fr' THEN ['fr', source] ELSE ['other'] END)
    AS collection FROM placed WHERE r = 1""", uploads=_UPLOADS, placed=_PLACED))
def _(t):
    return _ingested(t)["document_collections"]


INGESTED_CHUNKS = sql("""SELECT id || '_chunk_' || CAST(p // 800 AS VARCHAR) AS chunk_id, id AS doc_id,
    p // 800 AS chunk_index, filename AS source_file, substr(text, CAST(p + 1 AS BIGINT), 1000) AS content,
    CASE lang WHEN 'fr' THEN 'fr|' || source ELSE 'other' END AS collections_csv FROM (
    SELECT *, unnest(range(0, greatest(length(text) - 201, 0) + 1, 800)) AS p FROM placed WHERE r = 1 AND length(text) > 0)""",
    uploads=_UPLOADS, placed=_PLACED)


def chunk_columns(chunks):
    return chunks.select("chunk_id", "doc_id", "chunk_index", "source_file", "content",
                         F.col("extra")["collections_csv"].alias("collections_csv"))


@check("s10_p4_ingest_chunks", INGESTED_CHUNKS)
def _(t):
    return chunk_columns(_ingested(t)["chunks"])


@check("s10_ingest_rejects", sql("""SELECT id AS doc_id, filename, source AS user_id, code AS error_code,
    '' AS existing_filename FROM uploads WHERE code <> 0 UNION ALL
    SELECT id, filename, source, 409, head FROM placed WHERE r > 1""", uploads=_UPLOADS, placed=_PLACED))
def _(t):
    return _ingested(t)["rejects"].withColumn("existing_filename", F.coalesce("existing_filename", F.lit("")))


# --- mutations ------------------------------------------------------------------------------

@check("j8_insert_if_absent", sql("""SELECT doc_id, filename FROM registry WHERE doc_id IN (SELECT CAST(doc_id AS VARCHAR)
    FROM labels) UNION ALL SELECT doc_id, 'new_' || filename FROM registry WHERE doc_id NOT IN
    (SELECT CAST(doc_id AS VARCHAR) FROM labels)""", "registry"))
def _(t):
    _, stored = _split_registry(t)
    rows = t.registry.withColumn("filename", F.concat(F.lit("new_"), "filename"))
    return mutations.insert_if_absent(stored, rows, "doc_id").select("doc_id", "filename")


@check("m5_ensure_users", sql("""SELECT user_id, display_name FROM users UNION SELECT 'src' || CAST(user_id AS VARCHAR),
    'Src' || CAST(user_id AS VARCHAR) FROM events""", "users"))
def _(t):
    seen = t.events.select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("user_id"))
    return mutations.ensure_users(t.users, seen, t.day0).select("user_id", "display_name")


@check("m5_create_users", sql("""SELECT DISTINCT user_id, error_code FROM (SELECT 'src' || CAST(e.user_id AS VARCHAR) AS user_id,
    CASE WHEN 'src' || CAST(e.user_id AS VARCHAR) IN (SELECT user_id FROM users) THEN 409 ELSE 0 END AS error_code
    FROM events e)""", "users"))
def _(t):
    asked = t.events.select(F.concat(F.lit("src"), F.col("user_id").cast("string")).alias("user_id")).distinct()
    return mutations.create_users(t.users, asked).select(
        "user_id", F.coalesce("error_code", F.lit(0)).alias("error_code"))


@check("m1_add_documents", sql("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(list_distinct(CASE quality WHEN 1
    THEN [lang, source] ELSE ['other'] END)) AS collection FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT doc_id, collection FROM collections WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""",
    "collections"))
def _(t):
    incoming, stored = _split_registry(t)
    labelled = t.docs.join(t.labels.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, F.array("lang", "source", "lang"))
        .otherwise(F.array().cast("array<string>")).alias("collections"))
    rows = stored.join(labelled, "doc_id")
    memberships = t.collections.join(incoming.select("doc_id"), "doc_id", "left_semi")
    return mutations.add_documents(incoming, memberships, rows)[1]


@check("u1_add_chunks", sql("SELECT chunk_id, doc_id FROM chunks", "chunks"))
def _(t):
    """Chunks of labelled documents are stored; all chunks are sent again."""
    labelled = t.labels.select(F.col("doc_id").cast("string").alias("doc_id"))
    chunks = t.chunks.select("chunk_id", "doc_id")
    return mutations.add_chunks(chunks.join(labelled, "doc_id", "left_semi").select("chunk_id", "doc_id"), chunks)


_TOXIC = "SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE toxic = 1"


@check("m2_delete_documents", sql("""SELECT 'registry' AS tbl, doc_id, '' AS item FROM registry WHERE doc_id NOT IN (FROM gone)
    UNION ALL SELECT 'collections', doc_id, collection FROM collections WHERE doc_id NOT IN (FROM gone)
    UNION ALL SELECT 'chunks', doc_id, chunk_id FROM chunks WHERE doc_id NOT IN (FROM gone)""",
    "registry", "collections", "chunks", gone=_TOXIC))
def _(t):
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    r, c, k = mutations.delete_documents(gone, t.registry, t.collections, t.chunks)
    return (r.select(F.lit("registry").alias("tbl"), "doc_id", F.lit("").alias("item"))
            .union(c.select(F.lit("collections"), "doc_id", "collection"))
            .union(k.select(F.lit("chunks"), "doc_id", "chunk_id")))


@check("m2_check_targets", sql("""SELECT l.doc_id AS request, CASE WHEN r.doc_id IS NULL OR r.user_id <> 'src3' THEN 404
    ELSE 0 END AS error_code FROM labels l LEFT JOIN registry r ON r.doc_id = CAST(l.doc_id * 2 AS VARCHAR)""", "registry"))
def _(t):
    asked = t.labels.select(F.col("doc_id").alias("request"), (F.col("doc_id") * 2).cast("string").alias("doc_id"),
                            F.lit("src3").alias("user_id"))
    return mutations.check_targets(asked, t.registry).select(
        "request", F.coalesce("error_code", F.lit(0)).alias("error_code"))


@check("u4_all_but_one_document", sql("SELECT chunk_id FROM chunks WHERE doc_id <> '7'", "chunks"))
def _(t):
    one = t.docs.where("doc_id = '7'").select("doc_id")
    return mutations.delete_documents(one, t.chunks)[0].select("chunk_id")


@check("m3_replace_collections", sql("""SELECT doc_id, collection FROM collections WHERE doc_id NOT IN (FROM gone)
    UNION ALL SELECT doc_id, unnest(['reviewed', source]) FROM docs WHERE doc_id IN (FROM gone)""",
    "docs", "collections", gone=_TOXIC))
def _(t):
    toxic = t.labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    updates = t.docs.join(toxic, "doc_id", "left_semi").select(
        "doc_id", F.array(F.lit("reviewed"), F.col("source"), F.lit("reviewed")).alias("collections"))
    unknown = toxic.select(F.concat(F.lit("no"), "doc_id").alias("doc_id"), F.array(F.lit("x")).alias("collections"))
    return mutations.replace_collections(t.collections, t.registry, updates.union(unknown))


@check("m2_bucket_table", sql("""SELECT 'old' AS version, doc_id, filename FROM registry UNION ALL
    SELECT 'new', doc_id, CASE WHEN doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1) THEN 'checked' ELSE filename END
    FROM registry WHERE doc_id NOT IN (FROM gone) UNION ALL SELECT 'few', CAST(count(*) AS VARCHAR), 'buckets' FROM (SELECT 1)""",
    "registry", gone=_TOXIC))
def _(t):
    """Deleting and renaming documents in a table kept by buckets: the old version still reads
    the same, and a change of one document writes one bucket."""
    folder = f"{shared_folder(t.spark)}/registry-{uuid.uuid4().hex}"
    first = buckets.create(t.registry, folder, buckets=64)
    gone = t.labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    good = t.labels.where("quality = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    second = first.delete(gone)
    held = second.rows()
    third = second.upsert(held.join(good, "doc_id", "left_semi").withColumn("filename", F.lit("checked")))
    last = third.upsert(third.rows().orderBy("doc_id").limit(1))
    moved = [b for b in last.folders if last.folders[b] != third.folders.get(b)]
    few = t.spark.createDataFrame([("few", str(len(moved)), "buckets")], "version string, doc_id string, filename string")
    return buckets.load(t.spark, folder, 0).rows().select(F.lit("old").alias("version"), "doc_id", "filename").union(
        buckets.load(t.spark, folder).rows().select(F.lit("new"), "doc_id", "filename")).union(few)


@check("m4_merge_metadata", sql("""SELECT chunk_id, CASE WHEN l.doc_id IS NULL THEN source ELSE 'q' || CAST(quality AS VARCHAR)
    END AS source, coalesce(CAST(toxic AS VARCHAR), '') AS toxic FROM chunks c LEFT JOIN labels l
    ON CAST(l.doc_id AS VARCHAR) = c.doc_id""", "chunks"))
def _(t):
    updates = t.labels.select(F.col("doc_id").cast("string").alias("doc_id"), F.create_map(
        F.lit("source"), F.concat(F.lit("q"), F.col("quality").cast("string")),
        F.lit("toxic"), F.col("toxic").cast("string")).alias("updates"))
    return mutations.merge_metadata(t.chunks, updates).select(
        "chunk_id", F.col("extra")["source"].alias("source"),
        F.coalesce(F.col("extra")["toxic"], F.lit("")).alias("toxic"))


@check("m7_delete_users", sql("""SELECT 'users' AS tbl, user_id AS item, '' AS owner FROM users WHERE user_id NOT IN (FROM gone)
    UNION ALL SELECT 'registry', doc_id, user_id FROM registry WHERE user_id NOT IN (FROM gone)
    UNION ALL SELECT 'chunks', chunk_id, '' FROM chunks WHERE source NOT IN (FROM gone)
    UNION ALL SELECT 'sessions', session_id, CASE WHEN user_id IN (FROM gone) THEN '' ELSE user_id END FROM chat_sessions""",
    "users", "registry", "chunks", "chat_sessions", gone="SELECT unnest(['src3', 'src11']) AS user_id"))
def _(t):
    gone = t.users.where(F.col("user_id").isin("src3", "src11"))
    out = mutations.delete_users(gone, t.users, t.registry, t.collections, t.chunks, t.chat_sessions)
    return (out["users"].select(F.lit("users").alias("tbl"), F.col("user_id").alias("item"), F.lit("").alias("owner"))
            .union(out["registry"].select(F.lit("registry"), "doc_id", "user_id"))
            .union(out["chunks"].select(F.lit("chunks"), "chunk_id", F.lit("")))
            .union(out["chat_sessions"].select(F.lit("sessions"), "session_id", F.coalesce("user_id", F.lit("")))))
