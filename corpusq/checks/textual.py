"""Files, text, chunks, labels, row checks."""

from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.checks.base import check, quote, sql_list, sql_rewrite
from corpusq.checks.derived import sql
from corpusq.functions import chunking, text, validate
from corpusq.functions.embed import embed_column
from corpusq.functions.taxonomy import DOMAINS, PRIMARIES, ALL_WORDS, domain_words, primary_words, taxonomy_text
from corpusq.operators import classify, context
from corpusq.plans.ingest import build_vectors

_STRIP = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


# --- markup -----------------------------------------------------------------------

def _html_sql() -> str:
    e = sql_rewrite("html", text.HTML_STEPS)
    for entity, by in text.HTML_ENTITIES:
        e = f"replace({e}, {quote(entity)}, {quote(by)})"
    return sql_rewrite(e, text.SPACE_STEPS)


@check("s3_html_to_text", f"""SELECT page_id,
    regexp_replace(regexp_extract(html, {quote(text.TITLE_PATTERN)}, 1), {quote(_STRIP)}, '', 'g') AS title,
    {_html_sql()} AS body FROM pages""")
def _(t):
    return t.pages.select("page_id", text.html_title(F.col("html")).alias("title"),
                          text.html_to_text(F.col("html")).alias("body"))


@check("s4_markdown_to_text", f"""SELECT doc_id, {sql_rewrite('md', text.MARKDOWN_STEPS)} AS body FROM (
    SELECT doc_id, '# ' || source || chr(10) || chr(10) || '> **' || lang || '** `x`' || chr(10) || chr(10)
    || '- [' || source || '](http://h.example/' || CAST(doc_id AS VARCHAR) || ')' || chr(10) || '---'
    || chr(10) || text AS md FROM documents)""")
def _(t):
    md = F.concat(F.lit("# "), "source", F.lit("\n\n> **"), "lang", F.lit("** `x`\n\n- ["), "source",
                  F.lit("](http://h.example/"), F.col("doc_id").cast("string"), F.lit(")\n---\n"), "text")
    return t.documents.select("doc_id", text.markdown_to_text(md).alias("body"))


@check("s5_explode_pages", sql("""SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS page,
    unnest(p) AS content FROM (SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS p FROM docs)""",
    "docs"))
def _(t):
    return chunking.explode_pages(t.docs.select(
        "doc_id", chunking.split_pages(F.col("text")).alias("pages")))


# --- names and ids -----------------------------------------------------------------

_NAME_SQL = """source || CASE doc_id % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.tar.gz' WHEN 2 THEN ''
    WHEN 3 THEN '/.hidden' WHEN 4 THEN '.' || lang ELSE '_' || lang || '.Pdf' END"""


def _names(t):
    k = F.col("doc_id") % 6
    return F.concat("source", F.when(k == 0, F.lit(".TXT")).when(k == 1, F.lit(".tar.gz"))
                    .when(k == 2, F.lit("")).when(k == 3, F.lit("/.hidden"))
                    .when(k == 4, F.concat(F.lit("."), "lang"))
                    .otherwise(F.concat(F.lit("_"), "lang", F.lit(".Pdf"))))


@check("p1_file_suffix", f"""SELECT doc_id, CASE WHEN regexp_matches(name, '[^/][.][^./]+$')
    THEN '.' || list_last(string_split(lower(name), '.')) ELSE '' END AS suffix
    FROM (SELECT doc_id, {_NAME_SQL} AS name FROM documents)""".replace(
        "list_last(string_split(lower(name), '.'))", "list_extract(string_split(lower(name), '.'), -1)"))
def _(t):
    return t.documents.select("doc_id", text.file_suffix(_names(t)).alias("suffix"))


@check("p2_derived_doc_id", """SELECT doc_id AS given,
    substr(sha256(length(source) || ':' || source || '|' || length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR)
    || '|' || length(lang) || ':' || lang), 1, 32) AS doc_id FROM documents""")
def _(t):
    return t.documents.select(F.col("doc_id").alias("given"), text.derived_doc_id(
        F.col("source"), F.col("doc_id").cast("string"), F.col("lang")).alias("doc_id"))


@check("p3_content_hash", "SELECT doc_id, sha256(text) AS file_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("file_hash"))


@check("p6_parse_collections", """SELECT doc_id, array_to_string(list_filter(
    [lang, source, lang || 'x'], lambda x: x <> ''), '|') AS collections_csv FROM documents""")
def _(t):
    raw = F.concat(F.lit(" "), "lang", F.lit(", "), "source", F.lit(" ,,\t"), "lang",
                   F.lit(","), "lang", F.lit("x , "))
    return t.documents.select("doc_id", text.collections_csv(
        text.parse_collections(raw)).alias("collections_csv"))


@check("p7_resolve_collections", """SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.lang
    WHEN l.toxic = 0 THEN d.source ELSE 'other' END AS collections_csv
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def _(t):
    d = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    manual = text.parse_collections(F.when(F.col("quality") == 1, F.col("lang")).otherwise(F.lit(" , ")))
    return d.select("doc_id", text.collections_csv(text.resolve_collections(
        manual, F.col("toxic") == 0, F.array("source"))).alias("collections_csv"))


@check("p9_capitalize_name", """SELECT n_nationkey, upper(substr(n, 1, 1)) || lower(substr(n, 2)) AS display_name
    FROM (SELECT n_nationkey, lower(substr(n_name, 1, 1)) || n_name || '-x Y' AS n FROM nation)""")
def _(t):
    name = F.concat(F.lower(F.substring("n_name", 1, 1)), "n_name", F.lit("-x Y"))
    return t.nation.select("n_nationkey", text.capitalize_name(name).alias("display_name"))


@check("p10_slugify_labels", """SELECT doc_id, array_to_string(list_filter(list_concat([replace(trim(lower(source)), ' ', '-'),
    repeat('y', 49) || lang], list_transform(string_split(text, chr(10)), lambda x: replace(replace(replace(lower(
    regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), ' ', '-'), chr(34), ''), chr(39), ''))),
    lambda x: length(x) BETWEEN 1 AND 50), '|') AS labels FROM documents""")
def _(t):
    """All lines of every text as raw labels."""
    raw = F.concat(F.array(F.concat(F.lit("  "), F.upper("source"), F.lit(" ")),
                           F.concat(F.repeat(F.lit("y"), F.lit(49)), "lang")), F.split("text", "\n"), F.array(F.lit(" ")))
    return t.documents.select("doc_id", F.array_join(text.slugify_labels(raw), "|").alias("labels"))


_REPLY_SQL = f"""CASE doc_id % 5
    WHEN 0 THEN '["' || source || '", "Tax Law"]'
    WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '["' || lang || '", "x''y"]' || chr(10) || '```'
    WHEN 2 THEN 'It is "HR personal", maybe ' || list_extract({sql_list(PRIMARIES)}, CAST(doc_id % 11 + 1 AS BIGINT)) || '.'
    WHEN 3 THEN '["' || source
    ELSE source END"""


def _replies(t):
    k, d = F.col("doc_id") % 5, F.col("doc_id")
    primary = F.element_at(F.array(*[F.lit(p) for p in PRIMARIES]), (d % 11 + 1).cast("int"))
    return t.documents.select("doc_id", F.when(
        k == 0, F.concat(F.lit('["'), "source", F.lit('", "Tax Law"]')))
        .when(k == 1, F.concat(F.lit('Sure:\n```json\n["'), "lang", F.lit('", "x\'y"]\n```')))
        .when(k == 2, F.concat(F.lit('It is "HR personal", maybe '), primary, F.lit(".")))
        .when(k == 3, F.concat(F.lit('["'), "source")).otherwise(F.col("source")).alias("reply"))


_FALLBACK_SQL = f"""coalesce(list_extract(list_filter({sql_list(PRIMARIES)}, lambda p: contains(lower(replace(
    regexp_replace(reply, '["''.]', '', 'g'), ' ', '-')), p)), 1), 'other')"""


@check("p11_parse_label_reply", f"""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '|tax-law'
    WHEN 1 THEN lang || '|xy' ELSE {_FALLBACK_SQL} END AS labels
    FROM (SELECT doc_id, source, lang, {_REPLY_SQL} AS reply FROM documents)""")
def _(t):
    return _replies(t).select("doc_id", F.array_join(
        text.parse_label_reply(F.col("reply")), "|").alias("labels"))


@check("p12_fallback_label", f"""SELECT doc_id, {_FALLBACK_SQL} AS label
    FROM (SELECT doc_id, {_REPLY_SQL} AS reply FROM documents)""")
def _(t):
    return _replies(t).select("doc_id", text.fallback_label(F.col("reply")).alias("label"))


_EXCERPT = """SELECT doc_id, substr(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 1, 1500) AS excerpt
    FROM chunks WHERE chunk_index < 3 GROUP BY doc_id"""


@check("p13_classification_excerpt", sql(_EXCERPT, "chunks"))
def _(t):
    return classify.classification_excerpt(t.chunks)


_before, _rest = fv.CLASSIFY_PROMPT.split("{taxonomy_text}")
_middle, _rest = _rest.split("{existing_collections}")
_late, _end = _rest.split("{content}")


@check("p15_classify_prompt", sql(
    f"""SELECT doc_id, {quote(_before + taxonomy_text() + _middle)} || coalesce(names, '(none)') ||
    {quote(_late)} || excerpt || {quote(_end)} AS prompt FROM excerpts LEFT JOIN (SELECT doc_id AS d,
    string_agg(collection, ', ' ORDER BY collection) AS names FROM collections GROUP BY doc_id) ON d = doc_id""",
    "chunks", "collections", excerpts=_EXCERPT))
def _(t):
    from corpusq.operators.registry import collection_lists
    e = classify.classification_excerpt(t.chunks).join(
        collection_lists(t.collections), "doc_id", "left")
    return e.select("doc_id", context.classify_prompt(
        F.col("excerpt"), F.col("collections")).alias("prompt"))


_CUTS = "".join(
    f" WHEN i{n} > 250 THEN substr(text, 1, CAST(i{n} + 1 AS BIGINT))" for n in range(4))
_SPOTS = ", ".join(
    f"CASE WHEN contains(head, {quote(m)}) THEN length(regexp_extract(head, {quote('(?s)^(.*)' + r)}, 1)) ELSE -1 END AS i{n}"
    for n, (m, r) in enumerate(zip(fv.SENTENCE_MARKS, [r"\. ", r"\.\n", "! ", r"\? "])))
TRUNCATE_FROM = f"""(SELECT *, {_SPOTS}, CASE WHEN contains(head, ' ')
    THEN length(regexp_extract(head, '(?s)^(.*) ', 1)) ELSE -1 END AS i4 FROM (SELECT *, substr(text, 1, 500) AS head
    FROM {{source}}))"""
TRUNCATE = f"""CASE WHEN length(text) <= 500 THEN text{_CUTS}
    WHEN i4 > 250 THEN substr(text, 1, CAST(i4 AS BIGINT)) || '...' ELSE head || '...' END"""


@check("p17_smart_truncate",
       f"SELECT doc_id, {TRUNCATE} AS snippet FROM {TRUNCATE_FROM.format(source='documents')}")
def _(t):
    return t.documents.select("doc_id", text.smart_truncate(F.col("text")).alias("snippet"))


@check("p18_project_sources", sql(
    f"""SELECT doc_id, chunk_index, {TRUNCATE} AS content, source_file, -1 AS page FROM
    {TRUNCATE_FROM.format(source='(SELECT doc_id, chunk_index, source_file, content AS text FROM chunks)')}""",
    "chunks"))
def _(t):
    hits = t.chunks.select(F.col("doc_id").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"),
                           "content", "source_file", "chunk_index", "doc_id", "page")
    return context.project_sources(hits).select(
        "doc_id", "chunk_index", "content", "source_file", F.coalesce("page", F.lit(-1)).alias("page"))


@check("p19_iso_timestamp", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS at FROM events""")
def _(t):
    return t.events.select("event_id", text.iso_timestamp(F.col("ts")).alias("at"))


@check("p20_upload_message", """SELECT doc_id, n_chars * 4000 // 1048576 AS megabytes,
    'Document uploaded and indexed successfully' || CASE WHEN doc_id % 2 = 0
    THEN '. AI suggested: ' || lang || ', ' || source ELSE '' END AS message FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", text.size_mb(F.col("n_chars") * 4000).alias("megabytes"),
        text.upload_message(F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source"))).alias("message"))


# --- row checks ----------------------------------------------------------------------

@check("f1_f2_check_uploads", f"""SELECT doc_id, coalesce(CASE WHEN NOT regexp_matches(name, '[^/][.][^./]+$')
    OR NOT list_contains({sql_list(fv.SUPPORTED_SUFFIXES)}, '.' || list_extract(string_split(lower(name), '.'), -1))
    THEN 400 END, CASE WHEN n_chars * 20000 > 52428800 THEN 413 END, 0) AS error_code
    FROM (SELECT doc_id, n_chars, {_NAME_SQL} AS name FROM documents)""")
def _(t):
    u = t.documents.select("doc_id", _names(t).alias("filename"), (F.col("n_chars") * 20000).alias("n_bytes"))
    return validate.check_uploads(u).select("doc_id", F.coalesce("error_code", F.lit(0)).alias("error_code"))


@check("f3_f4_check_queries", """SELECT doc_id, CASE WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 422
    WHEN coalesce(k, 4) NOT BETWEEN 1 AND 20 THEN 422 ELSE 0 END AS error_code, coalesce(k, 4) AS top_k
    FROM (SELECT doc_id, text, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 25 - 2 END AS k FROM documents)""")
def _(t):
    q = t.documents.select("doc_id", F.col("text").alias("question"), F.when(
        F.col("doc_id") % 7 != 0, F.col("doc_id") % 25 - 2).cast("int").alias("top_k"))
    return validate.check_queries(q).select(
        "doc_id", F.coalesce("error_code", F.lit(0)).alias("error_code"), "top_k")


@check("f5_user_error", """SELECT doc_id, CASE WHEN regexp_full_match(u, '[a-zA-Z0-9_-]+') AND length(u) BETWEEN 1 AND 50
    AND length(text) BETWEEN 1 AND 100 THEN 0 ELSE 422 END AS error_code
    FROM (SELECT doc_id, text, source || CASE doc_id % 4 WHEN 0 THEN '-a_B' WHEN 1 THEN ' x' WHEN 2 THEN repeat('z', 47)
    ELSE 'é' END AS u FROM documents)""")
def _(t):
    k = F.col("doc_id") % 4
    u = F.concat("source", F.when(k == 0, F.lit("-a_B")).when(k == 1, F.lit(" x"))
                 .when(k == 2, F.repeat(F.lit("z"), F.lit(47))).otherwise(F.lit("é")))
    return t.documents.select("doc_id", F.coalesce(
        validate.user_error(u, F.col("text")), F.lit(0)).alias("error_code"))


@check("f6_collections_error", """SELECT doc_id, CASE WHEN quality = 1 THEN 0 ELSE 422 END AS error_code FROM labels""")
def _(t):
    raw = F.when(F.col("quality") == 1, F.lit("a, b")).otherwise(F.lit(" ,, "))
    return t.labels.select("doc_id", F.coalesce(
        validate.collections_error(text.parse_collections(raw)), F.lit(0)).alias("error_code"))


@check("f7_role_error", """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai'
    ELSE role END AS role, CASE WHEN role IN ('user', 'assistant') THEN 0 ELSE 422 END AS error_code FROM conversations""")
def _(t):
    role = validate.map_role(F.col("role"))
    return t.conversations.select("conv_id", "turn", role.alias("role"), F.coalesce(
        validate.role_error(role), F.lit(0)).alias("error_code"))


@check("f8_length_error", """SELECT doc_id, CASE WHEN length(text) > 500 THEN 422 ELSE 0 END AS error_code FROM documents""")
def _(t):
    r = t.docs.select("doc_id", F.col("text").alias("filename"), F.lit(".txt").alias("file_type"),
                      F.col("source").alias("user_id"))
    return r.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(
        validate.length_error(r, "registry"), F.lit(0)).alias("error_code"))


# --- chunks ----------------------------------------------------------------------------

@check("c2_chunk_fixed", sql("SELECT chunk_id, doc_id, chunk_index, content FROM chunks", "chunks"))
def _(t):
    return t.chunks.select("chunk_id", "doc_id", "chunk_index", "content")


@check("c1_chunk_recursive")
def _(t):
    """Whole documents, split at the coarsest separators that fit."""
    docs = t.docs.select("doc_id", chunking.chunk_recursive(F.col("text")).alias("chunks"))
    return chunking.explode_chunks(docs)


@check("w1_number_across_pages", sql("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, p) - 1
    AS chunk_index, page, substr(body, CAST(p + 1 AS BIGINT), 300) AS content FROM (
    SELECT doc_id, page, body, unnest(range(0, greatest(length(body) - 60 - 1, 0) + 1, 240)) AS p FROM (
    SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS page, unnest(s) AS body FROM (
    SELECT doc_id, string_split_regex(text, '\\n[ \\t]*\\n') AS s FROM docs)) WHERE length(body) > 0)""", "docs"))
def _(t):
    pages = F.transform(chunking.split_pages(F.col("text")), lambda p: chunking.chunk_fixed(p, 300, 60))
    return chunking.number_across_pages(t.docs.select("doc_id", pages.alias("chunks")), "chunks")


@check("e1_embed_column")
def _(t):
    """Every document text as a unit vector."""
    return embed_column(t.docs.select("doc_id", "text"), "text").select(
        "doc_id", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double"), 6).cast("string")), ",").alias("embedding"))


@check("e1_build_vectors", sql("""SELECT chunk_id, doc_id, 256 AS dims,
    CAST(CASE WHEN len(list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '')) = 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) AS norm
    FROM chunks""", "chunks"))
def _(t):
    """Length and norm of every chunk's vector."""
    return build_vectors(t.chunks).select("chunk_id", "doc_id", F.size("embedding").alias("dims"),
                                          F.round("norm", 4).alias("norm"))


# --- classification ----------------------------------------------------------------------

def _labels_sql() -> str:
    """Scores per primary and domain from shared words, best first by taxonomy order."""
    primaries = ", ".join(f"({i}, {quote(p)}, {sql_list(primary_words(p))})"
                          for i, p in enumerate(PRIMARIES) if p != "other")
    domains = ", ".join(f"({j}, {quote(p)}, {quote(d)}, {sql_list(domain_words(p, d))})"
                        for j, (p, d) in enumerate(DOMAINS))
    return f"""words AS (SELECT doc_id, list_distinct(string_split_regex(lower(excerpt), '[^a-z]+')) AS w FROM excerpts),
    pri(i, p, ws) AS (VALUES {primaries}), dom(j, p, d, ws) AS (VALUES {domains}),
    best AS (SELECT doc_id, p FROM (SELECT doc_id, p, len(list_intersect(w, ws)) AS n, row_number() OVER (
        PARTITION BY doc_id ORDER BY len(list_intersect(w, ws)) DESC, i) AS r FROM words, pri) WHERE r = 1 AND n > 0),
    doms AS (SELECT doc_id, d, r FROM (SELECT b.doc_id, d, len(list_intersect(w, ws)) AS n, row_number() OVER (
        PARTITION BY b.doc_id ORDER BY len(list_intersect(w, ws)) DESC, j) AS r
        FROM best b JOIN dom ON dom.p = b.p JOIN words ON words.doc_id = b.doc_id) WHERE n > 0 AND r <= 2),
    labels_of AS (SELECT e.doc_id, CASE WHEN p IS NULL THEN 'other' ELSE p || coalesce('|' || ds, '') END AS labels
        FROM excerpts e LEFT JOIN best b ON b.doc_id = e.doc_id LEFT JOIN (SELECT doc_id,
        string_agg(d, '|' ORDER BY r) AS ds FROM doms GROUP BY doc_id) x ON x.doc_id = e.doc_id)"""


_TOPICS = sql_list([w for w in ALL_WORDS])
# Three taxonomy words, chosen by document number, are planted in front of each text.
_PLANTED = f"""SELECT doc_id || '_chunk_0' AS chunk_id, doc_id, 0 AS chunk_index,
    list_extract({_TOPICS}, CAST(CAST(doc_id AS BIGINT) % {len(ALL_WORDS)} + 1 AS BIGINT)) || ' ' ||
    list_extract({_TOPICS}, CAST(CAST(doc_id AS BIGINT) * 7 % {len(ALL_WORDS)} + 1 AS BIGINT)) || ' ' ||
    list_extract({_TOPICS}, CAST(CAST(doc_id AS BIGINT) * 13 % {len(ALL_WORDS)} + 1 AS BIGINT)) || '. ' || text AS content FROM docs"""


def planted_chunks(t):
    topics = F.array(*[F.lit(w) for w in ALL_WORDS])
    d = F.col("doc_id").cast("bigint")

    def word(k):
        return F.element_at(topics, (d * k % len(ALL_WORDS) + 1).cast("int"))

    return t.docs.select(
        text.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"),
        F.concat(word(1), F.lit(" "), word(7), F.lit(" "), word(13), F.lit(". "), "text").alias("content"))


_CLASSIFY_WITH = (f"WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents), "
                  f"planted AS ({_PLANTED}), excerpts AS (SELECT doc_id, substr(content, 1, 1500) AS excerpt FROM planted), "
                  + _labels_sql())


@check("t1_classify_documents", _CLASSIFY_WITH + " SELECT doc_id, labels FROM labels_of")
def _(t):
    return classify.classify_documents(planted_chunks(t)).select(
        "doc_id", F.array_join("labels", "|").alias("labels"))


@check("t2_reclassify", _CLASSIFY_WITH + """, req AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM labels
    WHERE quality = 0) SELECT doc_id, unnest(string_split(labels, '|')) AS collection FROM labels_of
    WHERE doc_id IN (SELECT doc_id FROM req) UNION ALL SELECT CAST(doc_id AS VARCHAR), lang FROM documents
    WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT doc_id FROM req)""")
def _(t):
    """Documents of low quality are labelled again; all others keep their language."""
    requests = t.labels.where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    current = t.docs.select("doc_id", F.col("lang").alias("collection"))
    chunks = planted_chunks(t).withColumn("extra", F.create_map().cast("map<string,string>"))
    return classify.reclassify(requests, t.registry, current, chunks, isolated=False)["document_collections"]
