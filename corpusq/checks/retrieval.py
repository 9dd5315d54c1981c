"""Search, fusion, re-ranking, context."""

from dataclasses import replace

from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.checks.base import check, quote
from corpusq.checks.derived import sql
from corpusq.checks.textual import TRUNCATE, TRUNCATE_FROM
from corpusq.config import EngineConfig
from corpusq.functions.validate import accepted, check_queries
from corpusq.operators import cells, context, lexical, quantised, vector
from corpusq.operators.chat import session_history
from corpusq.operators.scope import resolve_scope
from corpusq.plans.retrieve import Store, retrieve, retrieve_context
from corpusq.session import keep

_HITS = ["query_id", "chunk_id", "score", "rank"]


def _ranked(scored: str, k: str = "top_k") -> str:
    return f"""SELECT query_id, chunk_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, chunk_id) AS r FROM ({scored})) WHERE r <= {k}"""


def _dense(metric: str) -> str:
    f = {"cosine": "list_cosine_similarity(v, e)", "dot": "list_dot_product(v, e)",
         "l2": "0.0 - list_distance(v, e)"}[metric]
    return sql(_ranked(f"""SELECT query_id, chunk_id, top_k, round({f}, 6) AS score
        FROM vector_queries, vectors"""), "vectors", "vector_queries")


@check("r1_k2_vector_topk", _dense("cosine"))
def _(t):
    return vector.vector_topk(t.vector_queries, t.vectors).select(*_HITS)


@check("r1_vector_topk_l2", _dense("l2"))
def _(t):
    return vector.vector_topk(t.vector_queries, t.vectors, "l2").select(*_HITS)


@check("r1_vector_topk_dot", _dense("dot"))
def _(t):
    return vector.vector_topk(t.vector_queries, t.vectors, "dot").select(*_HITS)


@check("k1_nearest", sql(f"""SELECT chunk_id, doc_id, round(list_cosine_similarity(e, {[1.0] * 64}), 6) AS score
    FROM vectors ORDER BY score DESC, chunk_id LIMIT 10""", "vectors"))
def _(t):
    return vector.nearest(t.vectors, [1.0] * 64, 10)


def _cells(vectors, n=16, probes=12):
    model = cells.train_cells(vectors, n)
    return cells.CellIndex(cells.cell_index(vectors, model), model, probes)


def _true_cosine():
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y),
                                   F.lit(0.0), lambda s, x: s + x)
    v, e = F.col("v"), F.col("e")
    return dot(v, e) / F.sqrt(dot(v, v) * dot(e, e))


def _judged(t, found):
    """One row: number of queries, wrong scores, whether recall is 0.9 at least."""
    exact = vector.vector_topk(t.vector_queries, t.vectors)
    recall = vector.recall(found, exact).agg(F.avg("recall").alias("r"))
    pair = found.join(t.vectors.select("chunk_id", F.col("embedding").alias("e")), "chunk_id").join(
        t.vector_queries.select("query_id", F.col("vector").alias("v")), "query_id")
    wrong = pair.agg(F.count_if(F.abs(_true_cosine() - F.col("score")) > 1e-6).alias("wrong_scores"))
    size = t.vectors.agg(F.count(F.lit(1)).alias("queries"))
    return size.crossJoin(wrong).crossJoin(recall.select((F.col("r") >= 0.9).alias("recall_is_high")))


@check("r8_cell_topk", sql("""SELECT (SELECT count(*) FROM embeddings) AS queries, 0 AS wrong_scores, true AS recall_is_high,
    true AS reads_less"""))
def _(t):
    """Approximate neighbours of every vector from an index by cells: all scores are the exact
    cosine, recall is at least 0.9 with three quarters of the cells probed (these vectors have
    no clusters), and fewer pairs than all are scored."""
    index = _cells(t.vectors)
    found = keep(cells.cell_topk(t.vector_queries, index))
    probed = cells.probed_cells(t.vector_queries, index).groupBy("scope_id").agg(F.count(F.lit(1)).alias("q"))
    held = index.rows.groupBy(F.col("cell").cast("string").alias("scope_id")).agg(F.count(F.lit(1)).alias("n"))
    pairs = probed.join(held, "scope_id").agg(F.sum(F.col("q") * F.col("n")).alias("pairs"))
    return _judged(t, found).crossJoin(pairs).select(
        "queries", "wrong_scores", "recall_is_high",
        (F.col("pairs") < 0.95 * F.col("queries") * F.col("queries")).alias("reads_less"))


@check("r8_ann_topk", _dense("cosine"))
def _(t):
    """Hits over product-quantised residuals, scored exactly wherever the bound of a code's error
    leaves a vector among the best: the rows of exact search at every size."""
    return quantised.quantised_topk(t.vector_queries, _quantised(t.vectors)).select(*_HITS)


@check("r8_ann_recall", sql("""SELECT (SELECT count(*) FROM embeddings) AS queries, 0 AS wrong_scores, true AS recall_is_high,
    true AS scores_less"""))
def _(t):
    """The same, judged: recall 0.9 at least, all scores the exact cosine; less than a third of
    all pairs is scored exactly, as tasks count them."""
    scored = t.spark.sparkContext.accumulator(0)
    found = keep(quantised.quantised_topk(t.vector_queries, _quantised(t.vectors), counted=scored))
    return _judged(t, found).select("*", (F.lit(scored.value) < F.col("queries") * F.col("queries") / 3).alias(
        "scores_less"))


def _quantised(vectors):
    return quantised.quantise(vectors, quantised.fit(vectors))


@check("r8_e4_ann_retrieve", sql("""SELECT count(*) AS queries, 0 AS outside, true AS most_hit FROM valid_passage_queries""",
    "docs", "vectors", "passages", "passage_queries", "valid_passage_queries"))
def _(t):
    """Retrieval over the codes of the store, for every chunk: no hit lies outside its question's
    scope, and there are hits for all questions that are not held to a few ids."""
    config = EngineConfig(search="ann", isolation="none")
    store = replace(_store(t), cells=_quantised(t.passage_vectors))
    hits = keep(retrieve(t.passage_queries, store, config))
    q = accepted(check_queries(t.passage_queries))
    s = resolve_scope(q, t.registry, t.collections, config)
    placed = hits.join(s.queries.where("scope_id is not null").select("query_id", "scope_id"), "query_id")
    outside = placed.join(s.docs, ["scope_id", "doc_id"], "left_anti").agg(F.count(F.lit(1)).alias("outside"))
    free = s.queries.where("scope_id is null or coalesce(size(doc_ids), 0) = 0").select("query_id")
    most = free.join(hits.select("query_id").distinct(), "query_id", "left_anti").agg(
        (F.count(F.lit(1)) == 0).alias("most_hit"))
    return q.agg(F.count(F.lit(1)).alias("queries")).crossJoin(outside).crossJoin(most)


_ALLOWED = """(EXISTS (SELECT 1 FROM registry r WHERE r.doc_id = p.doc_id AND r.user_id = q.user_id)
    AND (q.collection IS NULL OR EXISTS (SELECT 1 FROM collections c WHERE c.doc_id = p.doc_id AND c.collection = q.collection)))"""
_LISTED = f"({_ALLOWED} AND (q.doc_ids IS NULL OR list_contains(q.doc_ids, p.doc_id)))"
_PRE = _ranked(f"""SELECT query_id, chunk_id, top_k, round(list_cosine_similarity(v, e), 6) AS score
    FROM valid_passage_queries q, passages p WHERE {_LISTED}""")
_PASSAGE_CTES = ("docs", "registry", "collections", "vectors", "passages", "passage_queries", "valid_passage_queries")


def _scoped(t, mode):
    q = accepted(check_queries(t.passage_queries))
    s = resolve_scope(q, t.registry, t.collections)
    return vector.vector_topk(s.queries, t.passage_vectors, scopes=s, mode=mode).select(*_HITS)


@check("r2_k3_vector_topk_pre", sql(_PRE, *_PASSAGE_CTES))
def _(t):
    return _scoped(t, "pre")


@check("r2_k4_vector_topk_post", sql(_ranked(f"""SELECT w.* FROM wide w JOIN valid_passage_queries q USING (query_id)
    JOIN passages p ON p.chunk_id = w.chunk_id WHERE {_LISTED}"""), *_PASSAGE_CTES,
    wide="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS n FROM (
    SELECT query_id, chunk_id, top_k, round(list_cosine_similarity(v, e), 6) AS score FROM valid_passage_queries, passages))
    WHERE n <= 5 * top_k"""))
def _(t):
    return _scoped(t, "post")


# --- BM25 ---------------------------------------------------------------------------------

_TOKENS = "SELECT chunk_id, doc_id, list_filter(string_split_regex(lower(content), '\\s+'), lambda x: x <> '') AS w FROM {chunks}"


def _bm25(queries: str, chunks: str, allowed: str | None, factor: int = 1) -> dict[str, str]:
    """CTEs ending in `lex` (query_id, chunk_id, score, rank)."""
    scope = "q.query_id" if allowed else "0"
    member = (f"SELECT q.query_id AS sid, p.chunk_id FROM {queries} q, {chunks} p WHERE {allowed}" if allowed
              else f"SELECT 0 AS sid, chunk_id FROM {chunks}")
    return dict(
        tok=_TOKENS.format(chunks=chunks),
        post="SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM tok) GROUP BY 1, 2",
        dl="SELECT chunk_id, len(w) AS dl FROM tok",
        member=member,
        sizes="SELECT sid, count(*) AS n, avg(dl) AS mean FROM member JOIN dl USING (chunk_id) GROUP BY 1",
        qt=f"""SELECT query_id, top_k, sid, term, count(*) AS qtf FROM (SELECT query_id, top_k, {scope} AS sid, unnest(list_filter(
            string_split_regex(lower(question), '\\s+'), lambda x: x <> '')) AS term FROM {queries} q) GROUP BY 1, 2, 3, 4""",
        hit="""SELECT query_id, top_k, sid, chunk_id, term, tf, qtf FROM qt JOIN post USING (term)
            SEMI JOIN member ON member.sid = qt.sid AND member.chunk_id = post.chunk_id""",
        df="SELECT sid, term, count(DISTINCT chunk_id) AS df FROM hit GROUP BY 1, 2",
        lex_scored="""SELECT query_id, top_k, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 /
            (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM hit JOIN df USING (sid, term) JOIN sizes USING (sid)
            JOIN dl USING (chunk_id) GROUP BY 1, 2, 3""",
        lex=_ranked("SELECT * FROM lex_scored", f"{factor} * top_k"))


_BENCH_Q = "SELECT query_id, question, top_k, user_id, collection, doc_ids FROM scoped_queries WHERE length(question) BETWEEN 1 AND 2000"


@check("r3_j6_bm25_topk", sql("SELECT * FROM lex", "chunks", "scoped_queries",
                              bq=_BENCH_Q, **_bm25("bq", "chunks", None)))
def _(t):
    q = accepted(check_queries(t.scoped_queries))
    return lexical.bm25_topk(q, t.chunks).select(*_HITS)


@check("r3_a8_bm25_topk_scoped", sql("SELECT * FROM lex", "chunks", "registry", "collections", "scoped_queries",
                                     bq=_BENCH_Q, **_bm25("bq", "chunks", _LISTED)))
def _(t):
    q = accepted(check_queries(t.scoped_queries))
    s = resolve_scope(q, t.registry, t.collections)
    return lexical.bm25_topk(s.queries, t.chunks, s).select(*_HITS)


@check("a8_term_frequencies", sql("""SELECT term, count(DISTINCT chunk_id) AS df FROM (SELECT chunk_id, unnest(w) AS term
    FROM tok) GROUP BY 1""", "chunks", tok=_TOKENS.format(chunks="chunks")))
def _(t):
    return lexical.term_frequencies(t.chunks)


@check("a8_postings", sql("SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM tok) GROUP BY 1, 2",
                          "chunks", tok=_TOKENS.format(chunks="chunks")))
def _(t):
    return lexical.postings(t.chunks).select("term", "chunk_id", "tf")


@check("a8_corpus_size", sql("SELECT count(*) AS n_chunks, round(avg(len(w)), 6) AS mean_length FROM tok",
                             "chunks", tok=_TOKENS.format(chunks="chunks")))
def _(t):
    return lexical.corpus_size(t.chunks).withColumn("mean_length", F.round("mean_length", 6))


# --- strategies ---------------------------------------------------------------------------

def _store(t):
    return Store(t.passage_store, t.passage_vectors, t.registry, t.collections)


def _fused(factor: int) -> dict[str, str]:
    return dict(
        **_bm25("valid_passage_queries", "passages", _LISTED, factor),
        vec=_ranked(f"""SELECT query_id, chunk_id, top_k, round(list_cosine_similarity(v, e), 6) AS score
            FROM valid_passage_queries q, passages p WHERE {_LISTED}""", f"{factor} * top_k"),
        votes="""SELECT query_id, chunk_id, 0.5 / (60 + rank) AS vote FROM lex UNION ALL
            SELECT query_id, chunk_id, 0.5 / (60 + rank) FROM vec""",
        fused_scored="SELECT query_id, chunk_id, round(sum(vote), 6) AS score, any_value(top_k) AS top_k "
                     "FROM votes JOIN valid_passage_queries USING (query_id) GROUP BY 1, 2",
        fused=_ranked("SELECT * FROM fused_scored", f"{factor} * top_k"))


def _overlap(hits: str) -> dict[str, str]:
    return dict(
        over=f"""SELECT h.query_id, h.chunk_id, h.rank AS before, round(CAST(len(list_intersect(qw, list_distinct(pw))) AS DOUBLE)
            / greatest(len(qw), 1), 6) AS score FROM {hits} h JOIN (SELECT query_id, list_distinct(list_filter(
            string_split_regex(lower(question), '\\s+'), lambda x: x <> '')) AS qw FROM valid_passage_queries) USING (query_id)
            JOIN (SELECT chunk_id, string_split_regex(lower(content), '\\s+') AS pw FROM passages) USING (chunk_id)""",
        reranked="""SELECT query_id, chunk_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY score DESC, before, chunk_id) AS r FROM over) WHERE r <= 4""")


@check("r6_retrieve_plain", sql(_PRE, *_PASSAGE_CTES))
def _(t):
    return retrieve(t.passage_queries, _store(t)).select(*_HITS)


@check("r3_bm25_topk_stored_statistics", sql("SELECT * FROM lex", "chunks", "scoped_queries",
                                             bq=_BENCH_Q, **_bm25("bq", "chunks", None)))
def _(t):
    """Postings and statistics are index tables; no text is read."""
    q = accepted(check_queries(t.scoped_queries))
    stats = lexical.stored_statistics(lexical.term_frequencies(t.chunks), lexical.corpus_size(t.chunks))
    index = lexical.LexicalIndex(keep(lexical.postings(t.chunks)), lexical.chunk_lengths(t.chunks))
    return lexical.bm25_topk(q, index, statistics=stats).select(*_HITS)


@check("r4_hybrid_topk", sql("SELECT * FROM fused", *_PASSAGE_CTES, **_fused(1)))
def _(t):
    return retrieve(t.passage_queries, _store(t), EngineConfig(hybrid_enabled=True)).select(*_HITS)


@check("r5_k5_rerank", sql("SELECT * FROM reranked", *_PASSAGE_CTES, vec3=_PRE.replace("r <= top_k", "r <= 3 * top_k"),
                           **_overlap("vec3")))
def _(t):
    return retrieve(t.passage_queries, _store(t), EngineConfig(rerank_enabled=True)).select(*_HITS)


@check("r6_retrieve_hybrid_rerank", sql("SELECT * FROM reranked", *_PASSAGE_CTES, **_fused(3), **_overlap("fused")))
def _(t):
    return retrieve(t.passage_queries, _store(t),
                    EngineConfig(hybrid_enabled=True, rerank_enabled=True)).select(*_HITS)


_UNSCOPED = _ranked("""SELECT query_id, chunk_id, top_k, round(list_cosine_similarity(v, e), 6) AS score
    FROM valid_passage_queries q, passages p WHERE (q.collection IS NULL OR EXISTS (SELECT 1 FROM collections c
    WHERE c.doc_id = p.doc_id AND c.collection = q.collection)) AND (q.doc_ids IS NULL OR list_contains(q.doc_ids, p.doc_id))""")


@check("r6_retrieve_open", sql(_UNSCOPED, *_PASSAGE_CTES))
def _(t):
    """Without isolation only a collection or an id list restricts; the others search everything."""
    return retrieve(t.passage_queries, _store(t), EngineConfig(isolation="none")).select(*_HITS)


# --- context --------------------------------------------------------------------------------

@check("p16_format_context", sql("""SELECT session_id AS query_id, string_agg('[Source ' || CAST(i AS VARCHAR) || ': ' || role ||
    CASE WHEN second % 3 = 0 THEN ' (p.' || CAST(second + 1 AS VARCHAR) || ')' ELSE '' END || ']' || chr(10) || content,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i) AS context FROM (SELECT *, second + 1 AS i FROM messages)
    GROUP BY 1""", "messages"))
def _(t):
    turn = F.unix_seconds("created_at") - F.unix_seconds(t.day0)
    hits = t.messages.select(
        F.col("session_id").alias("query_id"), (turn + 1).alias("rank"), F.col("role").alias("source_file"),
        F.when(turn % 3 == 0, turn).alias("page"), "content")
    return context.format_context(hits)


_head, _tail = fv.ANSWER_PROMPT.split("{context}")
_CONTEXT_SQL = dict(
    hits="SELECT h.*, p.doc_id, p.source_file, p.content AS text FROM ranked h JOIN passages p USING (chunk_id)",
    cited=f"""SELECT query_id, string_agg('[Source ' || CAST(rank AS VARCHAR) || ': ' || source_file || ']' || chr(10) || text,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context,
        string_agg(source_file || ':' || {TRUNCATE}, '|' ORDER BY rank) AS sources
        FROM {TRUNCATE_FROM.format(source='hits')} GROUP BY 1""")


def _context_rows(df):
    return df.where(F.col("error_code").isNull()).select(
        "query_id",
        F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("prompt"),
        F.array_join(F.transform("sources", lambda s: F.concat(s["source_file"], F.lit(":"), s["content"])), "|").alias("sources"))


@check("r7_p15_retrieve_context", sql(
    f"""SELECT query_id, 'system: ' || {quote(_head)} || coalesce(context, '') || {quote(_tail)} || chr(10) || 'human: ' || question
    AS prompt, coalesce(sources, '') AS sources FROM valid_passage_queries LEFT JOIN cited USING (query_id)""",
    *_PASSAGE_CTES, ranked=_PRE, **_CONTEXT_SQL))
def _(t):
    return _context_rows(retrieve_context(t.passage_queries, _store(t)))


@check("r7_j10_retrieve_context_chat", sql(
    f"""SELECT query_id, 'system: ' || {quote(_head)} || coalesce(context, '') || {quote(_tail)} || chr(10) || coalesce(past || chr(10), '')
    || 'human: ' || question AS prompt, coalesce(sources, '') AS sources FROM valid_passage_queries q
    LEFT JOIN cited USING (query_id) LEFT JOIN (SELECT session_id, string_agg(role || ': ' || content, chr(10) ORDER BY second, id) AS past
    FROM chat_messages JOIN chat_sessions USING (session_id) WHERE last_second >= 3600 GROUP BY 1) h ON h.session_id = q.query_id""",
    *_PASSAGE_CTES, "chat_messages", "chat_sessions",
    **{**_fused(1), "ranked": "SELECT * FROM fused", **_CONTEXT_SQL}))
def _(t):
    """Hybrid retrieval with the history of the session named like the query."""
    now = F.timestamp_seconds(F.unix_seconds(t.day0) + 7200)
    past = session_history(t.chat_sessions, t.chat_messages, now).drop("user_id")
    queries = t.passage_queries.withColumn("session_id", F.col("query_id"))
    return _context_rows(retrieve_context(queries, _store(t), EngineConfig(hybrid_enabled=True), past))


@check("r7_rejected_queries", sql("""SELECT query_id, CASE WHEN length(question) BETWEEN 1 AND 2000 AND top_k + 8 <= 20
    THEN NULL ELSE 422 END AS error_code, CASE WHEN length(question) BETWEEN 1 AND 2000 AND top_k + 8 <= 20 THEN 2 ELSE 0
    END AS messages FROM passage_queries""", "docs", "vectors", "passages", "passage_queries"))
def _(t):
    """Every question has a row; those asking for too much are refused, not cut."""
    asked = t.passage_queries.withColumn("top_k", F.col("top_k") + 8)
    return retrieve_context(asked, _store(t)).select("query_id", "error_code", F.size("messages").alias("messages"))
