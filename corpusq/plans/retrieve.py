"""Questions -> ranked chunks -> prompt messages and sources.

Scopes, questions and candidate lists are written to short tables while the plan is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.config import EngineConfig
from corpusq.functions import validate
from corpusq.operators import context, fusion
from corpusq.operators.cells import CellIndex, cell_topk
from corpusq.operators.lexical import LexicalIndex, bm25_topk
from corpusq.operators.quantised import QuantisedIndex, quantised_topk
from corpusq.operators.scope import resolve_scope
from corpusq.operators.vector import vector_topk
from corpusq.session import keep


@dataclass(frozen=True)
class Store:
    """What retrieval reads: chunks, their vectors, registry and memberships. With `cells`
    approximate search is possible, with `words` keyword search reads no texts."""

    chunks: DataFrame
    vectors: DataFrame
    registry: DataFrame
    collections: DataFrame
    cells: CellIndex | QuantisedIndex | None = None
    words: LexicalIndex | None = None


def retrieve(queries: DataFrame, store: Store, config: EngineConfig = EngineConfig(),
             scores: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank) for every valid query.

    `queries`: query_id, question, vector, top_k, user_id, doc_ids, collection. Hybrid,
    scoped or plain search by configuration, exact or (`search="ann"`, over the store's
    cells) approximate, then optional re-ranking by a score table (query_id, chunk_id,
    score) or by word overlap. Re-ranking fetches three times top_k and keeps rerank_top_n,
    whatever top_k says. Refused queries have no hits; `retrieve_context` reports them.
    """
    if config.search == "ann" and store.cells is None:
        raise ValueError("approximate search needs a store with cells")
    coded = isinstance(store.cells, QuantisedIndex)
    if config.search == "ann" and coded and config.metric != "cosine":
        raise ValueError("codes are searched by cosine only")
    valid = validate.accepted(validate.check_queries(queries, config))
    scopes = resolve_scope(valid, store.registry, store.collections, config).kept()
    factor = fv.RERANK_OVERFETCH if config.rerank_enabled else 1
    # every step below reads the queries again
    asked = keep(scopes.queries.withColumn("top_k", (F.col("top_k") * factor).cast("int")))
    if config.search == "ann" and coded:
        hits = quantised_topk(asked, store.cells, scopes)
    elif config.search == "ann":
        hits = cell_topk(asked, store.cells, config.metric, scopes)
    else:
        hits = vector_topk(asked, store.vectors, config.metric, scopes, config.filter_mode)
    if config.hybrid_enabled:
        found = bm25_topk(asked, store.words or store.chunks, scopes)
        hits = fusion.fuse(found, hits, asked, config.bm25_weight)
    if not config.rerank_enabled:
        return hits
    # short lists, read as candidates and for scoring: search once
    hits = keep(hits)
    if scores is None:
        content = attach_chunks(hits, store.chunks, ["content"])
        asked_text = content.join(asked.select("query_id", "question"), "query_id")
        scores = fusion.overlap_scores(asked_text)
    return fusion.rerank(hits, scores, config.rerank_top_n)


def attach_chunks(hits: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Hits + chunk columns. Few hits are broadcast to the chunks, which are then read once
    and not shuffled; AQE splits the rows of chunks that very many queries hit."""
    return hits.join(chunks.select("chunk_id", *columns), "chunk_id")


def retrieve_context(queries: DataFrame, store: Store, config: EngineConfig = EngineConfig(),
                     histories: DataFrame | None = None,
                     scores: DataFrame | None = None) -> DataFrame:
    """(query_id, question, context, messages, sources, error_code), one row per query.

    Context and sources come from the same retrieval. A query without hits keeps an empty
    context and no sources. A refused query has its error_code, an empty context, no
    messages and no sources.
    """
    hits = keep(retrieve(queries, store, config, scores))
    columns = ["source_file", "page", "chunk_index", "content"]
    full = attach_chunks(hits, store.chunks, columns)
    cited = (full.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", context.source_line(F.col("rank"), F.col("source_file"), F.col("page"),
                                        F.col("content")).alias("line"),
            context.smart_truncate(F.col("content")).alias("snippet"),
            F.coalesce("source_file", F.lit("unknown")).alias("source_file"),
            "chunk_index", "doc_id", "page"))).alias("_hits")))
    asked = validate.check_queries(queries, config)
    if histories is not None:
        asked = context.attach_history(asked, histories)
        past = F.col("history")
    else:
        past = None
    found = asked.join(cited, "query_id", "left")
    rows = F.coalesce("_hits", F.array().cast(cited.schema["_hits"].dataType))
    text = F.array_join(F.transform(rows, lambda h: h["line"]), fv.CONTEXT_DIVIDER)
    sources = F.transform(rows, lambda h: F.struct(
        h["snippet"].alias("content"), h["source_file"].alias("source_file"),
        h["chunk_index"].alias("chunk_index"), h["doc_id"].alias("doc_id"),
        h["page"].alias("page")))
    messages = context.answer_messages(text, F.col("question"), past)
    fine = F.col("error_code").isNull()
    return found.select("query_id", "question", text.alias("context"), F.when(
        fine, messages).otherwise(F.filter(messages, lambda m: F.lit(False))).alias("messages"),
        sources.alias("sources"), "error_code")
