"""Ranked chunks -> cited context, prompt messages and source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq import fixed_values as fv
from corpusq.functions.taxonomy import taxonomy_text
from corpusq.functions.text import smart_truncate, source_line


def format_context(hits: DataFrame) -> DataFrame:
    """(query_id, context). `hits`: query_id, rank, source_file, page, content; a query
    has no more hits than its top_k, so its list is short."""
    line = source_line(F.col("rank"), F.col("source_file"), F.col("page"), F.col("content"))
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), fv.CONTEXT_DIVIDER).alias("context"))


def project_sources(hits: DataFrame) -> DataFrame:
    """Hits as citations: snippet, file, chunk number, document, page."""
    return hits.select(
        "query_id", "rank",
        smart_truncate(F.col("content")).alias("content"),
        F.coalesce("source_file", F.lit("unknown")).alias("source_file"),
        "chunk_index", "doc_id", "page")


def source_lists(hits: DataFrame) -> DataFrame:
    """(query_id, sources ARRAY<STRUCT>) in rank order."""
    cols = ["rank", "content", "source_file", "chunk_index", "doc_id", "page"]
    return project_sources(hits).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*cols))).alias("sources"))


def _fill(template: str, **fields: Column) -> Column:
    """Template with {name} places -> column; field values are never re-read."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), F.coalesce(fields[name], F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def answer_messages(context: Column, question: Column, history: Column | None = None) -> Column:
    """ARRAY<STRUCT<role, content>>: instructions with context, past turns, question."""
    first = F.array(_message("system", _fill(fv.ANSWER_PROMPT, context=context)))
    last = F.array(_message("human", question))
    if history is None:
        return F.concat(first, last)
    past = F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(first, past, last)


def classify_prompt(excerpt: Column, existing: Column) -> Column:
    """Classification prompt; `existing` lists the collections already in use."""
    known = F.when(F.size(existing) > 0, F.array_join(existing, ", ")).otherwise(
        F.lit(fv.NO_COLLECTIONS_TEXT))
    return _fill(fv.CLASSIFY_PROMPT, taxonomy_text=F.lit(taxonomy_text()),
                 existing_collections=known, content=excerpt)


def attach_history(queries: DataFrame, histories: DataFrame) -> DataFrame:
    """Queries + `history` of their session (NULL without one).

    `histories` has one short list per session (see chat.session_history)."""
    from corpusq.operators.skew import lookup_join
    keys = ["session_id"]
    if "user_id" in histories.columns and "user_id" in queries.columns:
        keys = ["user_id", "session_id"]
    return lookup_join(queries, histories.select(*keys, "history"), keys, spread="query_id")
