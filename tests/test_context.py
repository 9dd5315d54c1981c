"""Prompts, citations and the whole retrieval plan."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusq.config import EngineConfig
from corpusq.operators import context
from corpusq.operators import cells
from corpusq.plans.retrieve import Store, retrieve, retrieve_context


@pytest.fixture(scope="module")
def store(spark):
    docs = [("a", "ann", "alpha beta", [1.0, 0.0]), ("b", "ann", "alpha gamma", [0.8, 0.6]),
            ("c", "bob", "alpha", [1.0, 0.1]), ("d", "bob", "{context} {question}", [0.0, 1.0])]
    df = spark.createDataFrame(docs, "doc_id string, user_id string, content string, embedding array<float>")
    chunks = df.select(F.concat("doc_id", F.lit("_chunk_0")).alias("chunk_id"), "doc_id", F.lit(0).alias("chunk_index"),
                       F.when(F.col("doc_id") == "b", F.lit(2)).alias("page"),
                       F.when(F.col("doc_id") != "d", F.concat("doc_id", F.lit(".txt"))).alias("source_file"), "content")
    vectors = df.select(F.concat("doc_id", F.lit("_chunk_0")).alias("chunk_id"), "doc_id", "embedding")
    return Store(chunks, vectors, df.select("doc_id", "user_id"),
                 spark.createDataFrame([("a", "x")], "doc_id string, collection string"))


QUERIES = "query_id string, question string, vector array<float>, top_k int, user_id string, doc_ids array<string>, collection string, session_id string"


def asked(spark, *rows):
    return spark.createDataFrame(rows, QUERIES)


def test_format_context(spark):
    hits = spark.createDataFrame([("q", 2, None, None, "two"), ("q", 1, "f.pdf", 0, "one")],
                                 "query_id string, rank int, source_file string, page int, content string")
    assert context.format_context(hits).first().context == "[Source 1: f.pdf (p.1)]\none\n\n---\n\n[Source 2: unknown]\ntwo"


def test_retrieve_context(spark, store):
    q = asked(spark, ("1", "beta", [1.0, 0.0], 2, "ann", None, None, None), ("2", "x", [0.0, 1.0], 1, "bob", None, None, "s"),
              ("3", "y", [1.0, 0.0], 4, "eve", None, None, None), ("bad", "", [1.0, 0.0], 4, "ann", None, None, None),
              ("bad2", "x", [1.0, 0.0], 21, "ann", None, None, None))
    past = spark.createDataFrame([("s", [("human", "before"), ("ai", "yes")])],
                                 "session_id string, history array<struct<role:string,content:string>>")
    got = {r.query_id: r for r in retrieve_context(q, store, histories=past).collect()}
    refused = {k: v for k, v in got.items() if v.error_code}
    assert {"bad2"} <= set(refused) and set(got) - set(refused) == {"1", "2", "3"}
    assert all((r.error_code, r.context, r.messages, r.sources) == (422, "", [], []) for r in refused.values())
    assert got["1"].context == "[Source 1: a.txt]\nalpha beta\n\n---\n\n[Source 2: b.txt (p.3)]\nalpha gamma"
    assert [(s.doc_id, s.page, s.content) for s in got["1"].sources] == [("a", None, "alpha beta"), ("b", 2, "alpha gamma")]
    assert [m.role for m in got["1"].messages] == ["system", "human"]
    assert [m.role for m in got["2"].messages] == ["system", "human", "ai", "human"]
    assert "[Source 1: unknown]\n{context} {question}" in got["2"].messages[0].content
    assert got["2"].messages[-1].content == "x"
    assert got["3"].sources == [] and got["3"].context == ""
    assert got["3"].messages[0].content.endswith("Context:\n\n")


@pytest.mark.parametrize("config", [EngineConfig(), EngineConfig(hybrid_enabled=True), EngineConfig(filter_mode="post"),
                                    EngineConfig(rerank_enabled=True), EngineConfig(isolation="none"), EngineConfig(search="ann")])
def test_owner_never_sees_others(spark, store, config):
    q = asked(spark, ("1", "alpha", [1.0, 0.05], 4, "ann", None, None, None), ("2", "alpha", [1.0, 0.05], 4, "eve", None, None, None),
              ("3", "alpha", [1.0, 0.05], 4, "ann", ["a", "c"], None, None), ("4", "alpha", [1.0, 0.05], 4, "ann", None, "x", None))
    if config.search == "ann":
        with pytest.raises(ValueError):
            retrieve(q, store, config)
        model = cells.train_cells(store.vectors, 2)
        store = replace(store, cells=cells.CellIndex(cells.cell_index(store.vectors, model), model, 2))
    seen = {}
    for r in retrieve(q, store, config).collect():
        seen.setdefault(r.query_id, set()).add(r.doc_id)
    if config.isolated:
        assert seen["1"] <= {"a", "b"} and "2" not in seen and seen["3"] == {"a"} and seen["4"] == {"a"}
    else:
        assert seen["1"] == {"a", "b", "c", "d"} and seen["3"] == {"a", "c"} and seen["4"] == {"a"}


def test_rerank_size_and_given_scores(spark, store):
    q = asked(spark, ("1", "gamma", [1.0, 0.0], 1, "ann", None, None, None))
    config = EngineConfig(rerank_enabled=True, rerank_top_n=2)
    assert [r.doc_id for r in retrieve(q, store, config).orderBy("rank").collect()] == ["b", "a"]
    scores = spark.createDataFrame([("1", "a_chunk_0", 5.0)], "query_id string, chunk_id string, score double")
    assert [r.doc_id for r in retrieve(q, store, config, scores).orderBy("rank").collect()] == ["a", "b"]


def test_classify_prompt(spark):
    df = spark.createDataFrame([("text {x}", ["b", "c"]), ("t", [])], "e string, c array<string>")
    a, b = [r[0] for r in df.select(context.classify_prompt(F.col("e"), F.col("c"))).collect()]
    assert "\nb, c\n" in a and "\ntext {x}\n" in a and a.endswith("JSON array:") and "\n(none)\n" in b
