"""Search over codes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import quantised, vector
from corpusq.operators.scope import Scopes

SCHEMA = "chunk_id string, doc_id string, embedding array<float>"


def table(spark, x):
    return spark.createDataFrame([(f"c{i}", f"d{i % 50}", v.tolist()) for i, v in enumerate(x)], SCHEMA)


def asked(spark, x, k):
    return spark.createDataFrame([(f"q{i}", v.tolist(), k) for i, v in enumerate(x)],
                                 "query_id string, vector array<float>, top_k int")


def vectors_of(kind):
    dice = np.random.default_rng(3)
    if kind == "clusters":
        base = dice.standard_normal((40, 32))
        return (base[dice.integers(0, 40, 6000)] + 0.25 * dice.standard_normal((6000, 32))).astype("float32")
    return dice.standard_normal((6000, 32)).astype("float32")


@pytest.mark.parametrize("kind", ["clusters", "noise"])
def test_recall(spark, kind):
    """At least 0.9 for 256 cells, on vectors with and without clusters; scores are exact."""
    x = vectors_of(kind)
    t, q = table(spark, x).repartition(4), asked(spark, x[:60] + 0.05, 10)
    index = quantised.quantise(t, quantised.fit(t, sample=3000))
    got = quantised.quantised_topk(q, index)
    truth = vector.vector_topk(q, t)
    assert vector.recall(got, truth).agg(F.avg("recall")).first()[0] >= 0.9
    exact = {(r.query_id, r.chunk_id): r.score for r in vector.vector_topk(
        q.withColumn("top_k", F.lit(200)), t).collect()}
    rows = got.collect()
    assert len(rows) == 600 and all(abs(exact[r.query_id, r.chunk_id] - r.score) < 2e-6 for r in rows)


def test_a_query_stops_where_no_better_can_be(spark):
    """On clustered vectors the second round leaves most cells alone, and none that matters."""
    x = vectors_of("clusters")
    t, q = table(spark, x), asked(spark, x[:40], 5)
    index = quantised.quantise(t, quantised.fit(t, cells=64))
    truth = vector.vector_topk(q, t)
    kth = truth.groupBy("query_id").agg(F.min("score").alias("kth"))
    more = quantised.probes(q, index.books, 4, kth)
    assert more.count() < 0.5 * 40 * 60
    cell = {r.chunk_id: str(r.cell) for r in index.rows.collect()}
    near = quantised.probes(q, index.books, 4)
    looked = {tuple(r) for r in more.union(near).collect()}
    assert all((r.query_id, cell[r.chunk_id]) in looked for r in truth.collect())


def test_saved_and_scoped(spark, tmp_path):
    x = vectors_of("clusters")[:800]
    t, q = table(spark, x), asked(spark, x[:9], 3)
    index = quantised.quantise(t, quantised.fit(t, cells=16, codes=64))
    quantised.save_quantised(index, str(tmp_path / "ix"))
    saved = quantised.load_quantised(spark, str(tmp_path / "ix"))
    rows = lambda d: sorted(map(tuple, d.select("query_id", "chunk_id", "score", "rank").collect()))
    assert rows(quantised.quantised_topk(q, saved)) == rows(quantised.quantised_topk(q, index))
    docs = spark.createDataFrame([("s", f"d{i}") for i in range(25)], "scope_id string, doc_id string")
    q = q.withColumn("scope_id", F.lit("s"))
    got = quantised.quantised_topk(q, saved, Scopes(q, docs)).collect()
    assert got and all(int(r.doc_id[1:]) < 25 for r in got)


def test_odd_vectors(spark):
    """Zero and null vectors, fewer vectors than cells and codes, no query."""
    rows = [("a", "d", [0.0] * 16), ("b", "d", [1.0] * 16), ("c", "d", None), ("e", "d", [-1.0] * 16)]
    t = spark.createDataFrame(rows, SCHEMA)
    index = quantised.quantise(t, quantised.fit(t))
    q = asked(spark, np.ones((1, 16), "float32"), 5)
    got = [(r.chunk_id, r.score) for r in quantised.quantised_topk(q, index).orderBy("rank").collect()]
    assert got == [("b", 1.0), ("a", 0.0), ("e", -1.0)]
    assert quantised.quantised_topk(q.limit(0), index).collect() == []


def test_a_query_is_sent_once_however_many_cells_it_probes(spark):
    from corpusq.operators import cells
    x = vectors_of("clusters")[:300]
    t, q = table(spark, x), asked(spark, x[:20], 3)
    books = quantised.fit(t, cells=16, codes=16)
    wide = vector.query_columns(q)
    sent = cells.asked_by_query(wide, quantised.probes(wide, books, 12), 10_000).collect()
    assert len(sent) == 20 and all(len(set(r.cells)) == 12 for r in sent) and len({r.block for r in sent}) > 1


@pytest.mark.parametrize("kind", ["near copies", "noise"])
def test_the_rows_of_exact_search(spark, kind):
    """Also where more near copies than could be rescored lie closer than codes tell apart."""
    dice = np.random.default_rng(5)
    x = vectors_of("noise")[:1500]
    if kind == "near copies":
        x = np.repeat(x[:15], 100, axis=0) + 1e-4 * dice.standard_normal((1500, 32)).astype("float32")
        x[200:260] = x[200]
    t, q = table(spark, x), asked(spark, x[::25], 7)
    index = quantised.quantise(t, quantised.fit(t, cells=32, codes=32, sample=800))
    rows = lambda d: sorted(map(tuple, d.select("query_id", "chunk_id", "score", "rank").collect()))
    scored = spark.sparkContext.accumulator(0)
    got = rows(quantised.quantised_topk(q, index, first=4, counted=scored))
    assert got == rows(vector.vector_topk(q, t)) and len(got) == 420
    assert 420 <= scored.value < 60 * 1500


def test_a_second_look_returns_what_reaches_the_floor():
    """Tasks return the wanted hits of a query, not k each; scored exactly is little more."""
    import pyarrow as pa
    from corpusq.operators.scoring import make_block
    x = vectors_of("noise").astype("float64")
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.sort(x[:50] @ x.T, axis=1)
    ids = pa.array([f"c{i}" for i in range(len(x))])
    items = pa.record_batch([ids, ids, pa.array(list(x))], ["chunk_id", "doc_id", "embedding"])
    block = make_block(pa.table({
        "query_id": ids[:50], "fetch_k": pa.array([10] * 50, pa.int32()), "vector": list(x[:50]),
        "floor": pa.array(np.round(s[:, -3], 6))}), {"metric": "cosine"})
    for a in range(0, 6000, 1000):
        block.add(items.slice(a, 1000))
    assert block.result().num_rows == 150 and block.scorer.exact_pairs < 200
