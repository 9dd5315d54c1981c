"""Search against brute force, with one block of queries and with many."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusq.operators import fusion, lexical, vector
from corpusq.operators.scope import Scopes

PATHS = [{}, {"block_bytes": 2500}]


def best(scores, k):
    return [(c, s) for s, c in sorted((-s, c) for c, s in scores.items())][:k]


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.chunk_id, round(r.score, 6)))
    return out


@pytest.fixture(scope="module")
def dense(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((120, 8)).astype("float32")
    base[40:90] = base[3]                      # a group of equal copies, over a third of all
    base[7] = 0.0
    items = [(f"c{i}", f"d{i % 30}", base[i].tolist()) for i in range(120)]
    queries = [(f"q{i}", (base[i] + 0.1).tolist(), i % 7 + 1, f"s{i % 3}" if i % 4 else None) for i in range(12)]
    return (base, items, queries,
            spark.createDataFrame(items, "chunk_id string, doc_id string, embedding array<float>"),
            spark.createDataFrame(queries, "query_id string, vector array<float>, top_k int, scope_id string"))


def score(q, x, metric):
    q, x = np.asarray(q, "float32").astype(float), np.asarray(x, float)
    if metric == "dot":
        v = q @ x
    elif metric == "l2":
        v = -math.sqrt(((q - x) ** 2).sum())
    else:
        n = math.sqrt(q @ q) * math.sqrt(x @ x)
        v = q @ x / n if n else 0.0
    return round(v, 6) + 0.0


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
@pytest.mark.parametrize("limits", PATHS)
def test_vector_topk(dense, metric, limits):
    base, items, queries, vectors, asked = dense
    got = ranked(vector.vector_topk(asked, vectors.repartition(3), metric, **limits))
    for q, v, k, _ in queries:
        want = best({c: score(v, x, metric) for c, _, x in items}, k)
        assert [c for c, _ in got[q]] == [c for c, _ in want]
        assert np.allclose([s for _, s in got[q]], [-s for _, s in want], atol=1.1e-6)


@pytest.fixture(scope="module")
def scope_docs():
    rng = random.Random(4)
    return {"s0": [f"d{i}" for i in range(30) if rng.random() < 0.6], "s1": ["d3"], "s2": []}


@pytest.mark.parametrize("limits", PATHS)
@pytest.mark.parametrize("mode", ["pre", "post"])
def test_scoped(spark, dense, scope_docs, limits, mode):
    base, items, queries, vectors, asked = dense
    docs = spark.createDataFrame([(s, d) for s, ds in scope_docs.items() for d in ds], "scope_id string, doc_id string")
    s = Scopes(asked, docs)
    got = ranked(vector.vector_topk(asked, vectors, scopes=s, mode=mode, **limits))
    doc = {c: d for c, d, _ in items}
    for q, v, k, sid in queries:
        every = {c: score(v, x, "cosine") for c, _, x in items}
        if mode == "post":
            every = dict((c, -s) for c, s in best(every, 5 * k))
        inside = {c: s for c, s in every.items() if sid is None or doc[c] in scope_docs[sid]}
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in best(inside, k)], (q, sid)


def test_nearest(dense):
    base, items, queries, vectors, _ = dense
    got = [(r.chunk_id, r.score) for r in vector.nearest(vectors, queries[0][1], 5).collect()]
    want = best({c: score(queries[0][1], x, "cosine") for c, _, x in items}, 5)
    assert [c for c, _ in got] == [c for c, _ in want]


def test_empty_sides(spark, dense):
    *_, vectors, asked = dense
    assert vector.vector_topk(asked, vectors.limit(0)).count() == 0
    assert vector.vector_topk(asked.limit(0), vectors).count() == 0


@pytest.mark.parametrize("limits", PATHS)
def test_cells(spark, tmp_path, limits):
    from corpusq.checks.derived import Tables
    from corpusq.operators import cells
    t = Tables(spark, "/root/testdata/sf0.001")
    q = t.vector_queries.withColumn("top_k", F.lit(4))
    if limits:
        q = q.where("query_id % 25 = 1")
    exact = vector.vector_topk(q, t.vectors)
    model = cells.train_cells(t.vectors, 12)
    cells.save_cells(cells.cell_index(t.vectors, model), str(tmp_path / "ix"))
    saved = spark.read.parquet(str(tmp_path / "ix"))
    assert saved.count() == t.vectors.count()

    def index(probes):
        return cells.CellIndex(saved, model, probes)

    assert ranked(cells.cell_topk(q, index(12), **limits)) == ranked(exact)
    if limits:
        return
    # these vectors have no clusters; probing must still beat the share of cells it reads
    found = [vector.recall(cells.cell_topk(q, index(n)), exact).agg(F.avg("recall")).first()[0]
             for n in (2, 5, 8)]
    assert found == sorted(found) and all(r > 1.5 * n / 12 for r, n in zip(found[:2], (2, 5))) and found[2] > 0.9
    one = plan_text(cells.cell_topk(q.where("query_id = '7'"), index(1)))
    assert "PartitionFilters: [" in one and "cell#" in one.split("PartitionFilters: [")[1].split("]")[0]


def test_items_stay_where_they_are(spark, tmp_path):
    """However many blocks of questions there are, no stored vector is shuffled, and only one
    block's vectors are fetched at a time."""
    from corpusq.checks.derived import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    plan = plan_text(vector.vector_topk(t.vector_queries, t.vectors, block_bytes=200_000))
    assert plan.count("MapInArrow") > 2
    for part in plan.split("MapInArrow")[1:]:
        below = part.split("Scan parquet")[0]
        assert "Exchange" not in below


def test_top_k_is_never_cut(dense):
    *_, vectors, asked = dense
    many = asked.withColumn("top_k", F.lit(70))
    got = ranked(vector.vector_topk(many, vectors))
    assert all(len(hits) == 70 for hits in got.values())


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


WORDS = ["the"] * 12 + ["alpha", "beta", "gamma", "delta", "Beta", "x.", "zz"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    chunks = [(f"c{i:03d}", f"d{i % 20}", " ".join(rng.choices(WORDS, k=rng.randrange(1, 15))) if i % 9 else " \n")
              for i in range(90)]
    chunks += [(f"e{i:03d}", "d1", "the alpha the beta") for i in range(60)]
    queries = [(f"q{i}", " ".join(rng.choices(WORDS + ["nowhere"], k=4)), i % 5 + 1, f"s{i % 3}" if i % 4 else None)
               for i in range(12)] + [("qn", "nowhere", 3, None)]
    return (chunks, queries, spark.createDataFrame(chunks, "chunk_id string, doc_id string, content string"),
            spark.createDataFrame(queries, "query_id string, question string, top_k int, scope_id string"))


def bm25(question, chunks):
    split = lambda s: s.lower().split()
    n = len(chunks)
    if not n:
        return {}
    mean = sum(len(split(t)) for _, _, t in chunks) / n
    df = Counter(w for _, _, t in chunks for w in set(split(t)))
    out = {}
    for c, _, t in chunks:
        tf, dl = Counter(split(t)), len(split(t))
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * dl / mean))
                for w in split(question) if tf[w])
        if s:
            out[c] = round(s, 6)
    return out


def test_bm25(texts):
    chunks, queries, df, asked = texts
    got = ranked(lexical.bm25_topk(asked.drop("scope_id"), df.repartition(3)))
    for q, text, k, _ in queries:
        want = best(bm25(text, chunks), k)
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in want]
        assert np.allclose([s for _, s in got.get(q, [])], [-s for _, s in want], atol=1.1e-6)


def test_bm25_scoped_statistics(spark, texts, scope_docs):
    chunks, queries, df, asked = texts
    docs = spark.createDataFrame([(s, d) for s, ds in scope_docs.items() for d in ds], "scope_id string, doc_id string")
    got = ranked(lexical.bm25_topk(asked, df, Scopes(asked, docs)))
    for q, text, k, sid in queries:
        inside = [c for c in chunks if sid is None or c[1] in scope_docs[sid]]
        assert [c for c, _ in got.get(q, [])] == [c for c, _ in best(bm25(text, inside), k)], (q, sid)


def test_bm25_stored_statistics(texts):
    chunks, queries, df, asked = texts
    stats = lexical.stored_statistics(lexical.term_frequencies(df), lexical.corpus_size(df))
    a = ranked(lexical.bm25_topk(asked.drop("scope_id"), df))
    assert ranked(lexical.bm25_topk(asked.drop("scope_id"), df, statistics=stats)) == a


def test_bm25_over_stored_postings_reads_no_text(spark, texts, tmp_path):
    from corpusq.sources import tables
    chunks, queries, df, asked = texts
    tables.save_index({"postings": lexical.postings(df), "lengths": lexical.chunk_lengths(df)}, str(tmp_path / "ix"))
    index = lexical.LexicalIndex(tables.load_index(spark, str(tmp_path / "ix"), "postings"),
                                 tables.load_index(spark, str(tmp_path / "ix"), "lengths"))
    found = lexical.bm25_topk(asked.drop("scope_id"), index)
    assert ranked(found) == ranked(lexical.bm25_topk(asked.drop("scope_id"), df))
    assert "content" not in plan_text(found) and "Python" not in plan_text(found)


def test_postings_are_counted_in_place(texts):
    chunks, _, df, _ = texts
    got = {(r.term, r.chunk_id): (r.tf, r.dl) for r in lexical.postings(df).collect()}
    want = {(w, c): (n, len(t.split())) for c, _, t in chunks for w, n in Counter(t.lower().split()).items()}
    assert got == want
    assert "Exchange" not in plan_text(lexical.postings(df))


def test_planted_keywords_are_found(spark):
    docs = [("solar", "Solar panels feed the Tesla Powerwall 13.5 kWh battery"),
            ("ml", "The transformer attention mechanism in machine learning"), ("x", "the the the")]
    df = spark.createDataFrame([(a, a, t) for a, t in docs], "chunk_id string, doc_id string, content string")
    q = spark.createDataFrame([("1", "tesla powerwall 13.5 kwh", 1), ("2", "transformer attention", 1)],
                              "query_id string, question string, top_k int")
    assert {r.query_id: r.chunk_id for r in lexical.bm25_topk(q, df).collect()} == {"1": "solar", "2": "ml"}


def test_fusion(spark):
    ddl = "query_id string, chunk_id string, doc_id string, rank int"
    lex = spark.createDataFrame([("q", "a", "a", 1), ("q", "b", "b", 2)], ddl)
    vec = spark.createDataFrame([("q", "b", "b", 1), ("q", "c", "c", 2), ("p", "z", "z", 1)], ddl)
    q = spark.createDataFrame([("q", 2), ("p", 5)], "query_id string, top_k int")
    got = ranked(fusion.fuse(lex, vec, q, 0.25))
    assert got == {"q": [("b", round(0.25 / 62 + 0.75 / 61, 6)), ("c", round(0.75 / 62, 6))], "p": [("z", round(0.75 / 61, 6))]}


def test_rerank(spark):
    hits = spark.createDataFrame([("q", c, "d", 1.0, i + 1) for i, c in enumerate("abcde")],
                                 "query_id string, chunk_id string, doc_id string, score double, rank int")
    scores = spark.createDataFrame([("q", "d", 0.9), ("q", "b", 0.9), ("q", "e", 0.1)],
                                   "query_id string, chunk_id string, score double")
    assert [c for c, _ in ranked(fusion.rerank(hits, scores, 4))["q"]] == ["b", "d", "e", "a"]
    text = spark.createDataFrame([("q", "a", "The cat sat", "a CAT the"), ("q", "b", "", "x")],
                                 "query_id string, chunk_id string, question string, content string")
    assert [r.score for r in fusion.overlap_scores(text).orderBy("chunk_id").collect()] == [0.666667, 0.0]


@pytest.fixture(scope="module")
def worded(spark):
    """600 chunks; every question has a stop word that stands in nearly all of them."""
    dice = random.Random(11)
    rare = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(600):
        words = ["the"] * dice.randint(0, 6) + ["of"] * dice.randint(0, 3) + dice.choices(rare, k=dice.randint(1, 30))
        dice.shuffle(words)
        rows.append((f"c{i}", f"d{i % 40}", " ".join(words)))
    rows += [(f"e{i}", "d1", "the same text again w7 w8") for i in range(60)]      # ties
    asked = [(f"q{i}", " ".join(["the", "of", *dice.choices(rare, k=4)]), i % 9 + 1) for i in range(30)]
    asked += [("stop", "the of the", 5), ("tied", "w7 w8 text", 12), ("none", "unheard", 3), ("one", "w9", 4)]
    return (spark.createDataFrame(rows, "chunk_id string, doc_id string, content string"),
            spark.createDataFrame(asked, "query_id string, question string, top_k int"))


@pytest.mark.parametrize("spared", [0.2, 0.5, 1.0])
def test_pruning_loses_nothing(worded, monkeypatch, spared):
    """The same hits as without pruning, with and without blocks and the chunks' own rows."""
    chunks, asked = worded
    monkeypatch.setattr(lexical, "SPARED", spared)
    monkeypatch.setattr(lexical, "SEED_ROWS", 40)
    index = lexical.LexicalIndex.of(chunks, blocks=True)
    want = ranked(lexical.bm25_topk(asked, index))
    assert len(want["stop"]) == 5 and "none" not in want
    for kept in (index, lexical.LexicalIndex(index.postings, index.lengths),
                 lexical.LexicalIndex(index.postings, index.lengths, index.counted)):
        assert ranked(lexical.bm25_topk(asked, kept, prune_from=0)) == want


def test_pruning_reads_few_postings(worded, monkeypatch):
    """With a stop word in each question, below 30 % of the postings are looked up."""
    chunks, asked = worded
    monkeypatch.setattr(lexical, "SEED_ROWS", 40)
    asked = asked.where("query_id like 'q%' and top_k <= 3")
    index = lexical.LexicalIndex.of(chunks)
    weighed = lexical.weighed_terms(asked, index, None, None)
    essential = lexical.essential_terms(weighed, index, None)
    read, every = (d.agg(F.sum("df")).first()[0] for d in (essential, weighed))
    assert read < 0.3 * every


def test_pruning_inside_scopes(spark, worded, monkeypatch):
    chunks, asked = worded
    monkeypatch.setattr(lexical, "SEED_ROWS", 40)
    asked = asked.withColumn("scope_id", F.when(F.col("top_k") % 3 > 0, F.concat(F.lit("s"), F.col("top_k") % 3)))
    docs = spark.createDataFrame([(f"s{s}", f"d{i}") for s in (1, 2) for i in range(0, 40, s)],
                                 "scope_id string, doc_id string")
    s = Scopes(asked, docs)
    want = ranked(lexical.bm25_topk(asked, chunks, s))
    assert ranked(lexical.bm25_topk(asked, chunks, s, prune_from=0)) == want


def test_a_first_look_loses_nothing_and_no_pairs_are_shuffled(spark, worded, monkeypatch):
    """Many blocks of questions, with and without a least score known beforehand, give the same
    hits; sums of (question, chunk) are made where the chunk lies."""
    chunks, asked = worded
    want = ranked(lexical.bm25_topk(asked, chunks))
    found = lexical.bm25_topk(asked, chunks)
    assert "hashpartitioning(query_id" in plan_text(found)
    for part in plan_text(found).split("hashpartitioning(")[1:]:
        keys = part.split(", [plan_id")[0]
        assert not ("query_id" in keys and "chunk_id" in keys)
    monkeypatch.setattr(lexical, "SLOTS", 3)
    monkeypatch.setattr(lexical, "LOOK_FROM", 0)
    monkeypatch.setattr(lexical, "LOOK", 3)
    assert ranked(lexical.bm25_topk(asked, chunks)) == want
    index = lexical.LexicalIndex(lexical.postings(chunks), lexical.chunk_lengths(chunks))
    assert ranked(lexical.bm25_topk(asked, index)) == want


def test_chunks_that_share_a_word_are_counted_without_pairs(worded):
    """More questions than one block has bits for; as many rows as chunks and blocks, not pairs."""
    chunks, asked = worded
    many = asked.union(asked.select(F.concat(F.lit("again "), "query_id"), "question", "top_k")).union(
        asked.select(F.concat(F.lit("more "), "query_id"), "question", "top_k"))
    text = {r.chunk_id: set(r.content.split()) for r in chunks.collect()}
    want = {r.query_id: sum(bool(set(r.question.split()) & w) for w in text.values()) for r in many.collect()}
    got = {r.query_id: r.chunks for r in lexical.sharing_chunks(many, lexical.postings(chunks)).collect()}
    assert got == {q: n for q, n in want.items() if n}


def test_scoring_holds_few_scores_at_once():
    """One block of 3,000 queries over 2,000 items: below 80 MB, and the true hits."""
    import tracemalloc

    import pyarrow as pa

    from corpusq.operators.scoring import make_block
    rng = np.random.default_rng(1)
    q, x = rng.standard_normal((3000, 16)), rng.standard_normal((2000, 16))
    asked = pa.table({"query_id": [f"q{i}" for i in range(3000)], "vector": pa.array(list(q)),
                      "fetch_k": pa.array([i % 5 + 1 for i in range(3000)], pa.int32())})
    block = make_block(asked, {"metric": "dot"})
    ids = [f"c{i:04d}" for i in range(2000)]
    tracemalloc.start()
    block.add(pa.record_batch({"chunk_id": ids, "doc_id": ids, "embedding": pa.array(list(x))}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    got = {}
    for r in block.result().to_pylist():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    want = np.argsort(-np.round(q @ x.T, 6), axis=1, kind="stable")
    assert got == {f"q{i}": [ids[j] for j in want[i, :i % 5 + 1]] for i in range(3000)}
