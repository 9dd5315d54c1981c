"""Approximate and exact searches against all pairs."""

import numpy as np
import pytest

from corpusq.llm.hamming import hamming_topk
from corpusq.llm.rabitq import Search, ann_search, encode, rotation


def read(df):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.select(
        "vec_id", "embedding").collect()]
    return np.array([i for i, _ in rows]), np.stack([v for _, v in rows])


def test_recall_and_scores(embeddings):
    ids, vectors = read(embeddings)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {}
    for r in ann_search(embeddings, embeddings.where("vec_id % 10 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for n in np.flatnonzero(ids % 10 == 0):
        cosine = unit @ unit[n]
        cosine[n] = -2
        best = ids[np.lexsort((ids, -cosine))[:5]]
        found = sorted(got[ids[n]])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(cosine[ids == i][0] - s) < 1e-12 for _, i, s in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit >= 0.9 * 5 * (ids % 10 == 0).sum()


def test_estimates_stay_within_bounds():
    dice = np.random.default_rng(2)
    vectors, query = dice.standard_normal((4000, 64)), dice.standard_normal((1, 64))
    codes, fit = encode(vectors, rotation(64))
    search = Search(np.array([-1]), query, np.array([-np.inf]), 5)
    guess = sum((search.signs @ search.parts[:, b].T)[codes[:, b]]
                for b in range(8))[:, 0] / fit
    true = (vectors @ query[0]) / np.linalg.norm(vectors, axis=1) / np.linalg.norm(query)
    error = 2.4 * np.sqrt((1 - fit ** 2) / 63) / fit
    assert (np.abs(guess - true) <= error).mean() > 0.97


@pytest.fixture
def odd_vectors(spark):
    one = [1.0] * 64
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, [-1.0] * 64, 0), (4, None, 0), (5, [], 0),
            (6, [0.0] * 64, 0), (7, [float("nan")] + one[1:], 0), (8, [float("inf")] + one[1:], 0),
            (9, [None] + one[1:], 0), (None, one, 0), (20, one, None), (100, one, 0),
            (40, [1.0, 2.0], 0)]
    return spark.createDataFrame(
        [(*r, 5, "c") for r in rows],
        "vec_id bigint, embedding array<float>, label int, rank int, code string")


def test_odd_vectors(odd_vectors):
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_search(
        odd_vectors, odd_vectors.where("vec_id % 20 = 0"), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1), (20, 2, 2), (20, 3, 2), (100, 1, 1), (100, 2, 2), (100, 3, 2)]
    got = [(r.query_id, r["rank"], r.vec_id, r.distance) for r in hamming_topk(
        odd_vectors, odd_vectors.where("vec_id % 20 = 0"), k=10).orderBy(
        "query_id", "rank").collect()]
    assert got == [(20, 1, 1, 0), (20, 2, 2, 0), (20, 3, 100, 0), (20, 4, 3, 64),
                   (100, 1, 1, 0), (100, 2, 2, 0), (100, 3, 20, 0), (100, 4, 3, 64)]


def test_empty(embeddings):
    none = embeddings.limit(0)
    assert ann_search(none, none).count() == 0 == ann_search(embeddings, none).count()
    assert hamming_topk(none, none).count() == 0 == hamming_topk(embeddings, none).count()


def test_several_query_blocks(embeddings):
    asked = embeddings.where("vec_id % 50 = 0")
    whole = ann_search(embeddings, asked).collect()
    parts = ann_search(embeddings, asked, block_bytes=1024, sample=10).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_exact_with_many_copies(spark):
    """Thousands of equal codes, some near ones, the rest far."""
    dice = np.random.default_rng(4)
    base = dice.choice([-1.0, 1.0], 64)
    vectors = [base] * 400
    for _ in range(60):
        v = base.copy()
        v[dice.choice(64, dice.integers(1, 12), replace=False)] *= -1
        vectors.append(v)
    vectors += list(dice.choice([-1.0, 1.0], (140, 64)))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in hamming_topk(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.distance))
    signs = np.stack(vectors)
    for q in range(0, len(vectors), 20):
        far = ((signs != signs[q]).sum(1)).astype(int)
        far[q] = 99
        order = np.lexsort((np.arange(len(far)), far))[:10]
        assert sorted(got[q]) == [(n + 1, i, far[i]) for n, i in enumerate(order)]
