"""Collocations against a plain version."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusq.llm.phrases import MisraGries, collocations, scored

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    out = []
    langs = {}
    for lang, text in rows:
        langs.setdefault("und" if lang is None else lang, []).append(text or "")
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER)):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                for k in range(1, 6):
                    f.update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(100 * b >= 100 * a and len(q) > len(p) and any(
                    q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                    for q, b in cands.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), f[p[:k]], f[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def check(df, least, top, **kw):
    got = sorted(tuple(r) for r in collocations(df, least=least, top=top, **kw).select(
        COLUMNS).collect())
    assert got == plain([(r.lang, r.text) for r in df.collect()], least, top)
    return got


def test_documents(documents):
    assert check(documents, 12, 2000)
    assert check(documents, 8, 15, counters=64)


def test_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check(docs, 100, 2000)


def test_odd_rows(odd):
    check(odd, 2, 2000)
    check(odd, 50, 10)


def test_empty(none, spark):
    assert collocations(none).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect() == []


def test_overlaps_and_gaps(spark):
    texts = ["a a a a a", "b\tB  b. b,b", "Ä ä Ä\x0bÄ ä", "x y! x y x y", "", "\t ", "é é é"]
    check(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts * 2)], SCHEMA), 2, 100)


def test_hot_phrase(spark):
    """One line in two thirds of the rows, one language nearly everywhere."""
    dice = random.Random(1)
    data = [(i, "the quick brown fox jumps over it. " * (i % 3)
             + " ".join(f"w{dice.randint(0, 60)}" for _ in range(40)),
             "en" if i % 50 else None, "s", 0) for i in range(600)]
    check(spark.createDataFrame(data, SCHEMA), 40, 2000, counters=16)


@pytest.mark.parametrize("capacity", [1, 7, 60])
def test_every_frequent_one_survives(capacity):
    dice = np.random.default_rng(capacity)
    marks = dice.zipf(1.4, 6000).clip(0, 3000).astype(np.uint32)
    least = len(marks) // capacity + 1                 # capacity exceeds mass / least
    state = MisraGries(capacity, least)
    for part in np.array_split(marks, 90):
        state.add(*(lambda u: (u[0], u[1].astype(np.int64)))(np.unique(part, return_counts=True)))
    left = set(state.survivors().tolist())
    assert state.error < least and len(state.mark) <= 2 * capacity
    assert {m for m, c in Counter(marks.tolist()).items() if c >= least} <= left


def test_products_beyond_64_bits(spark):
    """Counts of a corpus of 10**14 words."""
    n, a, l, r = 10 ** 14 + 7, 10 ** 12 - 1, 10 ** 12 + 3, 3 * 10 ** 12 + 1
    counts = spark.createDataFrame(
        [("en", "", 0, n), ("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)],
        "lang string, phrase string, k int, c bigint")
    got = scored(counts).first()
    assert (got.score, got.l, got.r) == (1000 * a * n // (l * r), l, r)
