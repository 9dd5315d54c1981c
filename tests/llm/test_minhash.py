"""Near-duplicates against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from corpusq.llm.components import connected_components
from corpusq.llm.minhash import _signatures, near_duplicates
from corpusq.llm.shingles import shingle_sets

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def expected(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(n)
    for n, (i, s) in enumerate(sets):
        for m, both in Counter(m for x in s for m in holders[x] if m < n).items():
            j, other = sets[m]
            if 100 * both >= percent * (len(s) + len(other) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}, {i: len(s) for i, s in sets}


def check(df, rows):
    component, size = expected([(r[0], r[1]) for r in rows if r[0] is not None])
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == component[r.doc_id], r
            assert r.n_shingles == size[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_documents(documents):
    check(documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])


def test_odd_rows(odd, odd_rows, none):
    check(odd, odd_rows)
    unnamed = near_duplicates(odd).where("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in unnamed] == [(None, True)] * 2
    assert near_duplicates(none).count() == 0


def test_group_of_near_copies_and_chains(spark):
    """Hundreds of edited copies of one text; a chain whose ends are unlike; sizes that only
    differ; texts that share a passage."""
    dice = random.Random(1)
    new = lambda n: [f"w{dice.randint(0, 10 ** 6)}" for _ in range(n)]
    base, rows = new(200), []
    for i in range(300):
        copy = list(base)
        for _ in range(dice.randint(0, 4)):
            copy[dice.randrange(200)] = new(1)[0]
        rows.append((1000 + i, " ".join(copy)))
    chain = new(100)
    for i in range(12):
        rows.append((2000 - i, " ".join(chain)))
        chain = chain[2:] + new(2)
    passage = new(60)
    rows += [(3000 + i, " ".join(new(40) + passage)) for i in range(40)]
    dice.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id bigint, text string"), rows)


def test_components_of_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == {
        **dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketches_never_differ_more_than_the_sets():
    """The bound by which pairs are left out, on texts of all degrees of likeness."""
    dice = random.Random(4)
    base = [str(dice.random()) for _ in range(400)]
    texts = ["", "a b", " ".join(base)] + [
        " ".join(w if dice.random() > p else f"x{dice.random()}" for w in base)
        for p in (0, 0.01, 0.03, 0.05, 0.1, 0.5)]
    value, at = shingle_sets(pa.array(texts))
    sets = [set(value[a:b].tolist()) for a, b in zip(at, at[1:], strict=False)]
    sketch = [np.array(x, np.int64).view(np.uint64)
              for x in _signatures(pa.array(texts), 3, 5).field("sketch").to_pylist()]
    for s, a in zip(sets, sketch, strict=True):
        for t, b in zip(sets, sketch, strict=True):
            apart = sum(int(x ^ y).bit_count() for x, y in zip(a, b, strict=True))
            assert apart <= len(s ^ t)
