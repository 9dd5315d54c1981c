"""Merkle manifest against a plain version."""

import hashlib
import random
import zlib

import pytest

from corpusq.llm.merkle import merkle_manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in
               (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])])


def tree(nodes):
    """Root, and for each node the siblings and sides on its way up."""
    ways = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for way, at in zip(ways, where, strict=True):
            other = at ^ 1
            way.append((nodes[other] if other < len(nodes) else None, at % 2 == 1))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], ways


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    done, tops = {}, []
    for lang in order:
        own = sorted(langs[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, ways = tree([leaf(r) for r in own])
        tops.append(root)
        done[lang] = own, ways
    root, upper = tree(tops)
    out = []
    for lang, top, up in zip(order, tops, upper, strict=True):
        for r, way in zip(*done[lang], strict=True):
            way = way + up
            proof = h(*[s for s, _ in way if s])
            node = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                n = r["n_chars"]
                node = leaf({**r, "n_chars": None if n is None else n + 1})
            for sib, left in way:
                node = h(node) if sib is None else h(sib, node) if left else h(node, sib)
            out.append((r["doc_id"], leaf(r), top, root, proof, node, node == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, rows, df):
    got = sorted((tuple(r) for r in merkle_manifest(df).select(COLUMNS).collect()), key=repr)
    assert got == plain([r.asDict() for r in df.collect()])
    return got


def test_documents(spark, rows, documents):
    got = check(spark, rows, documents)
    assert {r[-1] for r in got} == {True, False}


def test_odd_rows(spark, rows, odd):
    check(spark, rows, odd)


def test_empty(none):
    assert merkle_manifest(none).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 17, 4096, 4097, 9001])
def test_sizes(spark, rows, n):
    """One, few and many rows of a group, several blocks; one group holds nearly all rows."""
    dice = random.Random(n)
    data = [(i * 3 - 5, f"t{dice.random()}", "en" if i < n - 2 else dice.choice(["de", None]), "s", i)
            for i in range(n)]
    dice.shuffle(data)
    check(spark, rows, spark.createDataFrame(data, SCHEMA))


def test_repeated_rows(spark, rows):
    """A third of the rows are one and the same row; many share an id."""
    data = [(7, "same", "en", "s", 4)] * 400 + [(8, f"t{i}", "en", "s", i) for i in range(400)]
    check(spark, rows, spark.createDataFrame(data + [(i, "x", "fr", None, None) for i in range(400)],
                                             SCHEMA))
