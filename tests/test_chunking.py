"""Splitting: stated properties and an independent plain statement of the rule."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpusq.functions import chunking

MARKS = ["\n\n", "\n", ". ", " ", ""]


def plain_split(text, size, overlap, marks=MARKS):
    """String form: split keeping the mark in front, pack greedily, strip."""
    level = next(i for i, m in enumerate(marks) if m == "" or m in text)
    mark, finer = marks[level], marks[level + 1:]
    if mark:
        first, *rest = text.split(mark)
        parts = [p for p in [first, *[mark + r for r in rest]] if p]
    else:
        parts = list(text)
    out, run = [], []

    def pack():
        window = []
        for p in run:
            if sum(map(len, window)) + len(p) > size:
                if window:
                    out.append("".join(window).strip())
                while window and (sum(map(len, window)) > overlap
                                  or sum(map(len, window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        if window:
            out.append("".join(window).strip())
        run.clear()

    for p in parts:
        if len(p) < size:
            run.append(p)
        else:
            pack()
            out.extend(plain_split(p, size, overlap, finer) if finer else [p])
    pack()
    return [o for o in out if o]


texts = st.text(alphabet="ab. \nü", max_size=300)


@settings(max_examples=400, deadline=None)
@given(texts, st.integers(2, 40), st.integers(0, 39))
def test_like_plain_statement(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = [text[a:b] for a, b in chunking.split_spans(text, size, overlap)]
    assert got == (plain_split(text, size, overlap) if text else [])


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(2, 40), st.integers(0, 39))
def test_properties(text, size, overlap):
    overlap = min(overlap, size - 1)
    spans = chunking.split_spans(text, size, overlap)
    assert all(b - a <= size for a, b in spans)
    assert all(s[0] <= t[0] for s, t in zip(spans, spans[1:]))
    assert all(s[1] - t[0] <= overlap for s, t in zip(spans, spans[1:]))
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, ch in enumerate(text) if not ch.isspace())


def test_shapes(spark):
    docs = ["", "short", "x" * 1000, "x" * 2500, "\n" * 50, "word " * 500, "w" * 1500 + " tail", None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunking.chunk_recursive(F.col("t")).alias("c")).collect()}
    assert [len(got[i]) for i in range(5)] == [0, 1, 1, 3, 0]
    assert got[7] is None
    assert [len(c.content) for c in got[3]] == [1000, 1000, 900]
    assert all(len(c.content) <= 1000 for i in range(7) for c in got[i])


def test_fixed(spark):
    df = spark.createDataFrame([(i, "y" * n) for i, n in enumerate([0, 1, 200, 1000, 1001, 1800, 2600])], "i int, t string")
    got = [r.c for r in df.orderBy("i").select(chunking.chunk_fixed(F.col("t")).alias("c")).collect()]
    assert [[len(c.content) for c in g] for g in got] == [
        [], [1], [200], [1000], [1000, 201], [1000, 1000], [1000, 1000, 1000]]


def test_pages_are_numbered_through(spark):
    df = spark.createDataFrame([("d", ["aa", "", "bbb"])], "doc_id string, pages array<string>")
    chunks = F.transform("pages", lambda p: chunking.chunk_fixed(p, 2, 0))
    got = chunking.number_across_pages(df.select("doc_id", chunks.alias("c")), "c").collect()
    assert [(r.chunk_index, r.page, r.content) for r in got] == [(0, 0, "aa"), (1, 2, "bb"), (2, 2, "b")]


def test_explode_pages_keeps_pageless(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "doc_id string, pages array<string>")
    got = sorted((r.doc_id, r.page, r.content) for r in chunking.explode_pages(df).collect() if r.doc_id == "a")
    assert got == [("a", 0, "x"), ("a", 1, "y")]
    assert chunking.explode_pages(df).where("doc_id = 'b' AND page IS NULL").count() == 1


def test_text_without_marks_is_cut_without_a_span_for_each_character():
    import time

    from corpusq.functions.chunking import _pack, _windows, split_spans
    for n in (1, 2, 5, 9, 10, 11, 12, 29, 30, 31, 100):
        for size, overlap in ((2, 1), (10, 0), (10, 3), (10, 9)):
            assert list(_windows(0, n, size, overlap)) == list(_pack([(i, i + 1) for i in range(n)], size, overlap))
    text = "x" * 3_000_000
    began = time.process_time()
    spans = split_spans(text, 1000, 200)
    assert time.process_time() - began < 0.5 and len(spans) == 3750
