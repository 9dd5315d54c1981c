"""Language, packing and the pipeline."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusq.llm.language import identify_language, learn_dictionaries
from corpusq.llm.packing import BUDGET, bin_top, boundaries, pack


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    got = identify_language(documents).collect()
    assert len(got) == len(lang)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.lang_pred in {*lang.values(), "und"}
    right = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(right) >= 0.96
    assert np.mean([r.rejected for r in got]) < 0.02


def test_learns_from_the_rest_only(documents):
    """Labels of held-out rows change nothing."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    spoiled = documents.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    assert identify_language(spoiled).collect() == identify_language(documents).collect()


def test_language_rows(odd, odd_rows, none):
    got = identify_language(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (1, 2, 3, 12):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert identify_language(none).count() == 0
    assert learn_dictionaries(none) == {}
    unlabelled = identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


# --- packing ----------------------------------------------------------------------------------

def least_padding(tops, counts, buckets):
    n = len(tops)
    best = {0: 0}
    for _ in range(buckets):
        best = {**best, **{j: min(
            [best[i] + tops[j - 1] * sum(counts[i:j]) for i in best if i < j]
            + ([best[j]] if j in best else [])) for j in range(1, n + 1)}}
    return best[n]


def test_boundaries_are_optimal():
    dice = np.random.default_rng(3)
    for _ in range(60):
        n = int(dice.integers(1, 14))
        tops = np.sort(dice.choice(np.arange(1, 200), n, replace=False))
        counts = dice.integers(1, 50, n)
        k = int(dice.integers(1, 6))
        bounds = boundaries(tops, counts, k)
        assert len(bounds) <= k and bounds[-1] == tops[-1]
        padded = sum(c * min(b for b in bounds if b >= t)
                     for t, c in zip(tops, counts, strict=True))
        assert padded == least_padding(tops.tolist(), counts.tolist(), k)


def test_bins(spark):
    got = spark.range(1, 5000).select("id", bin_top(F.col("id")).alias("top")).collect()
    assert all(r.top >= r.id and r.top - r.id <= max(0, r.id / 128) for r in got)
    assert all(r.top == r.id for r in got if r.id < 256)
    assert len({r.top for r in got}) < 1000


def test_batches(spark, documents):
    sized = {r.doc_id: len(r.text.split()) for r in documents.collect()}
    got = pack(documents, shard_rows=20).collect()
    batches = {}
    for r in got:
        assert r.n_tokens == sized[r.doc_id] and r.padding == r.bucket - r.n_tokens >= 0
        batches.setdefault(r.batch, []).append(r)
    assert len(got) == len(sized)
    for rows in batches.values():
        assert len({r.bucket for r in rows}) == 1
        assert sorted(r.slot for r in rows) == list(range(1, len(rows) + 1))
        assert len(rows) == 1 or len(rows) * rows[0].bucket <= BUDGET


def test_packing_rows(odd, odd_rows, none):
    got = pack(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.batch is None) == (r.n_tokens == 0) == (r.bucket == 0)
    long = [r for r in got if r.doc_id == 4][0]
    assert long.n_tokens == 30_000 and long.slot == 1
    assert len([r for r in got if r.batch == long.batch]) == 1
    assert pack(none).count() == 0


# --- the pipeline -------------------------------------------------------------------------------

def test_pipeline(spark, documents):
    """Each stage against what its operator says of the stage's own input."""
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == corpus_pipeline.DOCUMENTS
        rows = out.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        if name == "language_id":
            told = {r.doc_id: r for r in identify_language(docs).collect()}
            assert {r.doc_id: r.lang for r in rows} == {
                i: r.lang_pred for i, r in told.items() if not r.rejected}
        if name == "secret_scan":
            assert len(rows) == docs.count()
            assert all(r.n_chars == len(r.text) for r in rows)
            assert any("[SECRET]" in r.text for r in rows)
        docs = spark.createDataFrame(rows, out.schema)
    assert pack(docs).count() == docs.count()


def test_near_copies_from_080_up_go(spark):
    """Five-word shingles of 600 words with 12 replaced have a similarity of about 0.82."""
    words = [f"w{i}" for i in range(600)]
    edited = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(words)]
    far = [f"y{i}" if i % 30 == 15 else w for i, w in enumerate(words)]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate([words, edited, far])]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left) == [0, 2]


def test_pipeline_over_the_table(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 150
    assert set(got.columns) == {"doc_id", "n_tokens", "bucket", "batch", "slot", "padding"}


def test_pipeline_rows(spark, odd, none):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        if name == "near_dedup":
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
            assert 5 in ids and 6 not in ids and None in ids
    empty = none
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "").cache()
        assert empty.count() == 0
