"""Salted joins and duplicate search with one key holding over a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpusq.operators import dedup
from corpusq.operators.skew import hot_keys, lookup_join


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = [(i, "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{rng.randrange(40)}") for i in range(3000)]
    big = spark.createDataFrame(data, "id int, k string")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4), ("unused", 5), (None, 6)], "k string, v int")
    return big, small


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_same_rows_as_plain_join(skewed, rows, how):
    big, small = skewed
    assert rows(lookup_join(big, small, ["k"], "id", how, hot_rows=50)) == rows(big.join(small, "k", how))


def test_hot_key_is_dealt_out(skewed):
    big, small = skewed
    hot = {r.k: r._salts for r in hot_keys(big, ["k"], 100).collect()}
    assert hot["hot"] == 10 and None in hot and len(hot) == 2
    plan = lookup_join(big, small, ["k"], "id", "left", hot_rows=100)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_left_to_aqe_by_default(skewed):
    big, small = skewed
    plan = lookup_join(big, small, ["k"], "id", "left")._jdf.queryExecution().toString()
    assert "_salt" not in plan
    assert not hot_keys(big, ["k"], 5000).count()


def plain_decisions(incoming, stored, isolated):
    key = (lambda r: (r[2], r[3])) if isolated else (lambda r: r[3])
    known = {}
    for r in sorted(stored, key=lambda r: (r[4], r[0])):
        if r[3] is not None:
            known.setdefault(key(r), r)
    out = {}
    for r in sorted(incoming, key=lambda r: (r[4], r[0])):
        first = known.setdefault(key(r), r)
        out[r[0]] = (None, None) if first is r else (409, first[1])
    return out


@pytest.mark.parametrize("isolated", [True, False])
@pytest.mark.parametrize("hot_rows", [20, None])
def test_dedup(spark, isolated, hot_rows):
    rng = random.Random(2)
    ddl = "doc_id string, filename string, user_id string, file_hash string, at int"
    make = lambda p, n: [(f"{p}{i}", f"{p}{i}.txt", f"u{rng.randrange(3)}",
                          "same" if rng.random() < 0.4 else f"h{rng.randrange(200)}", rng.randrange(5)) for i in range(n)]
    incoming, stored = make("n", 400), make("o", 60) + [("x", "x.txt", "u0", None, 0)]
    to_df = lambda data: spark.createDataFrame(data, ddl).withColumn("uploaded_at", F.timestamp_seconds("at")).drop("at")
    got = {r.doc_id: (r.error_code, r.existing_filename) for r in dedup.dedup_decisions(
        to_df(incoming), to_df(stored), isolated, hot_rows).collect()}
    assert got == plain_decisions(incoming, stored, isolated)
